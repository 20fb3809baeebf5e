import pytest
from pyspark.sql import functions as F

from cellgrain.operators.stats import Metric, compute_metrics
from cellgrain.plans import legacy, locator, overview, profile, registry, schema
from cellgrain.plans.rules import EDUCATION_TEMPLATE
from cellgrain.plans.schema import Override
from cellgrain.sources import business, delimited, export

SALES = (
    ["订单号", "销售额", "成本", "数量", "地区", "日期", "备注", "是否付费"],
    [[str(1000001 + i), f"{1000 + 37 * i}.5", f"{500 + 11 * i}", str(i % 5 + 1), ["华东", "华南"][i % 2],
      f"2024-01-{i % 28 + 1:02d}", f"note {i}", "是"] for i in range(40)],
)


def _schema(df, **kw):
    counts = profile.column_counts(df)
    return {r["field"]: r for r in schema.resolve_schema(schema.infer_schema(counts), **kw).collect()}


def test_generic_roles(table):
    got = _schema(table(*SALES))
    roles = {f: (r["data_type"], r["role"], r["direction"]) for f, r in got.items()}
    assert roles == {
        "订单号": ("identifier", "identifier", "neutral"), "销售额": ("number", "metric", "unspecified"),
        "成本": ("number", "metric", "unspecified"), "数量": ("number", "metric", "unspecified"),
        "地区": ("category", "dimension", "neutral"), "日期": ("datetime", "time", "neutral"),
        "备注": ("text", "description", "neutral"), "是否付费": ("boolean", "dimension", "neutral"),
    }
    assert got["订单号"]["reasons"] == ['字段名包含"订单号"']


@pytest.mark.parametrize("header, role", [
    ("responseTimeMs", "metric"), ("create_time", "time"), ("date_of_sale", "time"), ("timeout", "time"),
    ("timestamp", "time"), ("paid", "identifier"), ("sku", "identifier"), ("stockQuantity", "metric"),
])
def test_header_rules(table, header, role):
    df = table([header], [[f"{7 * i % 13}.5"] for i in range(40)])
    assert _schema(df)[header]["role"] == role


def test_word_boundary_option(table):
    df = table(["paid", "user_id"], [[f"{i}.5", f"{i}"] for i in range(9)])
    got = {r["field"]: r["role"] for r in schema.infer_schema(profile.column_counts(df), word_boundary=True).collect()}
    assert got == {"paid": "metric", "user_id": "identifier"}


def test_resolution_order(table):
    df = table(["班级排名", "总分", "销售额"], [[str(i + 1), str(60 + i), str(i)] for i in range(9)])
    assert _schema(df)["班级排名"]["direction"] == "unspecified"
    edu = _schema(df, template=EDUCATION_TEMPLATE)
    assert (edu["班级排名"]["direction"], edu["总分"]["direction"], edu["销售额"]["source"]) == ("lower_is_better", "higher_is_better", "structure")
    user = _schema(df, template=EDUCATION_TEMPLATE, overrides={"总分": Override(role="unspecified", reason="test"), "销售额": Override(ignored=True)})
    assert (user["总分"]["role"], user["总分"]["source"], user["总分"]["reasons"]) == ("unspecified", "user", ["用户明确配置：test"])
    assert user["销售额"]["ignored"]


def test_fallback_to_existing_and_legacy(spark, table):
    # 40 % numbers and no telling name: inference gives up
    df = table(["m"], [["1"], ["2"], ["x"], ["y"], ["z"]])
    counts = profile.column_counts(df)
    inferred = schema.infer_schema(counts)
    assert inferred.first()["data_type"] == "unknown"
    old = legacy.to_schema(legacy.classify_fields(counts))
    assert schema.resolve_schema(inferred, legacy=old).first()["source"] == "legacy"
    stored = inferred.withColumn("data_type", F.lit("number")).withColumn("source", F.lit("template"))
    assert schema.resolve_schema(inferred, existing=stored, legacy=old).first()["data_type"] == "number"
    assert schema.resolve_schema(inferred).first()["role"] == "unspecified"


def test_catalogue_and_context(table):
    resolved = schema.resolve_schema(schema.infer_schema(profile.column_counts(table(*SALES))), {"销售额": Override(direction="higher_is_better")})
    cat = schema.semantic_catalogue(resolved)
    assert [m.name for m in cat.metrics] == ["销售额", "成本", "数量"]
    assert [m.name for m in cat.recommended()] == ["销售额"]
    assert cat.dimensions == ("地区", "日期", "是否付费") and cat.entities == (("订单号", False),)
    got = [r["field"] for r in schema.context_columns(resolved, "销售额").collect()]
    assert got == ["订单号", "日期", "地区"]
    assert [r["field"] for r in schema.default_shortlist(resolved, ["成本"]).collect()] == ["销售额", "数量"]
    groups = {r["role_group"]: r["fields"] for r in schema.fields_by_role(resolved).collect()}
    assert groups["metric"] == ["销售额", "成本", "数量"] and groups["description"] == ["备注"]
    flags = {r["field"]: (r["analysable"], r["evaluated"]) for r in schema.with_participation(resolved).collect()}
    assert flags["销售额"] == (True, True) and flags["备注"] == (False, False) and flags["成本"] == (True, False)


def test_feature_types(table, spark):
    rows = [[str(10**6 + i), f"{i * 1.5}", f"2024-01-{i % 28 + 1:02d}", "word " * 15 + str(i), "ab"[i % 2], f"u{i}", ""] for i in range(40)]
    df = table(["serial", "m", "d", "t", "c", "u", "e"], rows)
    got = {r["field"]: r["feature_type"] for r in profile.feature_types(profile.column_counts(df)).collect()}
    assert got == {"serial": "identifier", "m": "numerical", "d": "temporal", "t": "text", "c": "categorical", "u": "invalid", "e": "invalid"}
    approx = {r["field"]: r["feature_type"] for r in profile.feature_types(profile.column_counts(df, approx=True)).collect()}
    assert approx == got


def test_long_texts_are_counted_whole(table):
    a, b = "x" * 500 + "班", "x" * 500 + "z"
    df = table(["t"], [[a], [a], [b], ["1" * 300]])
    r = profile.column_counts(df).first()
    assert (r["unique_all"], r["length"], r["class_label"], r["numeric"]) == (3, 501 * 3 + 300, 2, 1)


def test_samples_in_row_order(spark):
    df = spark.createDataFrame([(3, "c"), (1, ""), (2, "b"), (4, "null"), (9, "z"), (5, "e")], "_row_id bigint, t string")
    assert profile.sample_values(df, ["t"]).first()["sample_values"] == ["b", "c", "e"]


def test_legacy_fields(table):
    n = 60
    df = table(["学号", "姓名", "班级", "总分", "数学", "班级排名", "政策加分", "备注", "12_34", "合计"], [
        [str(20240000 + i), "张三李四"[i % 3:i % 3 + 2], f"{i % 3}班", str(300 + i), str(60 + i % 60), str(i + 1), str(i % 3), f"t{i}", "1", str(i)]
        for i in range(n)
    ])
    got = {r["field"]: r for r in legacy.classify_fields(profile.column_counts(df)).collect()}
    assert {f: (r["type"], r["role"]) for f, r in got.items()} == {
        "学号": ("identity", "identity"), "姓名": ("identity", "identity"), "班级": ("identity", "identity"),
        "总分": ("score", "primaryTotal"), "数学": ("score", "courseScore"), "班级排名": ("rank", "rank"),
        "政策加分": ("bonus", "adjustment"), "备注": ("text", "textMeta"), "12_34": ("unknown", "invalid"),
        "合计": ("unknown", "sectionTotal"),
    }
    assert got["学号"]["confidence"] == 0.95 and got["政策加分"]["confidence"] == 0.92
    assert got["数学"]["confidence"] == 0.95 and "分数范围合理(60~119)" in got["数学"]["reason"]
    assert got["12_34"]["confidence"] == 0.93
    fields = legacy.classify_fields(profile.column_counts(df))
    assert [r["field"] for r in legacy.recommended_fields(fields).orderBy("position").collect()] == ["总分", "班级排名", "数学"]
    r = legacy.report_summary(fields, n).first()
    assert (r["data_rows"], r["identity_count"], r["invalid_count"], r["recommended_count"]) == (60, 3, 1, 3)
    assert "非法/未命名字段" in r["warnings"]
    hidden = {r["field"]: r["hidden_reason"] for r in legacy.report_fields(fields).collect()}
    assert hidden["总分"] == "" and hidden["学号"] == "标识/身份字段，不参与数值分析"
    assert legacy.analysable_fields(fields, show_all=True).count() == 9
    assert {r["field"] for r in legacy.analysable_fields(fields).collect()} == {"总分", "班级排名", "数学"}
    made = {r["field"]: r for r in legacy.semantic_definitions(fields).collect()}
    assert (made["学号"]["kind"], made["学号"]["type"], made["学号"]["primary_key"]) == ("entity", "id", True)
    assert (made["班级"]["kind"], made["班级"]["type"]) == ("dimension", "group")
    assert (made["班级排名"]["direction"], made["政策加分"]["recommended"]) == ("lower-is-better", False)
    assert "12_34" not in made
    mapped = {r["field"]: (r["data_type"], r["role"]) for r in legacy.to_schema(fields).collect()}
    assert mapped["班级"] == ("category", "dimension") and mapped["学号"] == ("identifier", "identifier")
    assert mapped["班级排名"] == ("number", "metric") and mapped["12_34"] == ("unknown", "ignored")


@pytest.mark.parametrize("header, bad", [
    ("", True), ("未命名字段3", True), ("_-.", True), ("93_80", True), ("101.60_91.60", True), ("2024", True), ("123", False), ("总分", False), ("a1", False),
])
def test_invalid_headers(spark, header, bad):
    df = spark.createDataFrame([(header,)], "h string")
    assert df.select(legacy.is_invalid_header(F.col("h"))).first()[0] is bad


def test_analytic_scores(table):
    df = table(["serial", "m"], [[str(i + 1), f"{i % 10 * 13.5 + 1}"] for i in range(50)])
    got = {r["field"]: r for r in legacy.analytic_scores(legacy.classify_fields(profile.column_counts(df))).collect()}
    assert got["m"]["analysable"] and got["m"]["uniqueness_penalty"] == 0.0
    assert got["serial"]["uniqueness_penalty"] == 1.0 and got["serial"]["monotonic_penalty"] == 0.8


def test_locator(table):
    df = table(["学生编号", "名字", "班级", "成绩"], [[f"S{1000 + i}", ["张三", "李四", "王五"][i % 3], f"{i % 2}班", str(i % 9)] for i in range(30)])
    got = {r["field"]: r for r in locator.locator_fields(profile.column_counts(df)).collect()}
    assert [(got[f]["semantic"], got[f]["is_candidate"]) for f in ("学生编号", "名字", "班级", "成绩")] == [
        ("identifier", True), ("name", True), ("group", True), ("other", False)]
    assert got["学生编号"]["confidence"] == 0.96 and got["学生编号"]["uniqueness"] == 1.0
    report = locator.locator_report(df, "张三").collect()
    assert {r["field"]: r["matched_count"] for r in report} == {"学生编号": 0, "名字": 10, "班级": 0}
    assert report[0]["unique_field"] == "学生编号" and report[0]["suggestion"] == "建议输入 姓名 + 班级/部门 进行组合定位。"


def test_overview_and_profile(table):
    rows = [[str(10 + i % 7), "ab"[i % 2], f"2024-01-{i % 28 + 1:02d}", "" if i % 2 else "5"] for i in range(40)] + [["9000", "a", "2024-02-01", ""]]
    df = table(["m", "c", "d", "half"], rows)
    got = {r["field"]: r for r in overview.dataset_overview(df).collect()}
    assert (got["m"]["outlier_status"], got["m"]["outlier_count"]) == ("detected", 1)
    assert got["half"]["high_missing"] and not got["m"]["high_missing"]
    prof = {r["field"]: r for r in overview.dataset_profile(df).collect()}
    assert prof["c"]["top_categories"] == "a=21; b=20" and prof["d"]["insight"] == "时间范围 2024-01-01 到 2024-02-01"


def test_fingerprint_ignores_order_but_not_copies(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "i int, t string")
    b = spark.createDataFrame([(2, "y"), (1, "x")], "i int, t string")
    c = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (3, "z")], "i int, t string")
    d = spark.createDataFrame([(1, "x"), (2, "y"), (4, "z"), (4, "z")], "i int, t string")
    f = [tuple(profile.dataset_fingerprint(x).first()) for x in (a, b, c, d)]
    assert f[0] == f[1] and len({f[0], f[2], f[3]}) == 3


def test_registry(spark):
    book = registry.MetricRegistry()
    made = book.get_or_create("v", lambda _id: lambda df, metric, x: df.agg(F.max(metric.name).alias("top")))
    assert made is book.get_or_create("v", lambda _id: None) and book.ids() == ["v"]
    assert book.compute(spark.createDataFrame([(3,)], "v int"), Metric("v")).first()["top"] == 3


# ---- sources and sinks -------------------------------------------------------------------
def test_headers():
    assert delimited.clean_headers([" a\x00 ", "A", "", "b   c", "", "a_1", "a"]) == ["a", "A_1", "未命名字段1", "b c", "未命名字段2", "a_1_1", "a_2"]


def test_read_csv(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_bytes('﻿编号,名称,备注\r\n1," a,""b"" ","line1\nline2"\r\n2,short\r\n3,x,y,\r\n4,x,y,extra\r\n5,1,234,9\r\n,,\r\n'.encode())
    got = delimited.read_csv(spark, str(f))
    assert got.rows.columns == ["编号", "名称", "备注"]
    assert [tuple(r) for r in got.rows.orderBy("编号").collect()] == [("", "", ""), ("1", 'a,"b"', "line1\nline2"), ("2", "short", ""), ("3", "x", "y")]
    assert {r["route"]: r["records"] for r in got.counts.collect()} == {"ok": 3, "short": 1, "too_wide": 2}
    assert got.quarantine.count() == 2
    flat = tmp_path / "flat.csv"
    flat.write_text("a,b\n1,2\n\"3,4\"\n5,6,7\n")
    got = delimited.read_csv(spark, str(flat), multi_line=False)
    assert sorted(tuple(r) for r in got.rows.collect()) == [("1", "2"), ("3,4", "")]


def test_read_lines(spark, tmp_path):
    f = tmp_path / "t.tsv"
    f.write_text("学号\t姓名\t数学\n1\t张三\t 90 \n2\t李四\n3\t王五\t80\t\t\n4\ta\tb\tc\n")
    got = delimited.read_lines(spark, str(f))
    assert sorted(tuple(r) for r in got.rows.collect()) == [("1", "张三", "90"), ("2", "李四", ""), ("3", "王五", "80")]
    assert {r["route"]: r["records"] for r in got.counts.collect()} == {"ok": 2, "short": 1, "too_wide": 1}


def _joined(path):
    parts = sorted(p for p in path.iterdir() if p.name.startswith("part-"))
    return b"".join(p.read_bytes() for p in parts).decode()


def test_write_csv(spark, tmp_path):
    df = spark.createDataFrame(
        [("=1+1", -5.0, "a,b"), ("-CMD", 2.5, 'say "hi"'), ("-10", 3.0, "two\nlines"), (None, None, "")], "t string, n double, x string"
    ).coalesce(1)
    export.write_csv(df, str(tmp_path / "bom"), bom=True)
    assert _joined(tmp_path / "bom") == "﻿t,n,x\r\n'=1+1,-5,\"a,b\"\r\n'-CMD,2.5,\"say \"\"hi\"\"\"\r\n-10,3,\"two\nlines\"\r\n,,\r\n"
    export.write_csv(df, str(tmp_path / "plain"), ["x", "t"])
    assert _joined(tmp_path / "plain").startswith('x,t\r\n"a,b",\'=1+1\r\n"say ""hi""",\'-CMD\r\n')


def test_summary_sheet(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,)], "v double")
    got = {(r["section"], r["key"]): r["value"] for r in export.summary_sheet(compute_metrics(df, [Metric("v", "higher-is-better")], {"v": 5.0})).collect()}
    assert got["stats", "均值"] == "1.5" and got["stats", "无效/空值"] == "1" and got["position", "是否超出数据范围"] == "高于数据范围"
    assert got["interpretation", "方向"] == "越高越好"
    plain = {(r["section"], r["key"]) for r in export.summary_sheet(compute_metrics(df, [Metric("v", "neutral")], {"v": 5.0})).collect()}
    assert not any(s == "position" for s, _ in plain) and ("interpretation", "说明") in plain


def test_business_table(spark):
    df = spark.createDataFrame([("2024-01-01", 10.0, 2, 1, 3, 5.25, "shop")], "dt string, total_sales double, total_orders int, total_customers int, total_quantity int, avg_order_value double, source_system string")
    assert tuple(business.business_table(df).first()) == ("2024-01-01", "10", "2", "1", "3", "5.25", "shop")
    assert business.business_warnings(df).count() == 0 and business.business_warnings(df.limit(0)).count() == 1


def test_analysable_fallback_and_context(table):
    df = table(["m", "c", "user_id"], [[str(i % 3), "ab"[i % 2], str(i)] for i in range(20)])
    counts = profile.column_counts(df)
    resolved = schema.resolve_schema(schema.infer_schema(counts), {"m": Override("category", "dimension")})
    assert schema.analysable_fields(resolved).count() == 0
    assert [r["field"] for r in schema.analysable_fields(resolved, counts).collect()] == ["m"]
    assert [r["field"] for r in schema.context_fallback(counts, "user_id").collect()] == ["c", "m"]


def test_rank_field_names():
    from cellgrain.operators.stats import is_rank_field

    assert is_rank_field("班级排名") and is_rank_field("x", "rank") and not is_rank_field("总分")
