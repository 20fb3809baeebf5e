import pytest
from pyspark.sql import functions as F

from cellgrain.operators import (
    cells, correlation, distribution, filters, groups, lookup, outliers, rows, sampling, stats, timeseries,
)
from cellgrain.operators.filters import Condition
from cellgrain.operators.outliers import OutlierOptions
from cellgrain.operators.stats import Metric
from cellgrain.plans import explain


def numbers_frame(spark, values):
    return spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "_row_id bigint, v double")


# ---- stats ------------------------------------------------------------------------
def test_metric_stats_counts_valid_and_invalid(table):
    df = table(["s"], [["10"], ["20"], ["30"], ["缺考"], [""], [None]])
    r = stats.metric_stats(df, ["s"]).first()
    assert (r["count"], r["invalid_count"], r["min"], r["max"], r["mean"], r["median"]) == (3, 3, 10, 30, 20, 20)
    assert (r["q25"], r["q75"], r["q90"], r["q95"]) == pytest.approx((15, 25, 28, 29))


def test_field_without_numbers_gives_no_stats(table):
    df = table(["s"], [["x"], [None]])
    assert stats.metric_stats(df, ["s"]).count() == 0
    r = stats.numeric_summary(df, ["s"]).first()
    assert (r["count"], r["valid_count"], r["missing_count"], r["mean"]) == (2, 0, 2, None)


@pytest.mark.parametrize("x, side, rank, percentile", [
    (9, "below", (4, 3), 0.0), (31, "above", (1, 0), 100.0), (25, None, (2, 1), 200 / 3), (20, None, (2, 2), 200 / 3),
])
def test_position(spark, x, side, rank, percentile):
    r = stats.position(numbers_frame(spark, [10, 20, 30]), "v", x).first()
    assert (r["best_rank"], r["worst_rank"]) == rank
    assert r["percentile"] == pytest.approx(percentile)
    assert (r["out_of_range_direction"], r["is_out_of_range"]) == (side, side is not None)


def test_position_when_lower_is_better(spark):
    r = stats.position(numbers_frame(spark, [10, 20, 30]), "v", 10, "lower-is-better").first()
    assert (r["best_rank"], r["worst_rank"], r["percentile"]) == (1, 1, 100.0)


def test_position_of_nothing(spark):
    r = stats.position(numbers_frame(spark, [None]), "v", 1).first()
    assert (r["total"], r["percentile"], r["is_out_of_range"]) == (0, 0.0, False)


def test_stable_moments_near_the_double_limit(spark):
    r = stats.stable_moments(numbers_frame(spark, [1e308, 1e308]), ["v"]).first()
    assert (r["mean"], r["std"]) == (1e308, 0.0)
    r = stats.stable_moments(numbers_frame(spark, [1e308, -1e308]), ["v"]).first()
    assert (r["mean"], r["std"]) == (0.0, pytest.approx(1e308))


def test_neutral_metric_has_no_position(spark):
    df = numbers_frame(spark, [1, 2, 3])
    got = stats.compute_metrics(df, [Metric("v", "neutral")], {"v": 2.0}).first()
    assert got["percentile"] is None and got["total"] is None and got["valid_count"] == 3


def test_nan_and_infinity_do_not_count(spark):
    df = numbers_frame(spark, [1.0, float("nan"), float("inf"), 3.0])
    r = stats.metric_stats(df, ["v"]).first()
    assert (r["count"], r["max"], r["median"]) == (2, 3.0, 2.0)


# ---- rows and filters -------------------------------------------------------------
def test_row_types(table):
    df = table(["a", "b", "c"], [
        ["平均分", "85", "90"], ["合计", "", ""], ["统计学教材", "合计", "教材"], ["", " ", None],
        ["张三", "合计", "90"], ["合计", "x", "90"], ["李四", "1", "2"],
    ])
    got = [r["row_type"] for r in rows.with_row_type(df).collect()]
    assert got == ["summary", "summary", "validData", "empty", "summary", "summary", "validData"]


def test_status_rows_need_a_word_list(table):
    df = table(["a", "b"], [["缺考", ""], ["缺考", "1"]])
    assert [r["row_type"] for r in rows.with_row_type(df).collect()] == ["validData", "validData"]
    got = [r["row_type"] for r in rows.with_row_type(df, status_words=["缺考"]).collect()]
    assert got == ["statusOnly", "validData"]


def test_all_rows_kept_when_none_is_valid(table):
    df = table(["a", "b"], [["合计", "1"], ["", ""]])
    assert rows.keep_valid_rows(df).count() == 2
    assert rows.keep_valid_rows(table(["a", "b"], [["合计", "1"], ["x", ""]])).count() == 1


@pytest.mark.parametrize("cond, want", [
    (Condition("s", "gt", "80"), [1, 3]), (Condition("s", "gte", "80"), [0, 1, 3]), (Condition("s", "lt", "80"), []),
    (Condition("s", "equals", "1,000"), [3]), (Condition("s", "gt", "abc"), []), (Condition("s", "gt", ""), []),
    (Condition("s", "isEmpty"), [4, 5, 6]), (Condition("s", "isNotEmpty"), [0, 1, 2, 3]),
    (Condition("s", "between", "80,90"), [0, 1]), (Condition("s", "between", "1,000"), []),
    (Condition("s", "between", low="80", high="1,000"), [0, 1, 3]), (Condition("s", "between", low="90", high="80"), []),
    (Condition("s", "between", "1,000,2,000"), []),
])
def test_numeric_conditions(spark, cond, want):
    cells_ = ["80", "85%", "缺考", "1,000", "-", "", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells_)], "i int, s string")
    got = filters.filter_rows(df, [cond], {"s"})
    assert sorted(r["i"] for r in got.collect()) == want


@pytest.mark.parametrize("cond, want", [
    (Condition("s", "equals", " ab "), [0]), (Condition("s", "contains", "b"), [0, 1]),
    (Condition("s", "contains", ""), [0, 1, 2, 3, 4]), (Condition("s", "notContains", "b"), [2, 3, 4]),
    (Condition("s", "isEmpty"), [2, 3, 4]), (Condition("s", "isNotEmpty"), [0, 1]),
])
def test_text_conditions(spark, cond, want):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(["ab", "abc", "", None, " / "])], "i int, s string")
    assert sorted(r["i"] for r in filters.filter_rows(df, [cond]).collect()) == want


def test_condition_migration():
    assert filters.migrate_condition(Condition("s", "between", "80,90")) == Condition("s", "between", "", "80", "90")
    odd = Condition("s", "between", "1,000,2,000")
    assert filters.migrate_condition(odd) == odd


def test_filter_summary_and_fallback(spark):
    df = numbers_frame(spark, [1, 2, 3, 4])
    r = filters.filter_summary(df, [Condition("v", "gt", "3")], {"v"}).first()
    assert tuple(r) == (4, 1, 0.75, 1)
    assert tuple(filters.filter_summary(df, []).first()) == (4, 4, 0.0, 0)
    nothing = [Condition("v", "gt", "9")]
    assert filters.filter_rows(df, nothing, {"v"}).count() == 0
    assert filters.filter_rows(df, nothing, {"v"}, on_empty="keep").count() == 4


# ---- groups, correlation -------------------------------------------------------------
def test_groups(table):
    df = table(["d", "m"], [["A ", "10"], ["A", "20"], ["", "5"], [None, "7"], ["-", "1"], ["B", "x"], ["C", ""]])
    got = groups.group_by_dimension(df, "m", "d").collect()
    assert [(r["dimension_value"], r["count"], r["mean"]) for r in got] == [("A", 2, 15.0), ("(空值)", 2, 6.0), ("-", 1, 1.0)]


def test_group_ties_in_chinese_order(table):
    df = table(["d", "m"], [["王", "1"], ["李", "1"], ["张", "1"], ["陈", "2"]])
    stats_ = groups.group_by_dimension(df, "m", "d")
    got = [r["dimension_value"] for r in groups.sort_groups(stats_, "mean").collect()]
    assert got == ["陈", "李", "王", "张"]
    assert [r["dimension_value"] for r in groups.top_groups(stats_, 2).collect()] == ["陈", "李"]


def test_correlation_guards(spark):
    rows_ = [(1.0, 2.0, 5.0, None), (2.0, 4.0, 5.0, 1.0), (3.0, 6.0, 5.0, None), (4.0, 8.5, 5.0, None), (5.0, 9.0, 5.0, None)]
    df = spark.createDataFrame(rows_, "a double, b double, c double, d double")
    got = {(r["field_a"], r["field_b"]): r for r in correlation.correlation_pairs(df, ["a", "b", "c", "d"]).collect()}
    assert got["a", "b"]["strength"] == "strong" and got["a", "b"]["direction"] == "positive"
    assert got["a", "c"]["pearson"] == 0.0 and got["a", "d"]["pearson"] == 0.0
    assert got["a", "b"]["listed"] and not got["a", "d"]["listed"]


def test_correlation_of_many_fields_runs_in_blocks(spark):
    names = [f"f{i}" for i in range(13)]
    df = spark.range(50).select(*[((F.col("id") * (i + 1)) % 17).cast("double").alias(n) for i, n in enumerate(names)])
    pairs = correlation.correlation_pairs(df, names)
    assert pairs.count() == 78
    matrix = correlation.correlation_matrix(pairs, names)
    assert matrix.count() == 169 and matrix.where("field_a = field_b AND pearson <> 1").count() == 0


def test_correlation_candidates_and_warnings(spark):
    df = spark.range(20).select(
        (F.col("id") + 20000).alias("serial"), F.lit(1).alias("one"), F.col("id").alias("user_id"),
        (F.col("id") % 7).alias("m"), (F.col("id") % 3).alias("n"),
    )
    got = {r["field"]: r["status"] for r in correlation.correlation_candidates(df, df.columns).collect()}
    assert got == {"serial": "high-unique-id", "one": "constant", "user_id": "high-unique-id", "m": "keep", "n": "keep"}
    kept = correlation.correlation_candidates(df, df.columns, {"serial": "metric"}).where("status = 'keep'").count()
    assert kept == 3
    assert len(correlation.correlation_warnings(correlation.correlation_candidates(df, df.columns), rows=3)) == 3
    assert correlation.correlate(df, ["one", "user_id"]).count() == 0


# ---- outliers ---------------------------------------------------------------------------
@pytest.mark.parametrize("values, status, found", [
    ([10, 11, 12, 13, 14, 15, 16, 100], "detected", [(7, "high")]),
    ([10] * 7 + [11], "insufficient_variation", []),
    ([10] * 8, "none", []),
    ([1, 2, 3, 4, 5, 1000], "insufficient_data", []),
    ([1, 2, 3, 4, 5, 1, 2, 3, 4, 5], "unsupported", []),
    ([0, 0, 0, 0, 1, 0, 0, 0, 1000], "detected", [(8, "high")]),
    ([10, 11, 12, 13, 14, 15, 16, 17], "none", []),
    ([85, 87, 100, 86, 88, 90, 85, 86, 87], "detected", [(2, "high")]),
    ([100, 101, 102, 103, 104, 105, 106, -500], "detected", [(7, "low")]),
])
def test_outlier_status_machine(spark, values, status, found):
    df = numbers_frame(spark, [float(v) for v in values])
    assert outliers.outlier_status(df, ["v"]).first()["status"] == status
    got = outliers.outlier_records(df, outliers.outlier_bounds(df, ["v"]), ["v"])
    assert [(r["_row_id"], r["direction"]) for r in got.collect()] == found


def test_outlier_roles_and_options(spark):
    df = numbers_frame(spark, [1.0, 2.0, 3.0, 50.0])
    assert outliers.outlier_status(df, ["v"], {"v": "identifier"}).first()["status"] == "unsupported"
    small = OutlierOptions(min_sample_size=4, iqr_multiplier=1.0)
    assert outliers.outlier_status(df, ["v"], options=small).first()["status"] == "detected"


def test_auto_exclusion_and_mean_change(spark):
    df = numbers_frame(spark, [50, 52, 54, 56, 58, 60, 62, -999])
    ids = outliers.excluded_ids(df, "v")
    assert [r[0] for r in ids.collect()] == [7]
    r = outliers.mean_change(df, "v", ids).first()
    assert (r["outcome"], r["remaining"], r["new_mean"]) == ("changed", 7, 56.0)
    assert outliers.mean_change(df, "v", df).first()["outcome"] == "all_excluded"
    assert outliers.mean_change(df, "v", df.limit(0)).first()["outcome"] == "unchanged"
    assert filters.exclude_rows(df, ids).count() == 7


def test_explanation_sentence(spark):
    df = numbers_frame(spark, [10, 11, 12, 13, 14, 15, 16, 100, -90])
    r = outliers.outlier_explanation(outliers.outlier_status(df, ["v"])).first()
    assert r["counts_line"] == "共有 2 条记录超出该范围：1 条高于上界，1 条低于下界"


# ---- distribution ------------------------------------------------------------------------
def test_histogram(spark):
    df = numbers_frame(spark, [0, 1, 2, 3, 10])
    got = [(r["bin"], r["count"], r["label"]) for r in distribution.histogram(df, "v", 5).orderBy("bin").collect()]
    assert got == [(0, 2, "0.0~2.0"), (1, 2, "2.0~4.0"), (2, 0, "4.0~6.0"), (3, 0, "6.0~8.0"), (4, 1, "8.0~10.0")]
    one = distribution.histogram(numbers_frame(spark, [4, 4]), "v").collect()
    assert [(r["start"], r["end"], r["count"]) for r in one] == [(4.0, 4.0, 2)]
    assert distribution.histogram(numbers_frame(spark, [None]), "v").count() == 0


@pytest.mark.parametrize("x, bin_, below, above", [(0, 0, False, False), (2, 1, False, False), (10, 4, False, False), (-1, None, True, False), (11, None, False, True)])
def test_locate_bin(spark, x, bin_, below, above):
    hist = distribution.histogram(numbers_frame(spark, [0, 1, 2, 3, 10]), "v", 5)
    r = distribution.locate_bin(hist, x).first()
    assert (r["bin"], r["below_range"], r["above_range"]) == (bin_, below, above)


def test_quartile_segments(spark):
    got = distribution.quartile_segments(numbers_frame(spark, [1, 2, 3, 4]), "v").orderBy("segment").collect()
    assert [(r["count"], r["percentage"]) for r in got] == [(1, 25.0)] * 4
    assert distribution.quartile_segments(numbers_frame(spark, [3, 3]), "v").collect()[0]["all_same"]


def test_axis_maximum(spark):
    df = numbers_frame(spark, [91.0, 12.0])
    assert distribution.axis_maximum(df, "v").first()["axis_max"] == 100.0
    assert distribution.axis_maximum(df.withColumnRenamed("v", "英语"), "英语").first()["axis_max"] == 150.0
    assert distribution.axis_maximum(numbers_frame(spark, [None]), "v").first()["axis_max"] == 100.0


# ---- time ----------------------------------------------------------------------------------
def test_time_series(table, spark):
    rows_ = [(0, "2024-01-03", "3"), (1, "2024/1/1", "x"), (2, "bad", "1"), (3, "2024-01-03", "1,000"), (4, "", "2")]
    df = spark.createDataFrame(rows_, "_row_id bigint, t string, v string")
    got = [(r["_row_id"], r["value"]) for r in timeseries.time_series(df, "t", "v").collect()]
    assert got == [(1, None), (0, 3.0), (3, 1000.0)]
    q = timeseries.time_series_quality(df, "t", "v").first()
    assert tuple(q) == (3, 2, 1, 1)


def test_previous_day_skips_missing_days_and_zero_bases(spark):
    days = spark.createDataFrame(
        [("s", "2024-01-01", 100.0, 0), ("s", "2024-01-05", 80.0, 4), ("t", "2024-01-02", 5.0, 1)],
        "source_system string, dt string, total_sales double, total_orders int",
    )
    got = {(r["source_system"], r["dt"]): r for r in timeseries.compare_previous_day(days, ["total_sales", "total_orders"]).collect()}
    r = got["s", "2024-01-05"]
    assert (r["comparison_date"], r["total_sales_percent"], r["total_orders_percent"]) == ("2024-01-01", -20.0, None)
    assert not got["t", "2024-01-02"]["comparison_available"]


# ---- samples and lookup ---------------------------------------------------------------------
@pytest.mark.parametrize("n, size", [(10, 3), (10, 4), (5001, 5000), (7, 7), (5, 9), (10, 1), (10, 2), (1, 1), (20001, 5000), (10, 0)])
def test_systematic_sample(spark, n, size):
    if size <= 0:
        want = []
    elif n <= size:
        want = list(range(n))
    elif size == 1:
        want = [0]
    else:
        want = [int(i * (n - 1) / (size - 1) + 0.5) for i in range(size)]
    df = spark.range(n).select(F.col("id").alias("_row_id"))
    assert sorted(r[0] for r in sampling.systematic_sample(df, size, rows=n).collect()) == want
    assert sorted(r[0] for r in sampling.systematic_indices(spark, n, size).collect()) == want


def test_size_gate(spark):
    df = spark.range(30).select(F.col("id").alias("_row_id"))
    data, info = sampling.analysis_dataset(df, sampling.SizeGate(sample_above=10))
    assert data.count() == 10 and info.first()["status"] == "ready_sampled"
    assert sampling.analysis_dataset(df, sampling.SizeGate(reject_above=10))[1].first()["status"] == "rejected"
    assert sampling.analysis_dataset(df.limit(0))[1].first()["status"] == "no_data"
    assert sampling.analysis_dataset(df)[0].count() == 30


def test_lookup(table):
    df = table(["id", "name", "class", "day"], [
        ["2024001", "张 三", "一班", "2026-01-01"], ["2024002", "Li Si", "二班", "2026/01/02"],
        ["2024003", "Li Si", "一班", ""],
    ])
    assert lookup.lookup(df, "id", "２０２４００２", "identifier").count() == 1
    assert lookup.lookup(df, "name", "LI  SI").count() == 2
    assert lookup.lookup(df, "name", "张三").count() == 1
    assert lookup.lookup(df, "day", "20260102", "time").count() == 1
    assert lookup.lookup(df, "day", "20260102").count() == 1  # compact form drops separators
    assert lookup.lookup(df, "day", "").count() == 0
    assert lookup.lookup_combo(df, {"name": "li si", "class": "一班"}).count() == 1
    assert lookup.lookup_combo(df, {"name": " "}).count() == 3


def test_lookup_cascade(table):
    df = table(["id", "name", "note", "day"], [
        ["a1", "Ann", "x", "2026-01-01"], ["a2", "Bob", "y", "2026-01-01"], ["a3", "Bob", "x", ""],
    ])
    find = dict(id_field="id", candidates=[("name", "name")], others=["note", "name"], time_field="day")
    got = lookup.lookup_cascade(df, "bob", **find).collect()
    assert [(r["id"], r["stage"], r["stage_field"]) for r in got] == [("a2", 2, "name"), ("a3", 2, "name")]
    # two rows hold x, so the single-hit stage passes; y is found there
    assert lookup.lookup_cascade(df, "x", **find).count() == 0
    assert lookup.lookup_cascade(df, "y", **find).first()["stage_field"] == "note"
    assert lookup.lookup_cascade(df, "2026.01.01", **find).count() == 2


def test_standardize(table):
    df = table(["n", "c", "t", "x"], [["85%", " a ", "2024-01-02", "?"], ["abc", "", "no", None]])
    std = cells.standardize(df, {"n": "numerical", "c": "categorical", "t": "temporal", "x": "invalid"}, ids=[])
    first, second = std.collect()
    assert (first["n"]["type"], first["n"]["num"]) == ("numerical", 85.0)
    assert (first["c"]["type"], first["c"]["str"]) == ("categorical", "a")
    assert (first["t"]["type"], first["t"]["ms"]) == ("temporal", 1704153600000)
    assert (first["x"]["type"], first["x"]["original"]) == ("invalid", "?")
    assert [second[c]["type"] for c in "nctx"] == ["invalid", "missing", "invalid", "missing"]


# ---- verdicts --------------------------------------------------------------------------------
def test_explain_values(spark):
    df = spark.createDataFrame([(float(i), float(i), float(i), None) for i in range(1, 11)], "a double, b double, c double, d double")
    got = explain.explain_values(
        df, {"a": 9.0, "b": 1.0, "c": 5.0, "d": 1.0}, rank_fields=["b"], directions={"c": "neutral"}
    )
    rows_ = {r["field"]: r for r in got.collect()}
    assert set(rows_) == {"a", "b", "c"}
    assert (rows_["a"]["percentile"], rows_["a"]["tier"], rows_["a"]["lower_count"]) == (90.0, "top10", 8)
    assert (rows_["b"]["percentile"], rows_["b"]["lower_count"]) == (100.0, 9)
    assert (rows_["c"]["percentile"], rows_["c"]["tier_label"]) == (0.0, "中性指标")
    s = explain.summarize_explanations(got).first()
    assert (s["top_fields"], s["bottom_fields"], s["field_count"], s["insufficient_data"]) == ("b,a,c", "c,a,b", 3, False)


def test_score_profiles(spark):
    df = spark.createDataFrame([(0, 90.0, 120.0, 0.0), (1, 50.0, None, None)], "_row_id bigint, x double, y double, z double")
    got = explain.score_profiles(df, {"x": 100.0, "y": 150.0, "z": 100.0}).orderBy("_row_id").collect()
    assert (got[0]["field_count"], got[0]["advantages"], got[0]["weaknesses"]) == (2, "x,y", "y,x")
    assert got[0]["average_normalized"] == pytest.approx(85.0)
    assert got[1]["advantages"] is None


@pytest.mark.parametrize("op, value, want", [
    ("gt", "2.5", [3, 4]), ("gte", "3", [3, 4]), ("lt", "2.5", [1, 2]), ("lte", "2.5", [1, 2]), ("equals", "2.5", []),
    ("equals", "3", [3]), ("gt", "1e30", []), ("lt", "1e30", [1, 2, 3, 4]), ("isEmpty", "", [None]), ("bogus", "", [1, 2, 3, 4]),
])
def test_conditions_on_whole_columns(spark, op, value, want):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "v bigint")
    got = [r[0] for r in filters.filter_rows(df, [Condition("v", op, value)], {"v"}).collect()]
    assert got == want


def test_conditions_on_doubles_skip_nan_and_infinity(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1.0,), (float("nan"),), (inf,), (-inf,), (None,)], "v double")

    def found(*c):
        return [r[0] for r in filters.filter_rows(df, [Condition("v", *c)], {"v"}).collect()]

    assert found("gt", "0") == [1.0] and found("lt", "5") == [1.0] and found("between", "0,5") == [1.0]


def test_typed_conditions_reach_the_scan(spark, tmp_path):
    spark.range(10).select(F.col("id"), F.col("id").cast("double").alias("v"), F.lit("x").alias("unused")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    kept = filters.filter_rows(df, [Condition("v", "between", "2,5"), Condition("id", "gt", "2.5")], {"v", "id"}).select("id")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,2)" in plan and "LessThanOrEqual(v,5.0)" in plan and "unused" not in plan.split("ReadSchema")[1]
    assert kept.count() == 3
