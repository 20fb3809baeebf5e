"""Queries that return every row, column and section, against plain Python on the smallest tables."""

import os

import numpy as np
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def column(table, name):
    return pq.read_table(f"{SF}/{table}.parquet", columns=[name])[name].to_pylist()


def names(table):
    return pq.read_schema(f"{SF}/{table}.parquet").names


def rows(spark, name, *key):
    got = contract.queries()[name](spark, SF).collect()
    held = {tuple(r[k] for k in key): r for r in got}
    assert len(held) == len(got)
    return held


def test_overview_has_every_column(spark):
    got = rows(spark, "dataset_overview_whole", "field")
    assert {r.ordinal: f for (f,), r in got.items()} == dict(enumerate(names("events")))
    assert got["ts",].feature_type == "temporal"
    for field in ("user_id", "value"):
        v, r = np.array(column("events", field), dtype=float), got[field,]
        q1, q3 = np.quantile(v, [0.25, 0.75])
        out = int(((v < q1 - 1.5 * (q3 - q1)) | (v > q3 + 1.5 * (q3 - q1))).sum())
        assert (r.feature_type, r.row_count, r.missing_count, r.outlier_count) == ("numerical", len(v), 0, out)
        assert r.outlier_status == ("detected" if out else "none")
        assert np.allclose([r.mean, r.std, r.q1, r.q3], [v.mean(), v.std(), q1, q3], atol=1e-4)


def test_locator_has_every_column(spark):
    got = rows(spark, "locator_fields_whole", "field")
    assert {r.ordinal: f for (f,), r in got.items()} == dict(enumerate(["学号", "班级", "日期", "余额", "key"]))
    balances, keys = column("customer", "c_acctbal"), column("customer", "c_custkey")
    texts = [str(int(x)) if x == int(x) else str(x) for x in balances]
    code = sum(3 <= len(t) <= 30 and t[0] != "-" for t in texts) / len(texts) >= 0.5
    r = got["余额",]
    assert (r.non_empty, r.unique_count) == (len(balances), len(set(balances)))
    assert code and len(set(balances)) / len(balances) >= 0.9  # a code in nearly every row: an identifier by content
    assert (r.semantic, r.confidence, r.is_candidate) == ("identifier", 0.78, True)
    assert got["key",].unique_count == len(set(keys))
    report = rows(spark, "locator_report_whole", "field")
    assert {f for f, in report} == {f for (f,), r in got.items() if r.is_candidate}
    assert {f: r.matched_count for (f,), r in report.items()} == {
        "学号": 0, "班级": column("customer", "c_mktsegment").count("BUILDING"), "日期": 0, "余额": 0}


def test_summary_sheet_has_every_metric_section_and_row(spark):
    got = rows(spark, "summary_sheet_whole", "metric", "section", "ord")
    asked = {"l_quantity": (30, 1), "l_extendedprice": (50000, -1), "l_discount": (None, 0)}
    shown = {m: {s: sorted(o for n, t, o in got if n == m and t == s) for s in ("field", "stats", "position", "interpretation")} for m in asked}
    for metric, (x, sign) in asked.items():
        v = np.array(column("lineitem", metric))
        assert shown[metric] == {"field": [0], "stats": list(range(11)), "position": list(range(10)) if sign else [],
                                 "interpretation": list(range(6 if sign else 7))}
        value = lambda section, i: float(got[metric, section, i].value)  # noqa: B023, E731
        want = [len(v), 0, len(v), v.mean(), np.median(v), v.min(), v.max(), *np.quantile(v, [0.25, 0.75, 0.9, 0.95])]
        assert np.allclose([value("stats", i) for i in range(11)], want)
        if sign:
            high, same, low = int((v > x).sum()), int((v == x).sum()), int((v < x).sum())
            before, after = (high, low) if sign > 0 else (low, high)
            want = [len(v), high, same, low, before + 1, before + same, before + 1, (after + same) / len(v) * 100]
            assert np.allclose([value("position", i) for i in range(8)], want)
            assert [got[metric, "position", i].value for i in (8, 9)] == ["是" if same else "否", "否"]


@pytest.mark.parametrize("table, time", [("orders", "o_orderdate"), ("events", "ts")])
def test_time_columns_are_profiled(spark, table, time):
    cells = column(table, time)
    for name in ("column_profile", "feature_types", "infer_schema", "legacy_fields"):
        got = rows(spark, f"{name}_{table}_whole", "ordinal")
        assert [got[i,].field for i in range(len(got))] == names(table)
    r = rows(spark, f"column_profile_{table}_whole", "field")[time,]
    assert (r.total, r.filled, r.temporal, r.unique_filled, r.missing, r.numeric) == (len(cells), len(cells), len(cells), len(set(cells)), 0, 0)
    assert rows(spark, f"feature_types_{table}_whole", "field")[time,].feature_type == "temporal"
    r = rows(spark, f"infer_schema_{table}_whole", "field")[time,]
    assert (r.data_type, r.role, r.direction) == ("datetime", "time", "neutral")
    r = rows(spark, f"legacy_fields_{table}_whole", "field")[time,]  # the older metadata know no times: texts that rarely repeat
    assert (r.type, r.valid_count) == ("text", 0) and len(set(cells)) / len(cells) >= 0.2
