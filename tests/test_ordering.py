import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrain.operators import distribution, groups, ordering, outliers, stats


@pytest.fixture
def skewed(spark):
    """A third of all rows hold one value, and one key holds most rows."""
    rng = random.Random(7)
    rows = [
        (i, "hot" if i % 3 else rng.choice("abcd"), 5.0 if i % 3 == 0 else round(rng.lognormvariate(2, 1), 2))
        for i in range(1500)
    ]
    return spark.createDataFrame(rows, "_row_id bigint, k string, v double")


def _by_key(df):
    out = {}
    for r in df.select("k", "v").collect():
        out.setdefault(r["k"], []).append(r["v"])
    return out


def test_range_path_gives_exact_quantiles(skewed, large_path):
    names = {"q0": 0.0, "q1": 0.25, "q5": 0.5, "q95": 0.95, "q100": 1.0}
    got = ordering.quantiles(skewed, ["k"], "v", names, aggs=[F.count("v").alias("n")])
    for r in got.collect():
        want = np.quantile(_by_key(skewed)[r["k"]], list(names.values()))
        assert [r[n] for n in names] == pytest.approx(list(want))
    whole = ordering.quantiles(skewed, [], "v", names).first()
    assert list(whole) == pytest.approx(list(np.quantile([r["v"] for r in skewed.collect()], list(names.values()))))


def test_weighted_quantiles_match_plain_ones(skewed, large_path):
    counts = ordering.value_counts(skewed, ["k"], "v")
    names = {"a": 0.25, "b": 0.9}
    weighted = {r["k"]: (r["a"], r["b"]) for r in ordering.quantiles(counts, ["k"], "v", names, weight="n_equal").collect()}
    plain = {r["k"]: (r["a"], r["b"]) for r in ordering.quantiles(skewed, ["k"], "v", names).collect()}
    assert weighted.keys() == plain.keys()
    for k in plain:
        assert weighted[k] == pytest.approx(plain[k])


def test_key_without_numbers_is_kept(spark, large_path):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "k string, v double")
    got = {r["k"]: r["m"] for r in ordering.quantiles(df, ["k"], "v", {"m": 0.5}).collect()}
    assert got == {"a": 1.0, "b": None}


def test_no_limits_needed_for_small_tables(skewed):
    assert ordering.range_limits(skewed, F.col("v"), 10) == []


def test_ranks_with_a_hot_value(skewed, large_path):
    values = np.array([r["v"] for r in skewed.orderBy("_row_id").collect()])
    got = distribution.ranked_records(skewed, "v").orderBy("_row_id").collect()
    assert len(got) == len(values)
    for r, v in zip(got, values):
        assert r["percentile"] == pytest.approx((values <= v).mean() * 100, abs=1e-4)
        assert r["best_rank"] == (values > v).sum() + 1
        assert r["worst_rank"] == (values >= v).sum()


def test_rows_without_a_number_stay_in_ranked_records(spark, large_path):
    df = spark.createDataFrame([(1, "3"), (2, "x"), (3, None), (4, "3")], "id int, v string")
    got = {r["id"]: r["percentile"] for r in distribution.ranked_records(df, "v").collect()}
    assert got == {1: 100.0, 2: None, 3: None, 4: 100.0}


def test_cdf_range_path(skewed, large_path):
    values = np.array([r["v"] for r in skewed.collect()])
    got = {r["value"]: r["percentile"] for r in distribution.cdf(skewed, "v").collect()}
    assert got == {v: pytest.approx((values <= v).mean() * 100) for v in set(values)}


def test_row_numbers_large_path_is_a_permutation_in_order(skewed, large_path):
    got = ordering.row_numbers(skewed.drop("_row_id"), ["v"]).orderBy("_row_id").collect()
    assert [r["_row_id"] for r in got] == list(range(1500))
    assert [r["v"] for r in got] == sorted(r["v"] for r in got)


def test_positions_of_many_inputs(spark, skewed, large_path):
    values = np.array([r["v"] for r in skewed.collect()])
    asked = spark.createDataFrame([(i, x) for i, x in enumerate([5.0, 5.0, -1.0, 7.25, 1e9])], "i int, x double")
    got = {r["i"]: r for r in stats.positions(skewed, "v", asked).collect()}
    assert len(got) == 5
    for i, x in enumerate([5.0, 5.0, -1.0, 7.25, 1e9]):
        assert got[i]["higher_count"] == (values > x).sum()
        assert got[i]["equal_count"] == (values == x).sum()
        assert got[i]["percentile"] == pytest.approx((values <= x).mean() * 100)
    assert got[2]["out_of_range_direction"] == "below" and got[4]["out_of_range_direction"] == "above"
    assert not got[3]["is_out_of_range"]


def test_group_statistics_agree_on_both_paths(skewed, monkeypatch):
    small = {r["dimension_value"]: r for r in groups.group_by_dimension(skewed, "v", "k").collect()}
    monkeypatch.setattr(ordering, "SINGLE_TASK_ROWS", 0)
    monkeypatch.setattr(ordering, "ROWS_PER_RANGE", 100)
    large = {r["dimension_value"]: r for r in groups.group_by_dimension(skewed, "v", "k").collect()}
    assert small.keys() == large.keys()
    for k in small:
        assert tuple(large[k])[1:] == pytest.approx(tuple(small[k])[1:])


def test_outliers_agree_on_both_paths(skewed, monkeypatch):
    def ids():
        b = outliers.outlier_bounds(skewed, ["v"])
        return {r["_row_id"] for r in outliers.outlier_records(skewed, b, ["v"]).collect()}

    small = ids()
    monkeypatch.setattr(ordering, "SINGLE_TASK_ROWS", 0)
    monkeypatch.setattr(ordering, "ROWS_PER_RANGE", 100)
    assert small and ids() == small


def test_brackets_and_ranges_agree_with_numpy(spark, monkeypatch):
    """Keys above and below the whole-key limit, a hot value, far outliers."""
    monkeypatch.setattr(ordering, "SINGLE_TASK_ROWS", 0)
    monkeypatch.setattr(ordering, "ROWS_PER_RANGE", 5000)
    i = F.col("id")
    v = (
        F.when(i % 3 == 0, 5.0).when(i % 1001 == 0, 1e12)
        .otherwise(F.exp(F.pmod(F.xxhash64(i), F.lit(100000)) / 20000.0))
    )
    df = spark.range(30000).select(F.when(i % 10 < 9, "big").otherwise("small").alias("k"), v.alias("v"))
    names = {"q0": 0.0, "q1": 0.25, "q2": 0.4, "q5": 0.5, "q95": 0.95, "q100": 1.0}
    want = {k: list(np.quantile(x, list(names.values()))) for k, x in _by_key(df).items()}
    near = ordering._narrowed_quantiles(df, ["k"], "v", names)
    assert near is not None
    through = ordering._ranged_quantiles(df, ["k"], "v", names, None, False, 30000)
    for got in (near, through, ordering.quantiles(df, ["k"], "v", names)):
        rows = {r["k"]: [r[n] for n in names] for r in got.collect()}
        assert rows == {k: pytest.approx(x) for k, x in want.items()}


def test_too_many_keys_or_a_missed_rank_use_the_ranges(spark, skewed, large_path, monkeypatch):
    monkeypatch.setattr(ordering, "MAX_BRACKET_KEYS", 1)
    assert ordering._narrowed_quantiles(skewed, ["k"], "v", {"m": 0.5}) is None
    got = {r["k"]: r["m"] for r in ordering.quantiles(skewed, ["k"], "v", {"m": 0.5}).collect()}
    assert got == {k: pytest.approx(float(np.median(x))) for k, x in _by_key(skewed).items()}
    monkeypatch.setattr(ordering, "MAX_BRACKET_KEYS", 100)
    monkeypatch.setattr(ordering, "WHOLE_KEY_ROWS", 0)
    monkeypatch.setattr(ordering, "BRACKET", 0.0)
    # brackets without width lose the upper neighbour of an interpolated rank
    wide = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    assert ordering._narrowed_quantiles(wide, [], "v", {"m": 0.5}) is None
    assert ordering.quantiles(wide, [], "v", {"m": 0.5}).first()[0] == 499.5


def test_planning_sizes_grow_with_the_table_and_show_in_no_result(spark):
    from cellgrain.plans import overview

    df = spark.range(40).selectExpr("if(id % 4 = 0, null, concat('k', id % 3)) AS kind", "timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id % 7 AS int)) AS at")
    for assumed, least, planned in ((10, True, 40), (100, True, 100), (10, False, 10)):
        with ordering.assuming(assumed, least):
            assert ordering.count_rows(df) == planned and ordering.count_rows(df, 7) == 7
    with ordering.assuming(5_000_000):
        got = {r.field: (r["count"], r.valid_count, r.missing_count) for r in overview.dataset_profile(df).collect()}
    assert got == {"kind": (40, 30, 10), "at": (40, 40, 0)}


def test_catalog_plans_at_scale_for_the_rows_there_are(spark, monkeypatch):
    from catalog import base

    seen = []
    monkeypatch.setitem(base.QUERIES, "sized", lambda spark, sf: seen.append(ordering.count_rows(spark.range(3_000_000))))
    monkeypatch.setitem(base.ORACLES, "sized", "SELECT 1")
    monkeypatch.setitem(base.QUERIES, "sized_at_scale", None)
    monkeypatch.setitem(base.ORACLES, "sized_at_scale", None)
    base.at_scale("sized")
    base.QUERIES["sized_at_scale"](spark, "")
    assert seen == [3_000_000]


def test_answered_rows_share_no_task(spark):
    i = F.col("id")
    df = spark.range(0, 4000, 1, 4).select("id", F.when(i % 10 == 0, F.lit(None)).when(i % 10 == 1, i).otherwise(i % 2).cast("double").alias("v"))
    marks = df.where("v IS NOT NULL").groupBy(F.col("v").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(held, ("false", "-1"), strict=True):
            spark.conf.set(k, v)
        got = ordering.attach_by_value(df, F.col("v"), marks, "m", F.col("n") > 100, ["n"]).select("*", F.spark_partition_id().alias("part")).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    times = {}
    for r in got:
        times[r.v] = times.get(r.v, 0) + (r.v is not None)
    assert sorted(r.id for r in got) == list(range(4000)) and all(r.n == (times[r.v] or None) for r in got)
    sizes = [sum(r.part == p for r in got) for p in {r.part for r in got}]
    assert len(sizes) == 8 and max(sizes) < 1000
