"""Operators on many columns, fields or keys at once, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrain.operators import correlation, ordering, outliers
from cellgrain.plans import explain, locator, overview, profile


def pairwise(x):
    """n and r of every pair of columns over their complete rows."""
    out = {}
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            ok = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b = x[ok, i], x[ok, j]
            with np.errstate(all="ignore"):
                r = np.corrcoef(a, b)[0, 1] if len(a) >= 2 and a.min() < a.max() and b.min() < b.max() else 0.0
            out[i, j] = (len(a), r)
    return out


def frame(spark, x):
    rows = [tuple(None if np.isnan(v) else float(v) for v in row) for row in x]
    return spark.createDataFrame(rows, ", ".join(f"`c {k}` double" for k in range(x.shape[1])))


@pytest.mark.parametrize("block", [400, 20])
def test_correlation_of_many_columns(spark, monkeypatch, block):
    monkeypatch.setattr(correlation, "BLOCK", block)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 60)) + rng.normal(size=(300, 60))
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 7] = 3.25  # constant
    x[:, 8] += 1e9  # a large offset
    x[:, 9] = np.where(np.arange(300) < 150, 5.0 + 1e-7 * x[:, 0], x[:, 9])
    x[:150, 10] = np.nan
    x[150:, 11] = np.nan  # never together with column 10
    x[:, 12] = np.where(np.isnan(x[:, 11]), x[:, 12], 2.5)  # constant where column 11 is there
    x[:, 13] = np.nan
    got = {(r.i, r.j): (r.valid_count, r.r) for r in correlation.correlation_pairs(frame(spark, x), [f"c {k}" for k in range(60)]).collect()}
    want = pairwise(x)
    assert got.keys() == want.keys()
    for k, (n, r) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(r, abs=1e-6), k


def test_correlation_of_two_hundred_columns(spark):
    x = np.random.default_rng(4).normal(size=(200, 200)).cumsum(axis=1)
    got = {(r.i, r.j): r.r for r in correlation.correlation_pairs(frame(spark, x), [f"c {k}" for k in range(200)]).collect()}
    want = np.corrcoef(x.T)
    assert len(got) == 19900
    assert all(abs(r - want[k]) < 1e-9 for k, r in got.items())


@pytest.mark.parametrize("few", [0, 8])
def test_correlation_of_huge_numbers_and_few_columns(spark, monkeypatch, few):
    monkeypatch.setattr(correlation, "FEW", few)
    y = np.random.default_rng(8).normal(size=(50, 5))
    y[:, 1] += y[:, 0]
    y[:20, 2], y[20:, 3], y[:, 4] = np.nan, np.nan, 2.5
    got = {(r.i, r.j): (r.valid_count, r.r) for r in correlation.correlation_pairs(frame(spark, y), [f"c {k}" for k in range(5)]).collect()}
    assert got == {k: (n, pytest.approx(r, abs=1e-9)) for k, (n, r) in pairwise(y).items()}


def test_correlation_of_numbers_near_the_limit(spark, monkeypatch):
    monkeypatch.setattr(correlation, "FEW", 0)
    x = np.array([[1e308, 2e307], [-1e308, -3e307], [5e307, 1e307], [0.0, 5e306]])
    got = correlation.correlation_pairs(frame(spark, x), ["c 0", "c 1"]).first()
    assert got.r == pytest.approx(np.corrcoef((x / 1e307).T)[0, 1])
    assert correlation.correlation_pairs(frame(spark, x), ["c 0"]).count() == 0


@pytest.mark.parametrize("large", [False, True])
def test_profiles_of_all_records(spark, monkeypatch, large):
    if large:
        monkeypatch.setattr(ordering, "SINGLE_TASK_ROWS", 0)
        monkeypatch.setattr(ordering, "ROWS_PER_RANGE", 40)
    rng = np.random.default_rng(5)
    n = 400
    x = np.column_stack([rng.integers(0, 5, n), rng.normal(size=n) * 1e6, np.where(rng.random(n) < 0.4, 7.0, rng.random(n)), np.full(n, np.nan)]).astype(float)
    x[rng.random(x.shape) < 0.15] = np.nan
    x[0] = np.nan
    rows = [(i % 7, *(None if np.isnan(v) else float(v) for v in row)) for i, row in enumerate(x)]  # ids repeat
    df = spark.createDataFrame(rows, "`the id` int, `a.b` double, b double, c double, d double")
    fields = ["a.b", "b", "c", "d"]
    got = explain.record_profiles(df, fields, {"b": "lower_is_better"}, ids=["the id"]).collect()
    shares = np.full(x.shape, np.nan)
    for k in range(4):
        held = x[~np.isnan(x[:, k]), k]
        for i in range(n):
            if not np.isnan(x[i, k]):
                shares[i, k] = ((held >= x[i, k]) if k == 1 else (held <= x[i, k])).mean() * 100
    want = []
    for i in range(n):
        order = sorted((-shares[i, k], k) for k in range(4) if not np.isnan(shares[i, k]))
        enough = len(order) >= 2
        want.append((i % 7, len(order), [fields[k] for _, k in order[:2]] if enough else None, [fields[k] for _, k in order[:-3:-1]] if enough else None,
                     round(float(np.nanmean(shares[i])), 6) if order else None, *(None if np.isnan(s) else round(float(s), 6) for s in shares[i])))
    have = [(r["the id"], r.field_count, r.advantages, r.weaknesses, None if r.average_percentile is None else round(r.average_percentile, 6),
             *(None if r[f"percentile_{f}"] is None else round(r[f"percentile_{f}"], 6) for f in fields)) for r in got]
    assert sorted(map(repr, have)) == sorted(map(repr, want))
    for r in got:
        if r.field_count >= 2:
            assert r.advantage_percentiles == [r[f"percentile_{f}"] for f in r.advantages]
            assert r.weakness_percentiles == [r[f"percentile_{f}"] for f in r.weaknesses]


def test_profiles_of_few_fields_gather_no_cells(spark, monkeypatch):
    i = F.col("id")
    values = [F.when(i % 7 != 0, i % 3), F.when(i % 11 != 0, i * 7919 % 1009), F.when(i % 7 != 0, (i % 2) * -0.0), F.lit(None)]
    df = spark.range(0, 3000, 1, 3).select((i % 100).alias("_row_id"), *[v.cast("double").alias(f"f{k}") for k, v in enumerate(values)])
    fields, low = [f"f{k}" for k in range(4)], {"f1": "lower_is_better"}
    monkeypatch.setattr(ordering, "SINGLE_TASK_ROWS", 0)
    got = explain.record_profiles(df, fields, low, best=3)
    # hot values stay in their row; a list per record would be sorted cell by cell
    assert "collect_list" not in got._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(explain, "FEW_FIELDS", 0)
    lists = explain.record_profiles(df, fields, low, best=3)
    assert got.columns == lists.columns and got.count() == 3000
    rows = sorted(map(repr, got.collect()))
    assert rows == sorted(map(repr, lists.collect()))
    assert {r.field_count for r in got.collect()} == {0, 1, 2, 3} and max(len(r.advantages or []) for r in got.collect()) == 3


def test_profiles_of_records_shuffle_as_often_for_many_fields(spark):
    df = spark.range(50).select(F.col("id").alias("_row_id"), *[(F.col("id") * k % 11).cast("double").alias(f"f{k}") for k in range(1, 13)])

    def exchanges(n):
        plan = explain.record_profiles(df, [f"f{k}" for k in range(1, n + 1)])._jdf.queryExecution().executedPlan().toString()
        return plan.count("Exchange hashpartitioning")

    assert exchanges(2) == exchanges(12) > 0


def test_quantiles_of_small_large_and_null_keys(spark, monkeypatch):
    monkeypatch.setattr(ordering, "SINGLE_TASK_ROWS", 0)
    monkeypatch.setattr(ordering, "ROWS_PER_RANGE", 500)
    monkeypatch.setattr(ordering, "WHOLE_KEY_ROWS", 300)
    i = F.col("id")
    key = F.when(i < 3000, F.lit(None).cast("string")).when(i < 5000, "large").otherwise(F.concat(F.lit("k"), (i % 50).cast("string")))
    value = F.when(i % 9 != 0, F.pmod(F.xxhash64(i), F.lit(1000)).cast("double"))
    df = spark.range(8000).select(key.alias("k"), value.alias("v"))
    got = ordering.quantiles(df, ["k"], "v", {"q1": 0.25, "m": 0.5, "q9": 0.9}, aggs=[F.count(F.lit(1)).alias("n"), F.max("v").alias("top")]).collect()
    held = {}
    for r in df.collect():
        held.setdefault(r.k, []).append(r.v)
    assert len(got) == len(held) == 52
    for r in got:
        v = np.array([x for x in held[r.k] if x is not None])
        assert (r.n, r.top) == (len(held[r.k]), v.max())
        assert [r.q1, r.m, r.q9] == pytest.approx(np.quantile(v, [0.25, 0.5, 0.9]))


def test_median_deviation_is_zero_where_the_quartiles_meet():
    """What lets the outlier rules do without a scan for it."""
    rng = np.random.default_rng(6)
    for _ in range(3000):
        v = rng.choice([0.0, 1.0, 1.0, 1.0, 5.0], rng.integers(2, 40))
        q1, m, q3 = np.quantile(v, [0.25, 0.5, 0.75])
        if q1 == q3:
            assert np.median(abs(v - m)) == 0


@pytest.mark.parametrize("large", [False, True])
def test_median_deviations(spark, monkeypatch, large):
    if large:
        monkeypatch.setattr(ordering, "SINGLE_TASK_ROWS", 0)
        monkeypatch.setattr(ordering, "ROWS_PER_RANGE", 40)
    v = np.random.default_rng(7).lognormal(size=500)
    df = spark.createDataFrame([(float(x), float(round(x)), None) for x in v], "a double, b double, c double")
    got = {r.field: (r.valid_count, r.median, r.mad) for r in outliers.median_deviations(df, ["a", "b", "c"]).collect()}
    for f, x in (("a", v), ("b", np.round(v))):
        assert got[f] == pytest.approx((500, np.median(x), np.median(abs(x - np.median(x)))))
    assert got["c"] == (0, None, None)


def test_bounds_without_counting_distinct_values_agree(spark):
    df = spark.range(600).select(
        F.col("id").alias("_row_id"), (F.col("id") % 5).cast("double").alias("code"), F.exp(F.col("id") / 100).alias("wide"),
        F.when(F.col("id") % 50 == 0, 99.0).otherwise(1.0).alias("flat"),
    )
    fields = ["code", "wide", "flat"]
    full, lean = (outliers.outlier_bounds(df, fields, unique=u) for u in (True, False))
    keep = [c for c in full.columns if c != "unique_count"]
    assert sorted(map(repr, full.select(keep).collect())) == sorted(map(repr, lean.select(keep).collect()))
    assert {r.field: r.unique_count for r in lean.collect()} == {"code": 5, "wide": None, "flat": None}
    by_scan = {r.field: tuple(r) for r in outliers.outlier_status(df, fields).collect()}
    assert by_scan == {r.field: tuple(r) for r in outliers.outlier_status(df, fields, bounds=full).collect()}


def test_profiles_exchange_no_cells(spark):
    df = spark.createDataFrame([("some text", 1.5, "x"), (None, None, "")], "t string, n double, u string")
    plan = profile.column_counts(df)._jdf.queryExecution().executedPlan().toString()
    for line in plan.split("\n"):
        if "Exchange hashpartitioning" in line:
            assert "cell" not in line
    got = {r.field: r for r in profile.column_counts(df).collect()}
    assert (got["t"].unique_all, got["t"].unique_filled, got["t"].missing, got["t"].unique_present) == (2, 1, 1, 1)


def test_sentence_names_the_whole_category(spark):
    df = spark.createDataFrame([("x=5; y",)] * 30 + [("z",)] * 3, "kind string")
    got = overview.dataset_profile(df).first()
    assert got.insight == "2 个类别，最多为 x=5; y × 30" and got.top_categories == "x=5; y=30; z=3"


def test_locator_report_shows_samples_ability_and_scanned_columns(spark):
    rows = [(i, f"A{i:05d}", ["甲班", "乙班", " "][i % 3]) for i in range(30)]
    df = spark.createDataFrame(rows, "row int, `学号` string, `班级` string")
    got = {r.field: r for r in locator.locator_report(df, "A00003", ["学号", "班级"], row_id="row").collect()}
    assert got["学号"].sample_values == ["A00000", "A00001", "A00002"] and got["班级"].sample_values == ["甲班", "乙班"]
    assert (got["学号"].ability, got["班级"].ability) == ("named_unique", "named_group")
    assert {r.scanned_fields for r in got.values()} == {2} and got["学号"].matched_count == 1
    assert locator.locator_report(df, " ", ["学号"]).first().matched_count == 0


def test_a_new_rule_is_a_line_in_the_table(spark):
    from cellgrain.plans import legacy, rules, schema
    from cellgrain.plans.rules import FieldRule

    counts = profile.column_counts(spark.createDataFrame([(f"x{i}", float(i)) for i in range(20)], "zone string, depth double"))
    plain = {r.field: r for r in schema.infer_schema(counts).collect()}
    assert plain["zone"].role == "description" and plain["depth"].role == "metric"
    more = (*rules.GENERIC_RULES, FieldRule(5, ("category", "dimension", "neutral", "name_rule", "high"), ('zone: "{word}" {unique_ratio}',), words=("zone",)),
            FieldRule(6, ("number", "metric", "higher_is_better", "structure", "low"), ("many numbers",), bounds=(("numeric_ratio", ">", 0.9),)))
    got = {r.field: r for r in schema.infer_schema(counts, table=more).collect()}
    assert (got["zone"].role, got["zone"].reasons) == ("dimension", ['zone: "zone" 100%'])
    assert (got["depth"].direction, got["depth"].confidence, got["depth"].reasons) == ("higher_is_better", "low", ["many numbers"])
    old = {r.field: (r.type, r.reason) for r in legacy.classify_fields(counts, (*rules.LEGACY_RULES, FieldRule(0, ("score", 0.9), ("{field} is a score",), words=("depth",)))).collect()}
    assert old["depth"][0] == "score" and old["depth"][1].startswith("depth is a score") and old["zone"][0] == "text"
