"""Stored directories and states, most frequent values, batch lookups."""

import random
import re
from collections import Counter
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from cellgrain.operators import lookup, stats, timeseries
from cellgrain.operators.sampling import sample_index
from cellgrain.sources import pages


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('pages')}/t"
    df = spark.range(1000).select(((F.col("id") * 377) % 1000).alias("k"), F.lit("x").alias("a b"))
    pages.write_pages(df, ["k"], path, parts=7)
    return path


@pytest.mark.parametrize("number", [0, 17, 49, 50, 10_000])
def test_pages_are_read_from_their_own_ranges(spark, stored, number):
    got = pages.read_page(spark, stored, number, 20)
    want = list(range(number * 20, min(1000, number * 20 + 20)))
    assert [(r._row_id, r.k) for r in got.collect()] == [(i, i) for i in want]
    assert got.columns == ["k", "a b", "_row_id"]
    # a page may cross from one range to the next; the scan is told which
    assert 1 <= len(asked_ranges(got)) <= 2


def asked_ranges(df):
    """Numbers in the partition filter of the scan of rows."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    held = re.search(r"PartitionFilters: \[[^\]]*?_part#\d+L? (?:IN \(([-\d,]+)\)|= (-?\d+))", plan)
    return (held[1] or held[2]).split(",")


@pytest.mark.parametrize("size", [1, 2, 3, 9, 333, 999, 1000, 5000])
def test_samples_of_a_stored_table(spark, stored, size):
    got = sorted(r._row_id for r in pages.read_sample(spark, stored, size).collect())
    if size >= 1000:
        want = list(range(1000))
    else:
        want = [0] if size == 1 else [(2 * i * 999 + size - 1) // (2 * (size - 1)) for i in range(size)]
    assert got == want
    if size == 3:
        assert len(asked_ranges(pages.read_sample(spark, stored, size))) == 3


def test_sample_positions_of_huge_tables(spark):
    from cellgrain.operators.sampling import is_sampled

    rows, size = 10**16 + 7, 1_000_003
    step = [0, 1, 2, 499_999, 1_000_001, 1_000_002]
    at = [(2 * i * (rows - 1) + size - 1) // (2 * (size - 1)) for i in step]
    df = spark.createDataFrame([(i, p) for i, p in zip(step, at, strict=True)], "i long, p long")
    for r in df.select("p", sample_index(F.col("i"), rows, size).alias("q"), is_sampled(F.col("p"), rows, size).alias("yes"), is_sampled(F.col("p") + 1, rows, size).alias("no")).collect():
        assert r.q == r.p and r.yes and not r.no


def test_states_merge_to_the_same_counts(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab") if rng.random() < 0.9 else None, date(2024, 1, 1) + timedelta(rng.randrange(70)), rng.randrange(10**6), rng.choice([None, 5, 70_000, rng.randrange(200)]),
             float(rng.randrange(100)), 1.0) for _ in range(600)]
    df = spark.createDataFrame(rows, "s string, d date, o long, c long, v double, q double")
    named = dict(source=F.col("s"), day=F.col("d"), order_id=F.col("o"), customer=F.col("c"), sales=F.col("v"), quantity=F.col("q"))
    states = [timeseries.day_state(df.where(F.col("o") % 4 == k), **named) for k in range(4)]
    state = timeseries.merge_states(timeseries.merge_states(*states[:2]), *states[2:])
    for period, of, by_source in ((None, lambda r: r[1], True), (F.date_format("dt", "yyyy-MM"), lambda r: f"{r[1]:%Y-%m}", True), (F.lit("all"), lambda r: "all", False)):
        want = {}
        for r in rows:
            held = want.setdefault((r[0] if by_source else "-", of(r)), [0.0, set(), set(), 0.0])
            held[0] += r[4]
            held[1].add(r[2])
            held[2] |= {r[3]} - {None}
            held[3] += r[5]
        got = timeseries.overview_of_state(state, period, by_source).collect()
        assert {(r.source_system if by_source else "-", r.period): [r.total_sales, r.total_orders, r.total_customers, r.total_quantity] for r in got} == {
            k: [v, len(o), len(c), q] for k, (v, o, c, q) in want.items()}


def test_states_of_thin_days_stay_small(spark):
    # every number lies far from the others of its day, or at the edge of a bitmap
    ids = [i * 40_000 for i in range(300)] + [63, 64, 127, -1, -63, -64, -65, 2**63 - 1, -(2**63)]
    rows = [("a", date(2024, 1, 1) + timedelta(k % 5), i, -i - 1, 1.0, 2.0) for k, i in enumerate(ids * 2)]
    df = spark.createDataFrame(rows, "s string, d date, o long, c long, v double, q double")
    named = dict(source=F.col("s"), day=F.col("d"), order_id=F.col("o"), customer=F.col("c"), sales=F.col("v"), quantity=F.col("q"))
    state = timeseries.merge_states(timeseries.day_state(df.where("o % 2 = 0"), **named), timeseries.day_state(df.where("o % 2 <> 0"), **named))
    sizes = [len(r[0]) for r in state.select(F.to_json(F.struct("bits"))).collect()]
    assert len(sizes) <= 2 * len(rows) + 5 and sum(sizes) <= 40 * len(sizes)
    whole = timeseries.overview_of_state(state, F.lit("all"), False).first()
    assert (whole.total_orders, whole.total_customers, whole.total_sales, whole.total_quantity) == (len(ids), len(ids), len(rows), 2 * len(rows))
    for r in timeseries.overview_of_state(state).collect():
        of_day = {x[2] for x in rows if x[1] == r.period}
        assert (r.total_orders, r.total_customers) == (len(of_day), len(of_day))


@pytest.mark.parametrize("shape", ["skewed", "flat", "few", "none"])
def test_most_frequent_values(spark, shape):
    rng = random.Random(1)
    values = {
        "skewed": [f"v{int(rng.paretovariate(0.7)) % 4000}" for _ in range(20_000)], "flat": [f"v{i % 3000}" for i in range(12_000)],
        "few": ["a", "b", "b", " b ", "", None, "c"], "none": ["", None],
    }[shape]
    got = stats.top_values(spark.createDataFrame([(v,) for v in values], "x string"), "x", 10, tracked=256).collect()
    times = Counter(v.strip() for v in values if v and v.strip())
    want = sorted(times.items(), key=lambda kv: (-kv[1], kv[0].encode()))[:10]
    assert sorted((r["rank"], r.value, r.n) for r in got) == [(i, v, n) for i, (v, n) in enumerate(want, 1)]


def test_batch_lookup_of_texts_without_digits(spark):
    cells = spark.createDataFrame([(1, "none"), (2, "unknown"), (3, "2024-01-05"), (4, "-")], "id int, day string")
    asked = spark.createDataFrame([("2024/1/5",), ("20240105",), ("none",), ("no day",)], "query string")
    pairs = lambda **k: sorted((r.query, r.id) for r in lookup.lookup_many(cells, "day", asked, semantic="time", **k).collect())
    assert pairs() == [("20240105", 3), ("none", 1)]
    single = sorted((q, r.id) for (q,) in asked.collect() for r in lookup.lookup(cells, "day", q, "time").collect())
    assert pairs(digitless=True) == single and ("no day", 2) in single
