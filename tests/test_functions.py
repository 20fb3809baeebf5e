import pytest
from pyspark.sql import functions as F

from cellgrain.functions import dates, labels, numbers, text

NUMBERS = [
    ("550", "valid", 550.0), ("550.5", "valid", 550.5), (" 550 ", "valid", 550.0), ("85%", "valid", 85.0),
    ("1000%", "valid", 1000.0), ("1,234", "valid", 1234.0), ("1,234,567.8", "valid", 1234567.8),
    ("1,23", "invalid", None), ("12,34", "invalid", None), ("1,234%", "valid", 1234.0), ("%", "invalid", None),
    ("-10", "valid", -10.0), ("-1e3", "valid", -1000.0), ("+5", "valid", 5.0), (".5", "valid", 0.5), ("5.", "valid", 5.0),
    ("0", "valid", 0.0), ("0x10", "valid", 16.0), ("0b11", "valid", 3.0), ("0o17", "valid", 15.0), ("-0x10", "invalid", None),
    ("1d", "invalid", None), ("NaN", "invalid", None), ("Infinity", "invalid", None), ("1e999", "invalid", None),
    ("abc", "invalid", None), ("100abc", "invalid", None), ("1 000", "invalid", None),
    ("缺考", "invalid", None), ("转到7班", "invalid", None), ("无", "invalid", None), ("2024-01-15", "invalid", None),
    ("2024年1月1日", "invalid", None), ("2024-01-01 12:30", "invalid", None),
    ("", "empty", None), ("   ", "empty", None), ("-", "empty", None), ("—", "empty", None), ("–", "empty", None),
    ("/", "empty", None), ("\\", "empty", None), ("|", "empty", None), (None, "empty", None),
    ("　 12\t", "valid", 12.0), ("--", "invalid", None),
]


def test_parse_number(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _, _) in enumerate(NUMBERS)], "i int, c string")
    got = df.select("i", numbers.parse_number(F.col("c")).alias("p")).select("i", "p.*").orderBy("i").collect()
    assert [(r["status"], r["value"]) for r in got] == [(s, v) for _, s, v in NUMBERS]


def test_custom_status_words(spark):
    df = spark.createDataFrame([("-999",), ("12",)], "c string")
    got = [r[0] for r in df.select(numbers.number(F.col("c"), ("999",))).collect()]
    assert got == [None, 12.0]


def test_rounding_keeps_halves_up_and_huge_values(spark):
    df = spark.createDataFrame([(-2.5,), (2.5,), (1e308,), (1.00005,)], "x double")
    assert [r[0] for r in df.select(numbers.half_up(F.col("x"), 0)).collect()][:3] == [-2.0, 3.0, 1e308]
    assert df.select(numbers.half_up(F.col("x"), 4)).collect()[3][0] == pytest.approx(1.0001)


def test_dates(spark):
    cases = {
        "2024-01-02": 1704153600000, "2024/1/2": 1704153600000, "2024-02-30": None, "2024-13-01": None,
        "0050-01-01": None, "2026-04-08T10:30:00Z": 1775644200000, "2026-04-08T10:30:00+08:00": 1775615400000,
        "2026-04-08T10:30:00": 1775644200000, "20240101": None, "01/05/2024": None, "2024.1.5": None, "": None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    got = {r["c"]: r["ms"] for r in df.select("c", dates.parse_date_ms(F.col("c")).alias("ms")).collect()}
    assert got == cases
    wide = spark.createDataFrame([("2024.1.5",), ("2024年1月5日",), ("1/5/2024",), ("2024-01-05 00:00",), ("x",)], "c string")
    assert [r[0] for r in wide.select(dates.temporal_ms(F.col("c"))).collect()] == [1704412800000] * 4 + [None]


def test_text_normalisers(spark):
    df = spark.createDataFrame([("　ＡＢ１ － ｃ． x ",)], "c string")
    got = df.select(
        text.loose(F.col("c")), text.compact(F.col("c")), text.digits_only(F.col("c"))
    ).first()
    assert tuple(got) == ("ab1 - c. x", "ab1cx", "1")


def test_similarity(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("a", "a"), ("", "x"), ("", "")], "a string, b string")
    got = [r[0] for r in df.select(text.similarity_ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [pytest.approx(1 - 3 / 7), 1.0, 0.0, 1.0]


def test_labels(spark):
    df = spark.createDataFrame([(-999.0, 0.0), (50.0, 3.5), (50.0, -9.0)], "v double, z double")
    got = df.select(labels.outlier_strategy(F.col("v"), F.col("z")), labels.outlier_class(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [("auto-exclude", "extremeLow"), ("mark", "extremeHigh"), ("keep", "extremeHigh")]
    p = spark.createDataFrame([(90.0,), (75.0,), (25.0,), (10.0,), (9.9,)], "p double")
    assert [r[0] for r in p.select(labels.tier(F.col("p"))).collect()] == ["top10", "top25", "middle", "bottom25", "bottom10"]


def test_zone_less_times_do_not_depend_on_the_session_zone(spark):
    from cellgrain.operators.stats import time_range

    df = spark.sql("SELECT timestamp_ntz'2024-01-30 23:26:16.2209' AS ts UNION ALL SELECT timestamp_ntz'1969-12-31 23:59:59.5'")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        r = time_range(df, "ts").first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert (r["min_ms"], r["max_ms"], r["min_date"], r["max_date"]) == (-500, 1706657176220, "1969-12-31", "2024-01-30")
