"""Pearson correlation of every pair of numeric fields."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cellgrain.functions import labels
from cellgrain.functions.numbers import half_up
from cellgrain.functions.text import is_blank
from cellgrain.operators.cells import number_of, ref, text_of

# Roles that never correlate, roles known to be metrics, and
# header words of identifiers.
EXCLUDED_ROLES = ("identity", "adjustment", "textMeta", "invalid", "unknown")
METRIC_ROLES = ("primaryTotal", "sectionTotal", "courseScore", "rank", "adjustment", "metric")
ID_WORDS = ("身份证号", "编号", "id", "订单", "用户", "商品", "编码")

# Warnings shown to users.
WARN_TOO_FEW_FIELDS = "可分析的数值字段不足 2 个，无法计算相关性。"
WARN_FEW_ROWS = "数据行数较少（{n} 行），相关性结果可能不稳定。"
WARN_IDS = "已排除 {n} 个标识符字段（如学号、ID等）。"
WARN_CONSTANT = "已排除 {n} 个常量字段。"

PAIR_SCHEMA = (
    "i int, j int, field_a string, field_b string, valid_count bigint, r double, "
    "pearson double, strength string, direction string, listed boolean"
)


@dataclass(frozen=True)
class CorrelationOptions:
    top_n: int = 5
    min_valid: int = 5
    strong: float = 0.7
    moderate: float = 0.3


# Columns whose co-moments are summed together: 3 * BLOCK numbers per row, (3 * BLOCK) ** 2 / 2 per task.
BLOCK = 400
# Up to so many columns the pairs of a row are fewer than what a vector of it costs.
FEW = 8
# A variance this small beside the mean square may have lost digits to the sums; such pairs are measured again.
DOUBTFUL = 1e-6


def _centres(numbers: DataFrame, fields: Sequence[str]) -> list[tuple[float, float]]:
    """A cell near the middle of each column, and the largest distance from it.  One row."""
    got = numbers.agg(*[
        F.struct(F.percentile_approx(ref(f), 0.5, 1000).alias("at"), F.min(ref(f)).alias("lo"), F.max(ref(f)).alias("hi")).alias(f"c{k}")
        for k, f in enumerate(fields)
    ]).first()
    out = []
    for c in got:
        at = c["at"] or 0.0
        far = max(abs(c["lo"] / 2 - at / 2), abs(c["hi"] / 2 - at / 2)) if c["at"] is not None else 0.0
        out.append((at, far if 0 < far < float("inf") else 1.0))
    return out


def _gram(numbers: DataFrame, fields: Sequence[str], centres: Sequence[tuple[float, float]]) -> np.ndarray:
    """Sums over all rows of the products of (value, value present, value squared) of every two columns.

    Missing values count as zeros, so each product sums over the rows where both sides are numbers.  Tasks add to one
    matrix, and matrices are added in a tree: nothing is fanned out or exchanged by key.
    """
    parts = []
    for f, (at, far) in zip(fields, centres, strict=True):
        x = F.coalesce((ref(f) - F.lit(at)) / F.lit(far), F.lit(0.0))
        parts.append((x, F.when(ref(f).isNotNull(), 1.0).otherwise(0.0), x * x))
    rows = numbers.select(array_to_vector(F.array(*[p for kind in zip(*parts, strict=True) for p in kind])).alias("v"))
    return RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "v"), 0, 3 * len(fields)).computeGramianMatrix().toArray()


def _measured(numbers: DataFrame, fields: Sequence[str], pairs: Sequence[tuple[int, int]]) -> dict[tuple[int, int], tuple[int, float]]:
    """Complete rows and r of some pairs by Spark's own covariance and variances; a row fans out to the pairs inside its task."""
    cells = numbers.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), ref(fields[i]).alias("a"), ref(fields[j]).alias("b")) for i, j in pairs
    ])))
    folded = cells.where("a IS NOT NULL AND b IS NOT NULL").groupBy("i", "j").agg(
        F.count(F.lit(1)).alias("n"), F.try_divide(F.covar_pop("a", "b"), F.sqrt(F.var_pop("a")) * F.sqrt(F.var_pop("b"))).alias("r")
    )
    found = {pair: (0, float("nan")) for pair in pairs}  # a row per pair at most
    return found | {(r["i"], r["j"]): (r["n"], float("nan") if r["r"] is None else r["r"]) for r in folded.collect()}


def _pair_values(numbers: DataFrame, fields: Sequence[str]) -> dict[tuple[int, int], tuple[int, float]]:
    """Complete rows and r of every pair (i, j) of columns."""
    if len(fields) <= FEW:
        return _measured(numbers, fields, list(combinations(range(len(fields)), 2)))
    centres = _centres(numbers, fields)
    found: dict[tuple[int, int], tuple[int, float]] = {}
    doubtful: list[tuple[int, int]] = []
    half = max(1, BLOCK // 2)
    blocks = [range(k, min(k + half, len(fields))) for k in range(0, len(fields), half)]
    together = [[*a, *b] for a, b in combinations(blocks, 2)] if len(blocks) > 1 else [list(blocks[0])]
    for columns in together:
        g, d = _gram(numbers, [fields[k] for k in columns], [centres[k] for k in columns]), len(columns)
        value, present, square = slice(0, d), slice(d, 2 * d), slice(2 * d, 3 * d)
        n, total, squares, products = g[present, present], g[value, present], g[square, present], g[value, value]
        with np.errstate(all="ignore"):
            mean, mean_square = total / n, squares / n  # [a, b]: of a, over the rows that have both
            variance = mean_square - mean**2
            r = (products / n - mean * mean.T) / np.sqrt(variance * variance.T)
            unsure = (variance <= DOUBTFUL * mean_square) & (squares > 0)
        for p, q in combinations(range(d), 2):
            pair = (columns[p], columns[q])
            found[pair] = (int(round(n[p, q])), float(r[p, q]))
            if n[p, q] >= 2 and (unsure[p, q] or unsure[q, p]):
                doubtful.append(pair)
    return found | (_measured(numbers, fields, sorted(set(doubtful))) if doubtful else {})


def correlation_pairs(
    df: DataFrame, fields: Sequence[str], options: CorrelationOptions = CorrelationOptions()
) -> DataFrame:
    """Every unordered pair with r over rows where both sides are numbers.

    Fewer than two such rows or a constant side give 0.  Up to ``FEW`` fields are folded pair by pair in one scan.  Two scans serve up to ``BLOCK``
    fields, a middle and a range of each first, then one matrix of co-moments per task; the sums of all pairs come to the
    driver, which is a number per two columns.  More fields take a scan per pair of half blocks.
    """
    fields = list(fields)
    spark = df.sparkSession
    values = _pair_values(df.select(*[number_of(df, f).alias(f) for f in fields]), fields) if len(fields) > 1 else {}
    rows = []
    for (i, j), (n, r) in sorted(values.items()):
        r = 0.0 if n < 2 or not np.isfinite(r) else max(-1.0, min(1.0, r))
        rows.append((i, j, fields[i], fields[j], n, r))
    measured = spark.createDataFrame(rows, "i int, j int, field_a string, field_b string, valid_count bigint, r double")
    return measured.select(
        "i", "j", "field_a", "field_b", "valid_count", "r",
        half_up(F.col("r"), 4).alias("pearson"),
        labels.correlation_strength(F.col("r"), options.strong, options.moderate).alias("strength"),
        labels.correlation_direction(F.col("r")).alias("direction"),
        (F.col("valid_count") >= options.min_valid).alias("listed"),
    )


def correlation_matrix(pairs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Symmetric long form ``(field_a, field_b, pearson)`` with a diagonal of 1.

    A pair becomes two rows and the diagonal comes from the first pair that names
    each field, so the pairs are computed once.
    """
    last = len(fields) - 1
    diag = F.when(
        (F.col("i") == 0) & (F.col("j") == 1),
        F.array(F.struct("field_a", F.col("field_a").alias("field_b"), F.lit(1.0).alias("pearson"))),
    ).otherwise(F.array())
    own = F.when(
        F.col("i") == 0,
        F.array(F.struct(F.col("field_b").alias("field_a"), "field_b", F.lit(1.0).alias("pearson"))),
    ).otherwise(F.array())
    cells = F.concat(
        F.array(
            F.struct("field_a", "field_b", "pearson"),
            F.struct(F.col("field_b").alias("field_a"), F.col("field_a").alias("field_b"), "pearson"),
        ),
        diag, own,
    )
    return pairs.select(F.inline(cells)) if last > 0 else pairs.select("field_a", "field_b", "pearson").limit(0)


def correlation_map(matrix: DataFrame) -> DataFrame:
    """One row per field with ``map<other field, pearson>``."""
    return matrix.groupBy("field_a").agg(
        F.map_from_entries(F.collect_list(F.struct("field_b", "pearson"))).alias("pearson")
    )


def top_pairs(pairs: DataFrame, options: CorrelationOptions = CorrelationOptions()) -> DataFrame:
    """Strongest positive, strongest negative and weakest pairs: ``(kind, rank, ...)``.

    Works on one row per pair of columns, after all data has been aggregated.
    """
    listed = pairs.where("listed")
    kinds = (
        ("positive", F.col("pearson") > 0, F.col("pearson").desc()),
        ("negative", F.col("pearson") < 0, F.col("pearson").asc()),
        ("weak", F.col("strength") == "weak", F.abs("pearson").asc()),
    )
    ranked = listed
    for name, test, order in kinds:
        w = W.partitionBy(test).orderBy(order, "i", "j")
        ranked = ranked.withColumn(f"_{name}", F.when(test, F.row_number().over(w)))
    picks = F.array(*[
        F.when(
            F.col(f"_{name}") <= options.top_n,
            F.struct(F.lit(name).alias("kind"), F.col(f"_{name}").alias("rank")),
        )
        for name, _, _ in kinds
    ])
    return ranked.select(
        F.inline(F.filter(picks, lambda p: p.isNotNull())),
        "field_a", "field_b", "pearson", "valid_count", "strength", "direction",
    )


def correlation_candidates(
    df: DataFrame, fields: Sequence[str], roles: Mapping[str, str] | None = None,
    patterns: Mapping[str, tuple[str, float]] | None = None, numeric_ratio: float | None = None,
) -> DataFrame:
    """Each field with ``status`` keep / excluded-role / high-unique-id / constant / not-numeric.

    ``roles`` gives the field's analysis role, ``patterns`` its (value pattern, unique
    ratio) when a profile is at hand.  ``numeric_ratio`` drops fields with a smaller share
    of numbers among non-blank cells.
    """
    roles, patterns = dict(roles or {}), dict(patterns or {})
    filled = df.select(
        *[number_of(df, f).alias(f) for f in fields],
        *[(~is_blank(text_of(df, f))).alias(f"{f} filled") for f in fields],
    )
    cells = filled.select(
        F.inline(F.array(*[
            F.struct(
                F.lit(k).alias("ordinal"), F.lit(f).alias("field"),
                ref(f).alias("value"), ref(f"{f} filled").alias("filled"),
            )
            for k, f in enumerate(fields)
        ]))
    )
    distinct = cells.where("value IS NOT NULL").select("ordinal", "value").distinct().groupBy("ordinal").agg(F.count(F.lit(1)).alias("_unique"))
    # one row per field on both sides; of the cells only distinct numbers with their field's number are exchanged
    stats = cells.groupBy("ordinal", "field").agg(
        F.count("value").alias("valid_count"), F.count_if("filled").alias("filled_count"), F.max("value").alias("max")
    ).join(F.broadcast(distinct), "ordinal", "left").withColumn("unique_count", F.coalesce("_unique", F.lit(0)).cast("bigint"))
    low = F.lower("field")
    named_id = F.lit(False)
    for word in ID_WORDS:
        named_id = named_id | F.contains(low, F.lit(word))
    known = F.lit(None).cast("string")
    code_like = F.lit(False)
    for f in fields:
        here = F.col("field") == f
        if f in roles:
            known = F.when(here, F.lit(roles[f])).otherwise(known)
        if f in patterns and patterns[f][0] == "longNumber" and patterns[f][1] > 0.95:
            code_like = code_like | here
    unique_ratio = F.try_divide(F.col("unique_count"), F.col("valid_count"))
    big_unique = (F.col("valid_count") >= 10) & (unique_ratio > 0.95) & (F.col("max") > 10_000)
    is_metric = F.coalesce(known.isin(*METRIC_ROLES), F.lit(False))
    share = F.coalesce(F.try_divide(F.col("valid_count"), F.col("filled_count")), F.lit(0.0))
    too_few = F.lit(False) if numeric_ratio is None else (named_id | (share < numeric_ratio))
    status = (
        F.when(known.isin(*EXCLUDED_ROLES), "excluded-role")
        .when(too_few, "not-numeric")
        .when(~is_metric & (named_id | code_like | big_unique), "high-unique-id")
        .when((F.col("valid_count") < 2) | (F.col("unique_count") <= 1), "constant")
        .otherwise("keep")
    )
    return stats.select("ordinal", "field", "valid_count", "unique_count", "max", status.alias("status"))


def correlation_warnings(candidates: DataFrame, min_valid: int = 5, rows: int | None = None) -> list[str]:
    """Messages about skipped fields; reads one small aggregate row."""
    n = candidates.agg(
        F.count_if(F.col("status") == "keep").alias("keep"),
        F.count_if(F.col("status") == "high-unique-id").alias("ids"),
        F.count_if(F.col("status") == "constant").alias("constant"),
    ).first()
    if n["keep"] < 2:
        return [WARN_TOO_FEW_FIELDS]
    out = []
    if rows is not None and rows < min_valid:
        out.append(WARN_FEW_ROWS.format(n=rows))
    if n["ids"]:
        out.append(WARN_IDS.format(n=n["ids"]))
    if n["constant"]:
        out.append(WARN_CONSTANT.format(n=n["constant"]))
    return out


def correlate(
    df: DataFrame, fields: Sequence[str], roles: Mapping[str, str] | None = None,
    options: CorrelationOptions = CorrelationOptions(), numeric_ratio: float | None = None,
) -> DataFrame:
    """Pick the usable fields, then correlate them.  Reads one row per field on the driver."""
    picked = correlation_candidates(df, fields, roles, numeric_ratio=numeric_ratio)
    keep = [r["field"] for r in picked.where("status = 'keep'").orderBy("ordinal").collect()]
    if len(keep) < 2:
        return df.sparkSession.createDataFrame([], PAIR_SCHEMA)
    return correlation_pairs(df, keep, options)


def correlate_auto(df: DataFrame, options: CorrelationOptions = CorrelationOptions()) -> DataFrame:
    """Correlate every column with at least 70 % numbers and no identifier-like name."""
    return correlate(df, df.columns, options=options, numeric_ratio=0.7)
