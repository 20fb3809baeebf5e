"""Connected components of a graph given as an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrain.llm.common import release, settle


def _least(pairs: DataFrame) -> DataFrame:
    """Each (u, v) with the least of u and all its v. Partial minima first; a hub's rows may be split in the join."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("_u", "m").alias("m"))
    return pairs.join(least, F.col("u") == F.col("_u")).drop("_u")


def _edge(u: str, v: str):
    return F.struct(F.col(u).alias("u"), F.col(v).alias("v"))


def _all_stars(edges: DataFrame) -> bool:
    """Whether no node has two edges downward, or edges both ways."""
    ends = edges.select(F.inline(F.array(
        F.struct(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")),
        F.struct(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")),
    )))
    crossed = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 OR (down = 1 AND up = 1)")
    return not crossed.agg(F.count(F.lit(1))).first()[0]


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); a component is named by its least node.

    After Kiveris et al., "Connected components in MapReduce and beyond" (2014). Every round is written to the
    shared folder; the number of rounds grows with the logarithm of the longest path.
    """
    current = settle(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars"
    )
    while not _all_stars(current):
        before = current
        large = _least(current.select(F.inline(F.array(_edge("u", "v"), _edge("v", "u"))))).where("v > u AND v <> m")
        small = _least(large.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))
        current = settle(small.select(F.inline(F.array(_edge("v", "m"), _edge("u", "m")))).where("u <> v").distinct(), "stars")
        release(before)
    named = current.select(F.inline(F.array(
        F.struct(F.col("u").alias("node"), F.col("v").alias("component")),
        F.struct(F.col("v").alias("node"), F.col("v").alias("component")),
    )))
    out = settle(named.distinct(), "components")
    release(current)
    return out
