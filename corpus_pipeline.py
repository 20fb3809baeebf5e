"""From raw documents to token ids: five stages, each an operator of cellgrain.llm on all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrain.llm.common import load, settle
from cellgrain.llm.decontamination import decontaminate
from cellgrain.llm.line_dedup import dedup_lines
from cellgrain.llm.near_dedup import drop_near_duplicates
from cellgrain.llm.piece_lattice import encode
from cellgrain.llm.quality import filter_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return filter_quality(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more of them share; n_chars follows the text."""
    kept = dedup_lines(docs, min_documents=10, min_chars=1).drop("n_lines", "n_dropped")
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near duplicates."""
    return drop_near_duplicates(docs, threshold=0.8)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate(docs, load(spark, sf_dir, "benchmark"), threshold=0.8)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids and n_tokens of every document."""
    ids = encode(docs)
    return ids.select("doc_id", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"))


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near dedup", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("token ids", tokens),
]

#: Expectation-maximisation, signatures and merges are beyond SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
