"""Quality rules by weak supervision: rules vote or abstain, EM finds how far to trust each, a posterior decides.

Every rule looks at counted features of the whole text and votes 1 (good), 0 (bad) or null (abstains). How often
each rule is right for good and for bad documents is estimated by expectation-maximisation over the table of
vote patterns, which has at most 3 ** rules rows at any corpus size; abstaining counts as an outcome of its own.
A document is kept where its posterior probability of being good reaches the threshold and it passes the base
test. No labels are used.

DataFrame functions only. The texts are read once: the features are written to the shared folder, patterns and
verdicts come from there.

Defined results: a null, empty or blank text has no words and fails the base test. Rows are judged one by one,
so repeated rows agree. An empty table fits the starting accuracies and returns no rows. Added columns replace
columns of the same name; others pass.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrain.llm.common import BLANK, load, only, packed, query, settle, unpacked

FEATURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_upper", "n_letters", "n_shouts", "n_bars", "n_lines", "n_closed_lines",
)


def _count_of(text: Column, kept: str) -> Column:
    """Code points of the text that match a character class."""
    return F.length(F.regexp_replace(text, f"[^{kept}]", "")).cast("long")


def _windows(hashes: Column) -> Column:
    """Hash of each window of five words, from the words' hashes."""
    return F.slice(
        F.transform(hashes, lambda h, i: F.xxhash64(h, *(F.get(hashes, i + k) for k in range(1, 5)))),
        F.lit(1), F.greatest(F.size(hashes) - 4, F.lit(0)),
    )


def features(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts named in FEATURES added."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.regexp_replace(x, f"[{BLANK}]", "")) > 0)
    words = F.filter(F.split(text, f"[{BLANK}]+", -1), lambda w: w != "")
    df = docs.withColumns({"_words": words, "_lines": lines})
    df = df.withColumns({
        "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
        "n_words": F.size("_words").cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_closed_lines": F.size(F.filter("_lines", lambda x: F.regexp_like(x, F.lit(rf"[.!?…][{BLANK}]*$")))).cast("long"),
    })
    df = df.withColumn("_wide", _windows(F.col("_hashes")))
    # Only a text in which some window comes twice goes on: window starts sorted by hash, those beside an equal
    # neighbour kept, and the words they cover summed, each once.
    twice = F.size("_wide") > F.size(F.array_distinct("_wide"))
    sorted_starts = F.array_sort(F.transform("_wide", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_sorted", F.when(twice, sorted_starts))
    repeated = F.filter(
        "_sorted",
        lambda x, i: F.coalesce(F.get("_sorted", i + 1)["h"] == x["h"], F.lit(False))
        | F.coalesce(F.get("_sorted", i - 1)["h"] == x["h"], F.lit(False)),
    )
    df = df.withColumn("_at", F.array_sort(F.transform(repeated, lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("_at", lambda a, i: F.least(F.lit(5), F.coalesce(F.get("_at", i + 1) - a, F.lit(5)))),
        F.lit(0), lambda total, n: total + n,
    )
    return df.withColumns({
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, f"[{BLANK}]+", "")).cast("long"),
        "n_symbols": _count_of(text, r"#*$%&|<>"),
        "n_upper": _count_of(text, r"\p{Lu}"),
        "n_letters": _count_of(text, r"\p{L}"),
        "n_shouts": _count_of(text, "!"),
        "n_bars": _count_of(text, "|"),
    }).drop("_words", "_lines", "_hashes", "_wide", "_sorted", "_at")


def base_failed() -> Column:
    """Too short, or over a fifth of the words in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(0)).when(good, F.lit(1))


def rules() -> dict[str, Column]:
    """Name and vote of each rule."""
    n, lines, letters = F.col("n_words"), F.col("n_lines"), F.col("n_letters")
    return {
        "length": _vote(n >= 50, n < 10),
        "word_length": _vote(F.col("word_chars").between(3 * n, 12 * n), ~F.col("word_chars").between(2 * n, 20 * n)),
        "symbols": _vote(50 * F.col("n_symbols") <= n, 5 * F.col("n_symbols") > n),
        "dense_symbols": _vote(10 * F.col("n_symbols") <= n, F.col("n_symbols") > n),
        "capitals": _vote(10 * F.col("n_upper") <= letters, 3 * F.col("n_upper") > letters),
        "shouting": _vote(50 * F.col("n_shouts") <= n, 10 * F.col("n_shouts") > n),
        "tables": _vote(50 * F.col("n_bars") <= n, 10 * F.col("n_bars") > n),
        "repeated_lines": _vote(10 * F.col("n_dup_lines") <= lines, 2 * F.col("n_dup_lines") > lines),
        "repeated_words": _vote(20 * F.col("n_repeat_words") <= n, 5 * F.col("n_repeat_words") > n),
        "closed_lines": _vote(10 * F.col("n_closed_lines") >= 7 * lines, 10 * F.col("n_closed_lines") < 3 * lines),
    }


@dataclass(frozen=True)
class LabelModel:
    """Share of good documents, and each rule's chance of voting good or bad on good and on bad documents.

    ``chances[rule]`` is ((good | good, bad | good), (good | bad, bad | bad)); the rest is abstaining.
    """

    prior: float
    chances: dict[str, tuple[tuple[float, float], tuple[float, float]]]

    def log_odds(self) -> Column:
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, (good, bad) in self.chances.items():
            vote = F.col(f"_vote_{name}")
            said = [math.log(good[k] / bad[k]) for k in (0, 1)]
            total = total + F.when(vote == 1, said[0]).when(vote == 0, said[1]).otherwise(
                math.log((1 - sum(good)) / (1 - sum(bad)))
            )
        return total

    def posterior(self) -> Column:
        return 1 / (1 + F.exp(-self.log_odds()))


def votes(df: DataFrame) -> DataFrame:
    return df.withColumns({f"_vote_{name}": vote for name, vote in rules().items()})


def fit(featured: DataFrame, rounds: int = 20) -> LabelModel:
    """Expectation-maximisation over the counted vote patterns of all rows of ``featured``.

    Junk comes in kinds, and each rule knows one or two of them. So a bad document need not be seen by most rules:
    the start takes a pattern with one bad vote for bad with 0.7, one with more with 0.95, one without any with
    0.05. A rule's bad vote is held to speak against a document (at least four times as likely on bad ones), which
    keeps the two classes from changing places. Each round is one small aggregate over the pattern table.
    """
    names = list(rules())
    columns = [f"_vote_{n}" for n in names]
    patterns = settle(votes(featured).groupBy(*columns).agg(F.count(F.lit(1)).alias("n")), "vote-patterns")
    # at most 3 ** rules rows: one task sums them in one order, so a rerun gives the same numbers
    patterns = patterns.coalesce(1).sortWithinPartitions(*columns)
    against = sum((F.coalesce((F.col(c) == 0).cast("int"), F.lit(0)) for c in columns), F.lit(0))
    p_good: Column = F.when(against == 0, 0.95).when(against == 1, 0.3).otherwise(0.05)
    model = LabelModel(0.9, {n: ((0.9, 0.01), (0.6, 0.3)) for n in names})
    for _ in range(rounds):
        good, bad = F.col("n") * F.col("_p"), F.col("n") * (1 - F.col("_p"))
        sums = [F.sum("n").alias("n"), F.sum(good).alias("good"), F.sum(bad).alias("bad")]
        for name in names:
            vote = F.col(f"_vote_{name}")
            sums += [
                F.sum(F.when(vote == v, weight)).alias(f"{k}{v}_{name}")
                for k, weight in (("g", good), ("b", bad)) for v in (0, 1)
            ]
        row = patterns.withColumn("_p", p_good).agg(*sums).first()
        if not row["n"]:
            return model
        # pseudo-votes spread over the three outcomes, so that no chance is 0
        share = lambda k, v, name: ((row[f"{k}{v}_{name}"] or 0.0) + 0.1) / (row["good" if k == "g" else "bad"] + 0.3)
        chances = {}
        for name in names:
            good_pair = share("g", 1, name), min(share("g", 0, name), 0.2)
            bad_pair = share("b", 1, name), max(share("b", 0, name), 4 * good_pair[1])
            over = max(1.0, sum(bad_pair) / 0.999)
            chances[name] = tuple(round(x, 9) for x in good_pair), tuple(round(x / over, 9) for x in bad_pair)
        model = LabelModel(round(min(max(row["good"] / row["n"], 0.3), 0.99), 9), chances)
        p_good = model.posterior()
    return model


def judge(featured: DataFrame, model: LabelModel, threshold: float = 0.5) -> DataFrame:
    """``featured`` with base_failed, p_good and kept."""
    judged = votes(featured).withColumns({"base_failed": base_failed(), "p_good": model.posterior()})
    judged = judged.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
    return judged.drop(*(f"_vote_{name}" for name in rules()))


def filter_quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    featured = settle(features(packed(docs)), "quality-features")
    return unpacked(judge(featured, fit(featured), threshold).where("kept"), docs)


@query("op7_quality_rules")
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(load(spark, sf_dir, "documents"), "doc_id", "text")
    featured = settle(features(docs).drop("text"), "quality-features")
    return judge(featured, fit(featured)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "p_good",
    )
