"""Schema inference: data type, analysis role and direction of every column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cellgrain.operators.stats import Metric
from cellgrain.plans import profile, rules
from cellgrain.plans.rules import FieldRule, NameRule, first_word, header_key

SCHEMA_COLUMNS = (
    "ordinal", "field", "data_type", "role", "direction", "ignored", "source", "confidence", "reasons",
)


def _answer(
    data_type: str, role: str, direction: str, source: str, confidence: str, *reasons: Column | str
) -> Column:
    texts = [F.lit(r) if isinstance(r, str) else r for r in reasons]
    return F.struct(
        F.lit(data_type).alias("data_type"), F.lit(role).alias("role"),
        F.lit(direction).alias("direction"), F.lit(False).alias("ignored"),
        F.lit(source).alias("source"), F.lit(confidence).alias("confidence"),
        F.array(*texts).cast("array<string>").alias("reasons"),
    )


def infer_schema(
    counts: DataFrame, word_boundary: bool = False, table: Sequence[FieldRule] = rules.GENERIC_RULES
) -> DataFrame:
    """Generic inference by a rule table: typed columns first, then header words, then column structure.

    Directions stay 'unspecified' for metrics.  ``word_boundary`` asks Latin
    identifier words to stand alone (``paid`` is then not an id).  A rule more is a line more in ``table``.  The counts, one row per
    column, are brought to the driver first: the rules run on those rows alone.
    """
    shape = profile.structure_features(profile.kept_small(counts))
    bounded = (rules.IDENTIFIER_NAMES,) if word_boundary else ()
    said = rules.decided(table, ("data_type", "role", "direction", "source", "confidence"), header_key(F.col("field")), bounded)
    answered = rules.once(shape, _s=said)
    return answered.select(
        "ordinal", "field", "_s.data_type", "_s.role", "_s.direction", F.lit(False).alias("ignored"), "_s.source", "_s.confidence", "_s.reasons"
    )


def template_answer(template: Sequence[NameRule] = rules.EDUCATION_TEMPLATE, name: str = "教育模板") -> Column:
    """What the template says about a header (column ``field``), null without a match."""
    h = header_key(F.col("field"))
    options = []
    for rule in template:
        hit = first_word(h, rule.words)

        def why(label: str, hit: Column = hit) -> Column:
            return F.concat(F.lit(f'{name}：字段名包含"'), hit, F.lit(f'"，推荐为{label}'))

        answer = _answer(
            rule.data_type, rule.role, rule.direction, "template", "high", why(rule.label)
        )
        if rule.role == "identifier":
            grouping = _answer("category", "dimension", "neutral", "template", "high", why("分组维度"))
            answer = F.when(hit.isin(*rules.EDU_GROUPING_WORDS), grouping).otherwise(answer)
        options.append(F.when(hit.isNotNull(), answer))
    return F.coalesce(*options)


def apply_template(schema: DataFrame, template: Sequence[NameRule] = rules.EDUCATION_TEMPLATE) -> DataFrame:
    """Template answers for the columns whose header matches; other columns give no row."""
    answered = rules.once(schema.select("ordinal", "field"), _s=template_answer(template))
    return answered.where("_s IS NOT NULL").select("ordinal", "field", "_s.*")


def template_matches(fields: DataFrame, template: Sequence[NameRule] = rules.EDUCATION_TEMPLATE) -> DataFrame:
    words = [w for rule in template for w in rule.words]
    return fields.select("field", first_word(header_key(F.col("field")), words).isNotNull().alias("matches"))


@dataclass(frozen=True)
class Override:
    """A user's explicit choice for one column; 'unspecified' is a choice too."""

    data_type: str | None = None
    role: str | None = None
    direction: str | None = None
    ignored: bool = False
    reason: str = ""


def resolve_schema(
    inferred: DataFrame, overrides: Mapping[str, Override] | None = None,
    template: Sequence[NameRule] | None = None, existing: DataFrame | None = None,
    legacy: DataFrame | None = None,
) -> DataFrame:
    """Final schema: user choice > template > inference > existing > legacy > unspecified.

    Every input has one row per column of the table, so the joins are tiny.
    """
    parts = [c for c in SCHEMA_COLUMNS if c not in ("ordinal", "field")]

    def packed(df: DataFrame, name: str) -> DataFrame:
        return df.select("field", F.struct(*parts).alias(name))

    out = inferred.select("ordinal", "field", F.struct(*parts).alias("_inferred"))
    useful = (F.col("_inferred.data_type") != "unknown") | (F.col("_inferred.role") != "unspecified")
    ranked = [F.when(useful, F.col("_inferred"))]
    if existing is not None:
        out = out.join(F.broadcast(packed(existing.where("source <> 'legacy'"), "_existing")), "field", "left")
        ranked.append(F.col("_existing"))
    if legacy is not None:
        out = out.join(F.broadcast(packed(legacy, "_legacy")), "field", "left")
        ranked.append(F.col("_legacy"))
    if template is not None:
        # header rules need no data, so they are added to the same rows
        out = rules.once(out, _template=template_answer(template))
        ranked.insert(0, F.col("_template"))
    nothing = _answer("unknown", "unspecified", "unspecified", "structure", "unknown", "无法推断字段模式")
    base = F.coalesce(*ranked, nothing)
    out = out.withColumn("_base", base)
    chosen = F.col("_base")
    # the user's changes apply to the stored schema of the column where there is one
    stored = F.coalesce("_existing", "_inferred") if existing is not None else F.col("_inferred")
    for field, o in (overrides or {}).items():
        why = F.lit("用户明确配置" + (f"：{o.reason}" if o.reason else ""))
        mine = F.struct(
            (F.lit(o.data_type) if o.data_type else stored["data_type"]).alias("data_type"),
            (F.lit(o.role) if o.role else stored["role"]).alias("role"),
            (F.lit(o.direction) if o.direction else stored["direction"]).alias("direction"),
            F.lit(o.ignored).alias("ignored"), F.lit("user").alias("source"),
            F.lit("high").alias("confidence"), F.array(why).alias("reasons"),
        )
        chosen = F.when(F.col("field") == field, mine).otherwise(chosen)
    return rules.once(out, _s=chosen).select("ordinal", "field", "_s.*")


def with_participation(resolved: DataFrame) -> DataFrame:
    """Flags: does a column take part in analysis, and does it get a better/worse verdict."""
    analyse = ~F.col("ignored") & ~F.col("role").isin("ignored", "description", "unspecified")
    judged = ~F.col("direction").isin("neutral", "unspecified")
    return resolved.withColumn("analysable", analyse).withColumn("evaluated", judged)


def dimension_candidates(resolved: DataFrame) -> DataFrame:
    return resolved.where(F.col("role").isin("dimension", "time")).select("ordinal", "field", "role")


def _allowed(excluded_words: Sequence[str]) -> Column:
    keep = ~F.col("ignored")
    for word in excluded_words:
        keep = keep & ~F.contains("field", F.lit(word))
    return keep


def analysable_fields(
    resolved: DataFrame, counts: DataFrame | None = None, excluded_words: Sequence[str] = ()
) -> DataFrame:
    """Metric columns; without any, the mostly numeric columns of a usable role.

    ``counts`` (from ``column_counts``) is only needed for that fallback.
    """
    metrics = (F.col("role") == "metric") & _allowed(excluded_words)
    if counts is None:
        return resolved.where(metrics).select("ordinal", "field", "role")
    blocked = F.col("role").isin("identifier", "time", "description", "ignored", "unspecified")
    numeric = counts.select("field", (F.col("numeric") >= F.col("total") * 0.5).alias("_numeric"))
    # one row per column of the table
    any_metric = F.max(metrics).over(W.partitionBy(F.lit(0)))
    return (
        resolved.join(F.broadcast(numeric), "field")
        .withColumn("_any", any_metric)
        .where(metrics | (~F.col("_any") & ~blocked & F.col("_numeric") & _allowed(excluded_words)))
        .select("ordinal", "field", "role")
    )


def default_shortlist(resolved: DataFrame, excluded_words: Sequence[str] = (), n: int = 12) -> DataFrame:
    """The first n metric columns in table order, for a first display."""
    return analysable_fields(resolved, None, excluded_words).orderBy("ordinal").limit(n)


def fields_by_role(resolved: DataFrame) -> DataFrame:
    """Column names per role, in table order; roles without a use are grouped as 'others'."""
    known = F.col("role").isin("metric", "dimension", "identifier", "time", "description")
    grouped = resolved.groupBy(F.when(known, F.col("role")).otherwise("others").alias("role_group"))
    return grouped.agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("ordinal", "field"))), lambda s: s["field"]
        ).alias("fields")
    )


def context_fallback(counts: DataFrame, field: str, n: int = 2) -> DataFrame:
    """Context columns without a schema: mostly non-numeric columns first, in table order."""
    numeric = profile.share("numeric", "total") >= 0.9
    return (
        counts.where(F.col("field") != field).orderBy(numeric, "ordinal").limit(n)
        .select("ordinal", "field")
    )


def context_columns(resolved: DataFrame, field: str, n: int = 3) -> DataFrame:
    """Up to n columns to show beside an outlier: identifiers, then times, then dimensions."""
    order = (
        F.when(F.col("role") == "identifier", 0).when(F.col("role") == "time", 1)
        .when(F.col("role") == "dimension", 2)
    )
    return (
        resolved.where(F.col("field") != field).withColumn("_o", order).where("_o IS NOT NULL")
        .orderBy("_o", "ordinal").limit(n).drop("_o")
    )


@dataclass(frozen=True)
class Catalogue:
    """Metrics, entities (name, is primary key) and dimensions of a table."""

    metrics: tuple[Metric, ...]
    entities: tuple[tuple[str, bool], ...]
    dimensions: tuple[str, ...]

    def recommended(self) -> tuple[Metric, ...]:
        return tuple(m for m in self.metrics if m.recommended)

    def primary_key(self) -> str | None:
        return next((name for name, is_key in self.entities if is_key), None)


def semantic_catalogue(resolved: DataFrame) -> Catalogue:
    """Read the resolved schema (one row per column) into plan-time objects."""
    metrics, entities, dimensions = [], [], []
    for r in resolved.orderBy("ordinal").collect():
        if r["role"] == "metric":
            judged = r["direction"] in ("higher_is_better", "lower_is_better")
            metrics.append(Metric(r["field"], r["direction"].replace("_", "-"), r["field"], judged))
        elif r["role"] in ("dimension", "time"):
            dimensions.append(r["field"])
        elif r["role"] == "identifier":
            entities.append((r["field"], r["source"] == "template" and r["confidence"] == "high"))
    return Catalogue(tuple(metrics), tuple(entities), tuple(dimensions))
