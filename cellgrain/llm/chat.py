r"""Chat formatting with typed content parts.

A turn's content is a list of parts: text, image, audio, document. A visitor maps each part by its type: text is
escaped and kept, every other part becomes a placeholder that keeps its place, its reference is recorded with
the placeholder's position in the output, and its expanded token count follows from its size. Turns are joined to

    ### role: content</turn>\n

Inside roles and texts a backslash is doubled, and one is put inside every control string (``###\ ``, ``<\/turn>``,
``<\|``), so no control string is left in them and reading back is exact. The loss mask is a list of [start, end)
spans, in code points of the output, over the content of assistant turns.

Defined results: rows are ordered by turn, then role, then text; rows equal in all stay as repeated turns. A null
text or role is empty, a null turn comes first, rows with null conv_id form one conversation. A part of unknown
type with text counts as text, without text as a file of one token; null parts are left out. An empty table gives
no rows. Only the columns named here are read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellgrain.llm.common import load, only, query

PART = "struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
END = "</turn>"
_ESCAPES = (("\\", "\\\\"), ("### ", "###\\ "), (END, "<\\/turn>"), ("<|", "<\\|"))
_PLACEHOLDER = r"<\|(image|audio|document|file)\|>"
#: Side of an image patch, tokens per second of audio, tokens per page of a document.
PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25, 256


def escape(text: Column) -> Column:
    for plain, safe in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def pieces_of(text: Column) -> Column:
    """Default token count of plain text: runs of letters and marks, digits, other visible characters."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{M}]+|\p{N}|[^\s\p{L}\p{M}\p{N}]")).cast("long")


def text_parts(text: Column) -> Column:
    """Plain text as a list of one part."""
    part = F.struct(
        F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"),
        *(F.lit(None).cast(t).alias(n) for n, t in (
            ("uri", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))),
    )
    return F.array(part)


#: Fields that each known type of a JSON part may have besides its type; the first must be there.
_FIELDS = {"text": ("text",), "image": ("uri", "width", "height"), "audio": ("uri", "seconds"), "document": ("uri", "pages")}


def _is_part(part: Column, raw: Column) -> Column:
    """Whether ``part`` takes over all that the JSON object ``raw`` (a map) says."""
    keys, kind = F.map_keys(raw), part["type"]

    def fits(*fields: str) -> Column:
        parsed = [part[f].isNotNull() | F.element_at(raw, f).isNull() for f in fields if f not in ("text", "uri")]
        held = part[fields[0]].isNotNull() & (F.size(F.array_except(keys, F.array(*map(F.lit, ("type", *fields))))) == 0)
        for p in parsed:
            held = held & p
        return held

    test = F.when(kind.isNull() | (F.size(keys) != F.size(F.array_distinct(keys))), False)
    for name, fields in _FIELDS.items():
        test = test.when(kind == name, fits(*fields))
    return F.coalesce(test.otherwise(fits("text") | fits("uri")), F.lit(False))


def json_parts(content: Column) -> Column:
    """Content that may be a JSON list of parts; anything else is plain text.

    A list of parts is the whole content, has a part of a known type, and each of its parts has a type, the text or
    uri that goes with it, and nothing that the part would not take over. So no answer in JSON is taken for parts.
    """
    listed = F.when(F.ltrim(F.translate(content, "\t\r\n", "   ")).startswith("["), content)
    parts, raw = F.from_json(listed, f"array<{PART}>"), F.from_json(listed, "array<map<string,string>>")
    # from_json does not look at what follows the list, so the list must end where a mark of its own begins
    mark = F.md5(listed.cast("binary"))
    closed = F.from_json(F.concat(F.lit("["), listed, F.lit(',["'), mark, F.lit('"]]')), "array<array<string>>")
    whole = (F.size(closed) == 2) & (F.get(F.get(closed, F.lit(1)), F.lit(0)) == mark)
    good = F.forall(F.zip_with(parts, raw, _is_part), lambda x: x) & F.exists(parts, lambda p: p["type"].isin(*_FIELDS))
    return F.when(whole & good, parts).otherwise(text_parts(content))


def _image(p: Column) -> Column:
    side = [F.ceil(F.coalesce(p[s], F.lit(PATCH)) / F.lit(PATCH)) for s in ("width", "height")]
    return F.greatest(side[0] * side[1], F.lit(1)).cast("long")


def _audio(p: Column) -> Column:
    return F.greatest(F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * AUDIO_RATE), F.lit(1)).cast("long")


def _document(p: Column) -> Column:
    return F.greatest(F.coalesce(p["pages"], F.lit(1)) * PAGE_TOKENS, F.lit(1)).cast("long")


#: Expanded tokens of each attachment type; its placeholder is <|type|>.
VISITORS = {"image": _image, "audio": _audio, "document": _document}


def visit(part: Column, text_tokens=pieces_of) -> Column:
    """(body, type, uri, tokens) of one part; uri and type are null for text."""
    body = escape(F.coalesce(part["text"], F.lit("")))
    kind = F.when(part["type"].isin(*VISITORS), part["type"]).when(
        part["text"].isNull() & (F.coalesce(part["type"], F.lit("text")) != "text"), F.lit("file")
    )
    tokens = F.when(kind.isNull(), text_tokens(F.coalesce(part["text"], F.lit(""))))
    for name, count in VISITORS.items():
        tokens = tokens.when(kind == name, count(part))
    return F.struct(
        F.when(kind.isNull(), body).otherwise(F.concat(F.lit("<|"), kind, F.lit("|>"))).alias("body"),
        kind.alias("type"), F.when(kind.isNotNull(), part["uri"]).alias("uri"), tokens.otherwise(F.lit(1)).cast("long").alias("tokens"),
    )


def format_chats(turns: DataFrame, text_tokens=pieces_of) -> DataFrame:
    """conv_id, formatted, loss_spans, attachments, n_tokens from rows (conv_id, turn, role, parts).

    Every turn is flattened on its own; a running length per conversation places it in the output, and one
    grouping on the same key joins the turns, so the turns are shuffled once.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    flat = turns.select(
        "conv_id", "turn", role.alias("role"), "parts",
        F.transform(F.filter("parts", lambda p: p.isNotNull()), lambda p: visit(p, text_tokens)).alias("flat"),
    )
    flat = flat.withColumns({
        "head": F.concat(F.lit("### "), F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\:")), F.lit(": ")),
        "body": F.array_join(F.transform("flat", lambda x: x["body"]), ""),
    }).withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    order = "ORDER BY turn NULLS FIRST, role, body ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    placed = flat.withColumns({
        "n": F.expr(f"row_number() OVER (PARTITION BY conv_id {order})"),
        "stop": F.expr(f"sum(length(piece)) OVER (PARTITION BY conv_id {order})"),
    })
    body_at = F.col("stop") - F.length("piece") + F.length("head")
    # parts of one turn are few: each placeholder's place is the length of the bodies before it
    before = lambda i: F.aggregate(
        F.slice("flat", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + F.length(x["body"])
    )
    attachments = F.filter(F.transform("flat", lambda x, i: F.struct(
        (F.col("n") - 1).alias("turn_no"), i.alias("part_no"), x["type"].alias("type"), x["uri"].alias("uri"),
        (body_at + before(i)).alias("start"), x["tokens"].alias("tokens"),
    )), lambda x: x["type"].isNotNull())
    placed = placed.select(
        "conv_id", F.struct(
            "n", "piece", attachments.alias("attachments"),
            F.when(F.col("role") == "assistant", F.struct(body_at.alias("start"), (body_at + F.length("body")).alias("end"))).alias("loss"),
        ).alias("t"),
        F.aggregate("flat", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("tokens"),
    )
    grouped = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"), F.sum("tokens").alias("n_tokens"))
    return grouped.select(
        "conv_id", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        F.filter(F.transform("t", lambda x: x["loss"]), lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten(F.transform("t", lambda x: x["attachments"])).alias("attachments"), "n_tokens",
    )


def parse_chat(formatted: Column, with_placeholders: bool = True) -> Column:
    """The turns (role, text) of a formatted conversation, unescaped; placeholders stay in the text or go.

    Texts hold no placeholder of their own: one would have been escaped.
    """
    if not with_placeholders:
        formatted = F.regexp_replace(formatted, _PLACEHOLDER, "")
    chunks = F.filter(F.split(formatted, END + "\n", -1), lambda c: c != "")
    head = r"(?s)^### ((?:[^\\:]++|\\.)*+): (.*)$"
    return F.transform(chunks, lambda c: F.struct(
        unescape(F.regexp_extract(c, head, 1)).alias("role"), unescape(F.regexp_extract(c, head, 2)).alias("text")
    ))


def placeholders(formatted: Column) -> Column:
    """Types of the attachments in order of their placeholders."""
    return F.regexp_extract_all(formatted, F.lit(_PLACEHOLDER), F.lit(1))


@F.pandas_udf(T.StringType())
def masked_text(formatted: pd.Series, spans: pd.Series) -> pd.Series:
    """What the spans cover, joined. Python slices by code point without walking from the start each time."""
    return pd.Series(["".join(text[s["start"]:s["end"]] for s in held) for text, held in zip(formatted, spans, strict=True)])


def with_attachments(parts: Column, role: Column, text: Column) -> Column:
    """``parts``, and for most user turns one attachment after them whose kind and size follow from the text's length.

    The conversations at hand are plain text; this gives them parts of every type.
    """
    n = F.length(F.coalesce(text, F.lit("")))
    sizes = {"image": (n, 2 * n, None, None), "audio": (None, None, n / 10.0, None), "document": (None, None, None, n % 7 + 1)}
    added = F.array().cast(f"array<{PART}>")
    for rest, (kind, (width, height, seconds, pages)) in enumerate(sizes.items(), 1):
        cells = {"type": F.lit(kind), "text": None, "uri": F.concat(F.lit("turn:"), F.md5(text.cast("binary"))), "width": width, "height": height, "seconds": seconds, "pages": pages}
        types = dict(f.split(":") for f in PART.removeprefix("struct<").removesuffix(">").split(","))
        part = F.struct(*((F.lit(None) if c is None else c).cast(types[name]).alias(name) for name, c in cells.items()))
        added = F.when((role == "user") & (n % 4 == rest), F.array(part)).otherwise(added)
    return F.concat(parts, added)


_OWN_TEXT = r"\### Assistant: </turn> ok"
_sql_text = "coalesce(text, '')"


def _sql_escape(expr: str) -> str:
    for plain, safe in _ESCAPES:
        expr = f"replace({expr}, '{plain}', '{safe}')"
    return expr


SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, {_sql_text} AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_OWN_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{_OWN_TEXT}'
), k AS (
  SELECT *, CASE WHEN role = 'user' THEN CASE length(text) % 4 WHEN 1 THEN 'image' WHEN 2 THEN 'audio' WHEN 3 THEN 'document' END END AS kind FROM c
), c2 AS (
  SELECT *, CASE kind WHEN 'image' THEN ceil(length(text) / 14) * ceil(2 * length(text) / 14) WHEN 'audio' THEN ceil(length(text)::DOUBLE / 10 * 25)
    WHEN 'document' THEN (length(text) % 7 + 1) * 256 ELSE 0 END AS tokens FROM k
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  cast(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS bigint) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  cast(sum(length('### ' || replace({_sql_escape('role')}, ':', '\\:') || ': ' || {_sql_escape('text')} || '{END}' || chr(10)) + coalesce(length('<|' || kind || '|>'), 0)) AS bigint) AS formatted_chars,
  cast(sum(len(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}]+|\\p{{N}}|[^\\s\\p{{L}}\\p{{M}}\\p{{N}}]')) + tokens) AS bigint) AS n_tokens,
  count(kind) AS n_attachments, cast(sum(tokens) AS bigint) AS attachment_tokens,
  sha256(coalesce(string_agg('turn:' || md5(text), ',' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE kind IS NOT NULL), '')) AS uris_sha256
FROM c2 GROUP BY conv_id
"""


@query("op4_chat_parts", SQL)
def op4_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = only(load(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", _OWN_TEXT), (-7, 1, "assistant", _OWN_TEXT)], "conv_id long, turn long, role string, text string")
    turns = rows.unionByName(own)
    chats = format_chats(turns.withColumn("parts", with_attachments(text_parts(F.col("text")), F.col("role"), F.col("text"))))
    read = chats.select(
        "conv_id", "formatted", "attachments", parse_chat(F.col("formatted"), with_placeholders=False).alias("turns"),
        unescape(masked_text("formatted", "loss_spans")).alias("loss"), "n_tokens", F.size("attachments").cast("long").alias("n_attachments"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "n_tokens", "n_attachments",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("attachment_tokens"),
        F.sha2(F.array_join(F.transform("attachments", lambda x: x["uri"]), ","), 256).alias("uris_sha256"),
    )
