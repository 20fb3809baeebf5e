"""URL filters: rules indexed by their rarest literal token, so that a URL meets few regular expressions.

Two kinds of rules, both compiled to a regular expression and to the literal tokens (runs of a-z and 0-9) that every
URL they fit must hold as whole tokens:

* ``Rule(verdict, host, path)`` fits a host with all its subdomains and paths that start with ``path``.
* ``Pattern(verdict, text)`` is looked for in host and path together, A-Z lower-cased. ``^`` is a place between tokens (an
  end, or any run of other characters), ``*`` any text; all else stands for itself.

One pass counts the tokens of the rules over all URLs. Each rule then stands in the index under its rarest token
alone; a rule without any stands under the empty token, which every URL has. A URL's tokens fetch the candidates, and
only those are run. Of the host rules that fit the longest wins, of equally long ones the blocking one, then the
first. Only where none fits, the patterns decide in the same way, and where no pattern fits either, ``otherwise``.

The rules are arguments, so they lie with the driver from the start; they go to each task with the function. Only the
url column goes to Python, all others stay where they are.

Defined results: the host lies between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; the path goes on up to ``?``, ``#`` or the end. A null url, or one without ``://``, has an empty host and
path, which no host rule fits. host, path, rule and verdict replace columns of those names; other columns, repeated
rows and null ids pass unchanged. Urls of any length are taken whole. An empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrain.llm.common import load, only, query

_TOKEN = re.compile(r"[a-z0-9]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = ""

    @property
    def name(self) -> str:
        return self.host + self.path

    def regex(self) -> str:
        """From the start of host and path; a host holds no slash, and a path begins with one or is empty."""
        return rf"(?:[^/]*\.)?{re.escape(self.host)}(?=/|\Z){re.escape(self.path)}"

    def tokens(self) -> set[str]:
        # the rule's last token may go on in the url, unless the rule itself ends it
        path = self.path.translate(_LOWER)
        whole = path if not path or not _TOKEN.match(path[-1]) else re.sub(r"[a-z0-9]+\Z", "", path)
        return {*_TOKEN.findall(self.host), *_TOKEN.findall(whole)}


@dataclass(frozen=True)
class Pattern:
    verdict: str
    text: str

    @property
    def name(self) -> str:
        return self.text

    def regex(self) -> str:
        place = r"(?:(?<![a-z0-9])(?=[a-z0-9])|(?<=[a-z0-9])(?![a-z0-9])[^a-z0-9]*)"
        return "".join(place if c == "^" else ".*" if c == "*" else re.escape(c) for c in self.text.translate(_LOWER))

    def tokens(self) -> set[str]:
        """Runs with something on both sides that ends a token: ``^`` or a plain character, not ``*`` or the pattern's end."""
        text = self.text.translate(_LOWER)
        inner = (m for m in _TOKEN.finditer(text) if 0 < m.start() and m.end() < len(text))
        return {m.group() for m in inner if "*" not in (text[m.start() - 1], text[m.end()])}


#: The rules of the query's contract.
RULES = (
    Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"),
)
#: What decides where no host rule fits.
PATTERNS = (
    Pattern("block", "^adult^"), Pattern("block", "^porn^"), Pattern("block", "^casino^"), Pattern("block", "^cheap^pills^"),
    Pattern("block", "^viagra^"), Pattern("block", "^ads^track^"), Pattern("block", "^adserver^"), Pattern("block", "^torrent^download^"),
    Pattern("allow", "^adult^education^"),
)


def host_and_path(url: str | None) -> tuple[str, str]:
    head, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    rest = re.split(r"[?#]", rest, maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def _tokens(host: str, path: str) -> set[str]:
    return {*_TOKEN.findall(host), *_TOKEN.findall(path.translate(_LOWER))}


def _count(batches: Iterator[pa.RecordBatch], wanted: frozenset[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: Counter[str] = Counter()
        for url in batch.column(0).to_pylist():
            seen.update(_tokens(*host_and_path(url)) & wanted)
        yield pa.RecordBatch.from_pydict({"token": pa.array(seen, pa.string()), "n": pa.array(seen.values(), pa.int64())})


def token_counts(urls: DataFrame, rules: Sequence[Rule | Pattern]) -> dict[str, int]:
    """In how many urls each token of the rules stands."""
    wanted = frozenset().union(*(r.tokens() for r in rules))
    counted = urls.select("url").mapInArrow(lambda batches: _count(batches, wanted), "token string, n long")
    return dict(counted.groupBy("token").agg(F.sum("n")).collect())  # one row a token of the rules at most


def index(rules: Sequence[Rule | Pattern], counts: dict[str, int]) -> dict[str, list[int]]:
    """Numbers of the rules under their rarest token, of equally rare ones the first by name."""
    out: dict[str, list[int]] = defaultdict(list)
    for i, r in enumerate(rules):
        out[min(r.tokens(), key=lambda t: (counts.get(t, 0), t), default="")].append(i)
    return dict(out)


def candidates(found: dict[str, list[int]], host: str, path: str) -> list[int]:
    return sorted({i for t in ("", *_tokens(host, path)) for i in found.get(t, ())})


def _winner(rules: Sequence[Rule | Pattern], fitting: list[int]) -> Rule | Pattern | None:
    best = min(fitting, key=lambda i: (-len(rules[i].name), rules[i].verdict != "block", i), default=None)
    return None if best is None else rules[best]


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, patterns: Sequence[Pattern] = PATTERNS, otherwise: str = "allow") -> DataFrame:
    """``pages`` (url and any others) with host, path, rule (null where no host rule fits) and verdict."""
    both = [*rules, *patterns]
    found = index(both, token_counts(only(pages, "url"), both)) if both else {}
    first_pattern = len(rules)

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def judged(urls: pd.Series) -> pd.DataFrame:
        compiled: dict[int, re.Pattern] = {}
        rows = []
        for url in urls:
            host, path = host_and_path(url)
            fitting: list[int] = []
            for i in candidates(found, host, path):
                if i not in compiled:
                    compiled[i] = re.compile(both[i].regex(), re.DOTALL)
                if compiled[i].match(host + path) if i < first_pattern else compiled[i].search(host + path.translate(_LOWER)):
                    fitting.append(i)
            rule = _winner(both, [i for i in fitting if i < first_pattern])
            pattern = _winner(both, [i for i in fitting if i >= first_pattern])
            rows.append((host, path, rule and rule.name, (rule or pattern).verdict if rule or pattern else otherwise))
        return pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"])

    out = pages.withColumn("verdict", judged(F.col("url")))
    named = {c: F.col("verdict").getField(c) for c in ("host", "path", "rule")}
    return out.withColumns(named).withColumn("verdict", F.col("verdict").getField("verdict"))


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, patterns: Sequence[Pattern] = PATTERNS, otherwise: str = "allow") -> DataFrame:
    """The rows of ``pages`` whose url is allowed, with their own columns."""
    return judge_urls(pages.withColumn("_page", F.struct(*(F.col(f"`{c}`") for c in pages.columns))).select("_page", "url"), rules, patterns, otherwise).where("verdict = 'allow'").select("_page.*")


SQL = r"""
WITH r AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN regexp_extract(substr(url, position('://' IN url) + 3), '^[^?#]*') ELSE '' END AS rest
  FROM pages
), s AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(coalesce(rest, ''), length(regexp_extract(coalesce(rest, ''), '^[^/]*')) + 1) AS path FROM r
), m AS (
  SELECT *, ('.' || host) AS h, host || translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u FROM s
), v AS (
  SELECT page_id, host, path, u, CASE
    WHEN ends_with(h, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ends_with(h, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ends_with(h, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ends_with(h, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN ends_with(h, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM m
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(u, '(^|[^a-z0-9])torrent[^a-z0-9]+download([^a-z0-9]|$)') THEN 'block'
  WHEN regexp_matches(u, '(^|[^a-z0-9])adult[^a-z0-9]+education([^a-z0-9]|$)') THEN 'allow'
  WHEN regexp_matches(u, '(^|[^a-z0-9])(adult|porn|casino|cheap[^a-z0-9]+pills|viagra|ads[^a-z0-9]+track|adserver)([^a-z0-9]|$)')
  THEN 'block' ELSE 'allow' END AS verdict
FROM v
"""


@query("op13_url_rules", SQL)
def op13_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = only(load(spark, sf_dir, "pages"), "page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")
