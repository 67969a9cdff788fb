"""URL filters: host and path lists, and pattern rules indexed by their rarest literal token.

Tokens are runs of a-z and 0-9 in the lower-cased url. A pattern rule's tokens are read off its
regular expression: literals that every match holds between characters that are no token's, so
a url that matches has them as whole tokens. Counts of these tokens over all urls choose each
rule's rarest one as its index key; a url's own tokens fetch candidate rules, and only those run
their regular expression. Rules without such a token are candidates of every url. Hosts, paths
and list rules are columns; rules may be read from a file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
_TOKEN_CHARS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_TOKEN = re.compile("[a-z0-9]+")
_URL = "://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many list rules are one expression; more are joined by host.
INLINE_RULES = 64
#: Bytes of a rule file that the driver takes.
MOST_RULE_BYTES = 64 << 20


@dataclass(frozen=True)
class ListRule:
    """``host`` with all its subdomains, for paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


_GAP, _UNKNOWN = object(), object()


def _places(parsed) -> list[object]:
    """What a match holds in order: literal token characters, gaps (a character of no token, or
    a border), and unknown stretches."""
    out: list[object] = []
    for op, value in parsed:
        if op is sre.LITERAL:
            out.append(chr(value) if chr(value) in _TOKEN_CHARS else _GAP)
        elif op is sre.AT:
            out.append(_GAP if value in (sre.AT_BEGINNING, sre.AT_BEGINNING_STRING, sre.AT_END, sre.AT_END_STRING, sre.AT_BOUNDARY) else _UNKNOWN)
        elif op is sre.IN:
            out.append(_GAP if _no_token_character(value) else _UNKNOWN)
        elif op is sre.SUBPATTERN and not value[1] and not value[2]:
            out += _places(value[3])
        elif op is sre.BRANCH:
            ways = [_places(way) for way in value[1]]
            out.append(_GAP if all(way == [_GAP] for way in ways) else _UNKNOWN)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] >= 1:
            inner = _places(value[2])
            out += inner if value[0] == value[1] == 1 else [_GAP] if inner == [_GAP] else [_UNKNOWN]
        else:
            out.append(_UNKNOWN)
    return out


def _no_token_character(members) -> bool:
    """Whether a set of characters holds none of a token's."""
    if any(op not in (sre.LITERAL, sre.RANGE, sre.NEGATE) for op, _ in members):
        return False
    listed = {c for c in _TOKEN_CHARS if any(ord(c) == v if op is sre.LITERAL else op is sre.RANGE and v[0] <= ord(c) <= v[1] for op, v in members)}
    return listed == _TOKEN_CHARS if members[0][0] is sre.NEGATE else not listed


def required_tokens(pattern: str) -> tuple[str, ...]:
    """Tokens that every url with a match holds, in order; none if the expression has flags."""
    parsed = sre_parser.parse(pattern)
    if parsed.state.flags & ~re.UNICODE:
        return ()
    out, word, bounded = [], "", False
    for place in (*_places(parsed), _UNKNOWN):
        if isinstance(place, str):
            word += place
        else:
            if word and bounded and place is _GAP:
                out.append(word)
            word, bounded = "", place is _GAP
    return tuple(dict.fromkeys(out))


@dataclass(frozen=True)
class PatternRule:
    """A regular expression over the lower-cased url; its tokens follow from it."""

    name: str
    pattern: str
    verdict: str = BLOCK

    @property
    def tokens(self) -> tuple[str, ...]:
        return required_tokens(self.pattern)


LIST_RULES = (ListRule("net", "/", BLOCK), ListRule("example.net", "/en/", ALLOW), ListRule("example.com", "/de/", BLOCK), ListRule("org", "/fr/", ALLOW))


def _joined(first: str, second: str) -> PatternRule:
    return PatternRule(f"{first}-{second}", f"(^|[^a-z0-9]){first}[-.]{second}([^a-z0-9]|$)")


PATTERN_RULES = (
    *(_joined(a, b) for a, b in (("casino", "win"), ("free", "bets"), ("cheap", "pills"), ("spam", "farm"), ("ads", "track"), ("xxx", "cams"), ("payday", "loans"))),
    PatternRule("redirect", r"[?&]redirect=https?(:|%3a)"),
    PatternRule("session-id", r"[?&]phpsessid=[0-9a-f]{16}"),
    PatternRule("click-track", r"/click/track\.php"),  # php may go on: .php5
    *(_joined(a, b) for a, b in (("online", "casino"), ("poker", "bonus"), ("live", "cams"), ("link", "farm"), ("fake", "watches"), ("instant", "loans"))),
    PatternRule("jsessionid", r"[;?&]jsessionid=[0-9a-z]{16}"),
    PatternRule("open-redirect", r"[?&](url|goto|next)=https?(:|%3a)"),
    PatternRule("affiliate", r"[?&]affid=[0-9]+"),
    PatternRule("web-bug", r"/(pixel|beacon|1x1)\.gif([^a-z0-9]|$)"),
)


class PatternIndex:
    """Pattern rules by their rarest token; a worker's lookup structure."""

    def __init__(self, rules: tuple[PatternRule, ...], counts: dict[str, int]) -> None:
        self.by_token: dict[str, list[int]] = {}
        self.always: list[int] = []
        self.rules, self.compiled = rules, [re.compile(r.pattern) for r in rules]
        for k, rule in enumerate(rules):
            key = min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t), default=None)
            (self.always if key is None else self.by_token.setdefault(key, [])).append(k)

    def matched(self, lowered: str) -> PatternRule | None:
        """The first pattern rule, in the order given, that the lower-cased url fits."""
        found = set(self.always)
        for token in set(_TOKEN.findall(lowered)):
            found.update(self.by_token.get(token, ()))
        return next((self.rules[k] for k in sorted(found) if self.compiled[k].search(lowered)), None)


def read_rules(spark: SparkSession, path: str) -> tuple[tuple[ListRule, ...], tuple[PatternRule, ...]]:
    """Rules of a text file that Spark can read, of tab-separated lines
    ``list<TAB>allow|block<TAB>host/path`` and ``pattern<TAB>allow|block<TAB>name<TAB>expression``.
    Empty lines and those that begin with # are skipped; order is the file's. Files over
    ``MOST_RULE_BYTES`` are refused."""
    lines = spark.read.text(path, wholetext=True)
    size = lines.agg(F.sum(F.octet_length("value"))).first()[0] or 0
    if size > MOST_RULE_BYTES:
        raise ValueError(f"{size} bytes of rules are more than {MOST_RULE_BYTES}")
    lists, patterns = [], []
    for line in (line for row in lines.collect() for line in row.value.splitlines()):
        if not line.strip() or line.startswith("#"):
            continue
        kind, verdict, *rest = line.split("\t")
        if verdict not in (ALLOW, BLOCK):
            raise ValueError(f"no such verdict: {line!r}")
        if kind == "list" and len(rest) == 1 and "/" in rest[0]:
            host, _, tail = rest[0].partition("/")
            lists.append(ListRule(host.lower(), "/" + tail, verdict))
        elif kind == "pattern" and len(rest) == 2:
            patterns.append(PatternRule(rest[0], rest[1], verdict))
        else:
            raise ValueError(f"cannot read the rule {line!r}")
    return tuple(lists), tuple(patterns)


def _lowered(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def token_counts(pages: DataFrame, rules: tuple[PatternRule, ...], url_col: str = "url") -> dict[str, int]:
    """How many urls hold each token of the rules: one row a token, bounded by the rules."""
    wanted = sorted({t for r in rules for t in r.tokens})
    tokens = pages.select(F.explode(F.array_distinct(F.regexp_extract_all(_lowered(F.col(url_col).cast("string")), F.lit("[a-z0-9]+"), F.lit(0)))).alias("token"))
    return {r.token: r.n for r in tokens.where(F.col("token").isin(wanted)).groupBy("token").agg(F.count("*").alias("n")).collect()}


def _with_list_rule(parts: DataFrame, rules: tuple[ListRule, ...]) -> DataFrame:
    """Adds ``rule`` and ``verdict`` of the longest list rule that fits, or nulls; equal lengths
    in the order of their texts."""
    ranked = sorted(rules, key=lambda r: (-len(r.text), r.text))
    if len(ranked) <= INLINE_RULES:
        fits = [((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path) for r in ranked]
        place = F.coalesce(*(F.when(fit, k) for k, fit in enumerate(fits)), F.lit(-1)) if fits else F.lit(-1)
        texts, verdicts = (F.array(*(F.lit(x) for x in values)).cast("array<string>") for values in ([r.text for r in ranked], [r.verdict for r in ranked]))
        return parts.withColumn("_at", place).withColumn("rule", F.get(texts, F.col("_at"))).withColumn("verdict", F.get(verdicts, F.col("_at"))).drop("_at")
    # hosts and their parent domains meet the rules; a host's rules are as many as its suffixes have
    listed = parts.sparkSession.createDataFrame([(r.host, k, r.path, r.text, r.verdict) for k, r in enumerate(ranked)], "_suffix string, k int, p string, t string, v string")
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, n, F.size(labels)), "."))
    hosts = parts.select(F.col("host").alias("_host")).distinct().withColumn("host", F.col("_host")).select("_host", F.explode(suffixes).alias("_suffix"))
    known = hosts.join(listed, "_suffix").groupBy("_host").agg(F.array_sort(F.collect_list(F.struct("k", "p", "t", "v"))).alias("_rules"))
    best = F.get(F.filter("_rules", lambda r: F.col("path").startswith(r["p"])), F.lit(0))
    joined = parts.join(known, F.col("host") == F.col("_host"), "left").withColumn("_best", best)
    return joined.withColumn("rule", F.col("_best.t")).withColumn("verdict", F.col("_best.v")).drop("_best", "_rules", "_host")


def judge(pages: DataFrame, list_rules: tuple[ListRule, ...] = LIST_RULES, pattern_rules: tuple[PatternRule, ...] = PATTERN_RULES, counts: dict[str, int] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id_col``, ``host``, ``path``, ``rule``, ``verdict`` and ``pattern`` of every url.

    The longest fitting list rule decides; without one the first fitting pattern rule does (its
    name is in ``pattern``), and else the url is allowed. Null urls and urls without ``://`` have
    empty host and path. Urls are read whole, whatever their length. Repeated rows are judged
    alike; an empty table gives no rows; other columns are not read.
    """
    counts = token_counts(pages, pattern_rules, url_col) if counts is None else counts
    kind = pages.schema[id_col].dataType.simpleString()
    url = F.col(url_col).cast("string")
    parts = pages.select(F.col(id_col).alias("id"), F.coalesce(_lowered(F.regexp_extract(url, _URL, 1)), F.lit("")).alias("host"), F.coalesce(F.regexp_extract(url, _URL, 2), F.lit("")).alias("path"), _lowered(url).alias("_url"))
    listed = _with_list_rule(parts, list_rules)
    # only urls without a list rule are looked up
    open_ = listed.select("id", "host", "path", "rule", "verdict", F.when(F.col("rule").isNull(), F.col("_url")).alias("_url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = PatternIndex(pattern_rules, counts)
        for batch in batches:
            verdicts, names = [], []
            for verdict, lowered in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                match = index.matched(lowered) if lowered else None
                verdicts.append(verdict or (match.verdict if match else ALLOW))
                names.append(match.name if match else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(verdicts, type=pa.string()), pa.array(names, type=pa.string())], names=["id", "host", "path", "rule", "verdict", "pattern"])

    return open_.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string, pattern string").withColumnRenamed("id", id_col)


def oracle() -> str:
    """The default judgement as DuckDB SQL."""
    lists = " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.text}'" for r in sorted(LIST_RULES, key=lambda r: -len(r.text)))
    blocked = ", ".join(f"'{r.text}'" for r in LIST_RULES if r.verdict == BLOCK)
    named = ", ".join(f"'{r.name}'" for r in PATTERN_RULES if r.verdict == BLOCK)
    patterns = " ".join(f"WHEN regexp_matches(lowered, '{r.pattern}') THEN '{r.name}'" for r in PATTERN_RULES)
    return f"""
WITH parts AS (
  SELECT page_id, coalesce(translate(url, '{_UPPER}', '{_LOWER}'), '') AS lowered,
         coalesce(translate(regexp_extract(url, '{_URL}', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '{_URL}', 2), '') AS path FROM pages
), listed AS (SELECT *, CASE {lists} END AS rule FROM parts),
named AS (SELECT *, CASE WHEN rule IS NULL THEN CASE {patterns} END END AS pattern FROM listed)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ({blocked}) OR pattern IN ({named}) THEN 'block' ELSE 'allow' END AS verdict, pattern
FROM named"""
