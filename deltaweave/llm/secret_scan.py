"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every document version is content-addressed by the SHA-256 of its text. The ledger remembers
which (blob, rule version) pairs were scanned and what they held; a scan runs regular
expressions only on blobs with an unseen pair, once a blob however many documents share it,
and joins the findings back to all documents. Literal gates are tested in the pass that takes
the hash, so only texts that could match travel to be grouped by blob; the others are recorded
as scanned without findings, and take no part in any join of documents with findings. That join
is salted, so a blob that very many documents share is dealt over several tasks.

Spans are code points of the text, end exclusive. They come from split() around the matches:
the pieces' and the matches' lengths add up to the positions.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deltaweave.llm.storage import cut


@dataclass(frozen=True)
class SecretRule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters.

    ``gate`` is a tuple of lower-case literals of which a match holds one (compared without
    case), or a cheaper regular expression. Patterns must not look around a match.
    """

    kind: str
    pattern: str
    group: int
    least: int
    gate: tuple[str, ...] | str

    @property
    def version(self) -> str:
        return self.kind + ":" + hashlib.sha256(repr((self.pattern, self.group, self.least)).encode()).hexdigest()[:12]

    def may_match(self, text: Column, lowered: Column) -> Column:
        if isinstance(self.gate, str):
            return text.rlike(self.gate)
        return reduce(Column.__or__, (F.contains(lowered, F.lit(g)) for g in self.gate))


#: The base kinds first, in the order in which equal starts are listed.
BASE_RULES = (
    SecretRule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    SecretRule("access", "AKIA[A-Z0-9]+", 0, 16, ("akia",)),
    SecretRule("hex", "[0-9a-f]{32,}", 0, 32, "[0-9a-f]{32}"),
)
MORE_RULES = (
    SecretRule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 20, ("private key-----",)),
    SecretRule("pat", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
)
RULES = BASE_RULES + MORE_RULES


#: Tasks over which the documents of one blob are dealt.
SALTS = 16


def _gate(text: Column, rules: tuple[SecretRule, ...]) -> Column:
    return reduce(Column.__or__, (r.may_match(text, F.lower(text)) for r in rules))


def versions(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id``, the blob address of each document version, and ``_text`` (null texts are empty)
    where it passes a rule's gate."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("_id"), text.alias("_text")).select("_id", F.sha2("_text", 256).alias("_blob"), F.when(_gate(F.col("_text"), rules), F.col("_text")).alias("_text"))


def _unseen(blobs: DataFrame, ledger: DataFrame | None, rules: tuple[SecretRule, ...]) -> DataFrame:
    """Adds ``_rules``: the versions that the ledger lacks for the blob; blobs without any go."""
    every = F.array(*(F.lit(r.version) for r in rules))
    if ledger is None:
        return blobs.withColumn("_rules", every)
    seen = ledger.groupBy(F.col("blob").alias("_seen")).agg(F.collect_set("rule_version").alias("_done"))
    joined = blobs.join(seen, F.col("_blob") == F.col("_seen"), "left")
    return joined.withColumn("_rules", F.array_except(every, F.coalesce("_done", F.array().cast("array<string>")))).drop("_seen", "_done").where(F.size("_rules") > 0)


def _lengths(strings: Column) -> Column:
    return F.transform(strings, F.length)


def _group_lengths(matches: Column, rule: SecretRule) -> Column:
    """Lengths of the rule's group inside its matches."""
    if rule.group == 0:
        return _lengths(matches)
    return F.transform(matches, lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group)))


def scan_blobs(blobs: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """Findings ``blob, rule_version, kind, start, end`` of ``_blob, _text, _rules`` rows."""
    lowered = F.lower("_text")
    parts = []
    for k, rule in enumerate(rules):
        wanted = F.array_contains("_rules", rule.version) & rule.may_match(F.col("_text"), lowered)
        matches = F.regexp_extract_all("_text", F.lit(rule.pattern), F.lit(0))
        parts.append(
            F.when(
                wanted,
                F.arrays_zip(
                    F.array_repeat(F.lit(k), F.size(matches)).alias("k"),
                    _lengths(F.split("_text", rule.pattern, -1)).alias("gap"),
                    _lengths(matches).alias("width"),
                    _group_lengths(matches, rule).alias("core"),
                ),
            )
        )
    found = blobs.select("_blob", F.explode(F.array(*parts)).alias("m")).where("m IS NOT NULL").select("_blob", F.posexplode("m").alias("at", "m")).where("m.width IS NOT NULL").select("_blob", "at", "m.*")
    before = Window.partitionBy("_blob", "k").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    least, kinds, names = (F.array(*(F.lit(x) for x in values)) for values in ([r.least for r in rules], [r.kind for r in rules], [r.version for r in rules]))
    placed = found.withColumn("end", F.sum(F.col("gap") + F.col("width")).over(before)).where(F.col("core") >= least[F.col("k")])
    return placed.select(F.col("_blob").alias("blob"), names[F.col("k")].alias("rule_version"), kinds[F.col("k")].alias("kind"), (F.col("end") - F.col("width")).alias("start"), "end")


def scan_versions(seen: DataFrame, ledger: DataFrame | None, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """New findings of ``versions`` with unseen (blob, rule version) pairs."""
    blobs = seen.where("_text IS NOT NULL").groupBy("_blob").agg(F.first("_text").alias("_text"))
    return scan_blobs(_unseen(blobs, ledger, rules), rules)


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[SecretRule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """New findings of documents' blobs with unseen (blob, rule version) pairs."""
    return scan_versions(versions(docs, rules, id_col, text_col), ledger, rules)


def new_rows(seen: DataFrame, ledger: DataFrame | None, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """What ``versions`` add to the ledger: findings, and one row with null kind for each
    (blob, rule version) pair newly scanned."""
    marks = _unseen(seen.select("_blob").distinct(), ledger, rules).select(F.col("_blob").alias("blob"), F.explode("_rules").alias("rule_version"))
    none = marks.select("blob", "rule_version", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"))
    return none.unionByName(scan_versions(seen, ledger, rules))


def update_ledger(docs: DataFrame, ledger: DataFrame | None, rules: tuple[SecretRule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """New ledger rows of documents, as ``new_rows`` gives them."""
    return new_rows(versions(docs, rules, id_col, text_col), ledger, rules)


class Ledger:
    """The ledger as a table in a shared folder, one part a scan; a part appears whole or not."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.scans = spark, folder, 0

    def table(self) -> DataFrame | None:
        if not self.scans:
            return None
        return self.spark.read.schema("blob string, rule_version string, kind string, start long, end long").parquet(*(f"{self.folder}/{k}" for k in range(self.scans)))

    def scan(self, seen: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> None:
        """Scan what the ledger lacks of these ``versions``, and record it."""
        new_rows(seen, self.table(), rules).write.parquet(f"{self.folder}/{self.scans}")
        self.scans += 1


def _ordered(rules: tuple[SecretRule, ...]) -> Column:
    """Spans as (start, kind's place, kind, end) structs, sorted."""
    place = F.array_position(F.array(*(F.lit(r.kind) for r in rules)), F.col("kind"))
    return F.array_sort(F.collect_list(F.struct("start", place.alias("place"), "kind", "end")))


def _of_blobs(rows: DataFrame, by_blob: DataFrame) -> DataFrame:
    """Rows with ``_blob`` and the spans of their blob, if any, dealt by blob and salt."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_deal", F.spark_partition_id()), F.lit(SALTS)).cast("int"))
    copies = by_blob.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, (F.col("_blob") == F.col("blob")) & (F.col("_salt") == F.col("_copy")), "left")


def spans_of_versions(seen: DataFrame, findings: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """``_id, spans`` of ``versions`` whose blobs' findings are all among ``findings``."""
    by_blob = findings.groupBy("blob").agg(_ordered(rules).alias("spans"))
    none = F.array().cast(by_blob.schema["spans"].dataType)
    gated = seen.where("_text IS NOT NULL").select("_id", "_blob", F.col("_id").alias("_deal"))
    found = _of_blobs(gated, by_blob).select("_id", F.coalesce("spans", none).alias("spans"))
    return found.unionByName(seen.where("_text IS NULL").select("_id", none.alias("spans")))


def recorded(ledger: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """The ledger's findings under the given rules."""
    return ledger.where(F.col("kind").isNotNull() & F.col("rule_version").isin([r.version for r in rules]))


def spans_by_document(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[SecretRule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``spans`` (array of start, place, kind, end; sorted) of every document.

    Old findings of the ledger count too, for the rule versions given. Texts are scanned whole,
    whatever their length. Null and empty texts have no spans; repeated rows and copies get the
    same spans; an empty table gives no rows; other columns are not read.
    """
    seen = versions(docs, rules, id_col, text_col)
    findings = scan_versions(seen, ledger, rules)
    if ledger is not None:
        findings = findings.unionByName(recorded(ledger, rules).select(*findings.columns))
    return spans_of_versions(seen, findings, rules).withColumnRenamed("_id", id_col)


def spans_through_ledger(docs: DataFrame, folder: str, rules: tuple[SecretRule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", arrivals: int = 2) -> DataFrame:
    """The same, with every finding recorded in and read from a ledger kept under ``folder``.

    The documents arrive in ``arrivals`` parts by a hash of their id. Each part's scan reads what
    the ledger holds, scans only blobs it lacks, and appends what it finds; copies of one text in
    several parts are scanned once. Texts are read, hashed and gated once for all parts.
    """
    seen, ledger = cut(versions(docs, rules, id_col, text_col)), Ledger(docs.sparkSession, folder)
    for k in range(arrivals):
        ledger.scan(seen.where(F.pmod(F.xxhash64("_id"), F.lit(arrivals)) == k), rules)
    return spans_of_versions(seen, recorded(ledger.table(), rules), rules).withColumnRenamed("_id", id_col)


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    base = of(*(r.kind for r in BASE_RULES))
    counts = [F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE_RULES]
    return found.select(id_col, *counts, F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[SecretRule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """The documents with each (merged) span of their text replaced by ``mark``.

    All columns are kept in order, whatever their names; texts without spans stay as they are,
    null stays null. Rows whose text passes no gate are not shuffled.
    """
    findings = scan(docs, ledger, rules, id_col, text_col)
    if ledger is not None:
        findings = findings.unionByName(recorded(ledger, rules).select(*findings.columns))
    by_blob = findings.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    clear, gated = docs.where(~_gate(text, rules)), docs.where(_gate(text, rules))
    whole = gated.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.sha2(text, 256).alias("_blob"), F.col(id_col).alias("_deal"))
    text = F.col("_row").getField(text_col)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        grown = F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(grown).alias("out"))

    clean = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    new = F.when(F.col("spans").isNull(), text).otherwise(clean)
    return clear.union(_of_blobs(whole, by_blob).select(*(new.alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns)))


def oracle() -> str:
    """The digests of all documents under the default rules as DuckDB SQL."""
    one = " UNION ALL ".join(
        f"""SELECT doc_id, {k} AS place, '{r.kind}' AS kind, regexp_split_to_array(t, '{r.pattern.replace("'", "''")}') AS gaps,
        regexp_extract_all(t, '{r.pattern.replace("'", "''")}', 0) AS whole, regexp_extract_all(t, '{r.pattern.replace("'", "''")}', {r.group}) AS core, {r.least} AS least FROM d"""
        for k, r in enumerate(RULES)
    )
    base = ", ".join(f"'{r.kind}'" for r in BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({one}),
e AS (SELECT *, unnest(generate_series(1, len(whole))) AS i FROM m WHERE len(whole) > 0),
s AS (SELECT doc_id, place, kind, length(whole[i]) AS width, length(core[i]) AS size, least,
      list_sum(list_transform(gaps[1:i], lambda x: length(x))) + list_sum(list_transform(whole[1:i], lambda x: length(x))) AS finish FROM e),
f AS (SELECT doc_id, place, kind, CAST(finish - width AS BIGINT) AS start, CAST(finish AS BIGINT) AS finish FROM s WHERE size >= least),
w AS (SELECT *, kind || ':' || start || ':' || finish AS said FROM f),
g AS (SELECT doc_id, {counts}, string_agg(said, ',' ORDER BY start, place) FILTER (WHERE kind IN ({base})) AS base, string_agg(said, ',' ORDER BY start, place) AS spans FROM w GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id"""
