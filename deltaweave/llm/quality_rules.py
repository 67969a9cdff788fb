"""Quality rules by distribution divergence.

Histograms of character classes and of common words are compared with language references by
Jensen-Shannon distance. References are fitted on a corpus (the one judged, unless others are
given): they are summed over every document that passes the base rule and of whose words at least
``EVIDENCE`` are common words of one language. The word lists are fixed, so junk cannot become a
reference, however much of the corpus it is; where no document shows a language, that share alone
judges. Only fixed-size sums reach the driver. A document is rejected when even its nearest
reference is farther than the limit. Words of short texts scatter more, so their limit grows as
the length falls; texts shorter than ``min_characters`` are not judged by their characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaweave.llm.kernel import blocks, fresh, tidy
from deltaweave.llm.text_stats import CLASSES, COMMON_WORDS, LANGUAGES, VOCABULARY, block_stats

#: Share of a text's words that are common words of a language, from which it is evidence of it.
EVIDENCE = 0.12
_MEMBER = np.array([[w in COMMON_WORDS[lang] for w in VOCABULARY] for lang in LANGUAGES], dtype=np.int64)


@dataclass(frozen=True)
class Limits:
    """Jensen-Shannon distances (0 to 1) above which a text is rejected, and a length guard.

    ``words`` holds from ``min_words`` words on; for n fewer words it is multiplied by
    (min_words / n) to the power ``growth``. Both were chosen on the labels of sf0.1 outside the
    fold crc32(doc_id) % 4 = 2.
    """

    characters: float = 0.25
    words: float = 0.25
    min_characters: int = 200
    min_words: int = 200
    growth: float = 0.35

    def word_limit(self, n_words: np.ndarray) -> np.ndarray:
        return self.words * np.maximum(self.min_words / np.maximum(n_words, 1), 1) ** self.growth


def base_failed(stats: dict[str, np.ndarray]) -> np.ndarray:
    return (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


def language_of(common: np.ndarray) -> np.ndarray:
    """Index of the language whose common words a text shows most; -1 without any."""
    share = common @ _MEMBER.T
    return np.where(share.max(axis=1) > 0, share.argmax(axis=1), -1)


def evident(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Whether enough of a text's words are common words of one language."""
    return (stats["common"] @ _MEMBER.T).max(axis=1) >= EVIDENCE * np.maximum(stats["n_words"], 1)


def word_histogram(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Counts of the common words and, last, of all other words."""
    common = stats["common"]
    return np.column_stack([common, stats["n_words"] - common.sum(axis=1)])


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distance (base 2, 0 to 1) of each row of counts ``p`` from the distribution ``q``."""
    total = p.sum(axis=1, keepdims=True)
    p = np.divide(p, total, out=np.zeros(p.shape), where=total > 0)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def references(docs: DataFrame, text_col: str = "text") -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Character-class and common-word distributions of each language found in the corpus, from
    all its documents: one scan, and a shuffle of sums of languages x bins a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(LANGUAGES), len(CLASSES) + len(VOCABULARY) + 1), dtype=np.int64)
        for batch in batches:
            for block in blocks(batch.column(0)):
                stats = block_stats(block)
                language = np.where(base_failed(stats) | ~evident(stats), -1, language_of(stats["common"]))
                both = np.column_stack([stats["classes"], word_histogram(stats)])
                np.add.at(sums, language[language >= 0], both[language >= 0])
        at, bin_ = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bin_), pa.array(sums[at, bin_])], names=["language", "bin", "n"])

    summed = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "language long, bin long, n long").groupBy("language", "bin").agg(F.sum("n").alias("n"))
    out: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    counts = np.zeros((len(LANGUAGES), len(CLASSES) + len(VOCABULARY) + 1))
    for row in summed.collect():  # at most languages x bins rows
        counts[row.language, row.bin] = row.n
    for k, name in enumerate(LANGUAGES):
        if counts[k].sum():
            chars, common = counts[k, : len(CLASSES)], counts[k, len(CLASSES) :]
            out[name] = chars / chars.sum(), common / max(common.sum(), 1)
    return out


def distances(stats: dict[str, np.ndarray], refs: dict[str, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, the distances of both histograms from the nearest reference of either."""
    rows = len(stats["n_words"])
    if not refs:
        return np.zeros(rows), np.zeros(rows)
    hist = word_histogram(stats)
    return (
        np.min([jensen_shannon(stats["classes"], c) for c, _ in refs.values()], axis=0),
        np.min([jensen_shannon(hist, w) for _, w in refs.values()], axis=0),
    )


def judge(docs: DataFrame, refs: dict[str, tuple[np.ndarray, np.ndarray]] | None = None, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False, verdict: str = "_quality", kept_only: bool = False) -> DataFrame:
    """Base counts, both distances, ``base_failed`` and ``kept`` of every whole text, whatever its
    length. Judging is one scan; without ``refs`` another one fits them before.

    Null and empty texts have no words and fail the base rule. With ``keep_columns`` all input
    columns come first and the verdicts follow in one struct ``verdict`` (underscores are added
    where the input has a column of that name; ``kept_only`` gives the input columns of the kept
    rows instead). Repeated rows are judged alike; an empty table has no references and gives no
    rows.
    """
    refs = references(docs, text_col) if refs is None else refs
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    fields = ", ".join(f"{n}: bigint" for n in names) + ", base_failed: boolean, char_distance: double, word_distance: double, kept: boolean"
    kind = docs.schema[id_col].dataType.simpleString()

    def verdicts(texts: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
        for block in blocks(texts):
            stats = block_stats(block)
            failed = base_failed(stats)
            chars, common = distances(stats, refs)
            far = ~evident(stats) if not refs else ((chars > limits.characters) & (stats["classes"].sum(axis=1) >= limits.min_characters)) | (common > limits.word_limit(stats["n_words"]))
            arrays = [pa.array(stats[n].astype(np.int64)) for n in names] + [pa.array(failed), pa.array(chars), pa.array(common), pa.array(~failed & ~far)]
            yield block.first, block.rows, arrays

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, arrays in verdicts(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), *arrays], names=["id", *names, "base_failed", "char_distance", "word_distance", "kept"])

    if not keep_columns:
        return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "id " + kind + ", " + fields.replace(":", "")).withColumnRenamed("id", id_col)

    # columns go by place, so their names cannot clash with the verdicts' or with each other
    at, inner = docs.columns.index(text_col), [f"c{k}" for k in range(len(docs.columns))]

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, arrays in verdicts(batch.column(at).cast(pa.string())):
                verdicts_ = pa.StructArray.from_arrays(arrays, names=[*names, "base_failed", "char_distance", "word_distance", "kept"])
                part = batch.slice(first, rows)
                yield pa.RecordBatch.from_arrays([*part.columns, verdicts_], names=[*inner, "v"])

    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(inner, docs.schema.fields, strict=True))
    judged = docs.toDF(*inner).mapInArrow(tidy(wide), f"{schema}, v struct<{fields}>")
    columns = [F.col(n).alias(c) for n, c in zip(inner, docs.columns, strict=True)]
    if kept_only:
        return judged.where("v.kept").select(*columns)
    return judged.select(*columns, F.col("v").alias(fresh(verdict, docs.columns)))


def digests(judged: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return judged.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
