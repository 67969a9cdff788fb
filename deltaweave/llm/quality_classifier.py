"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Boosted shallow trees are grown on a bounded sample of labelled rows; every path from a root
becomes a conjunction of thresholds; a lasso logistic regression keeps few of these rules; and
the kept ones compile into one Spark column expression, so scoring is plain column arithmetic
over the statistics.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaweave.llm.kernel import blocks
from deltaweave.llm.text_stats import CLASSES, block_stats

FEATURES = (
    "log_words", "mean_word", "symbols", "uppers", "digits", "stops", "others", "beyond", "newlines",
    "dup_lines", "repeats", "distinct", "common", "pipes", "bangs", "periods", "stutters", "long_words",
)


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Scale-free statistics of texts, one row each; all 0 for a text without words."""
    at = {name: stats["classes"][:, k].astype(float) for k, name in enumerate(CLASSES)}
    chars = np.maximum(stats["classes"].sum(axis=1), 1)
    n = np.maximum(stats["n_words"], 1)
    letters = np.maximum(at["lower"] + at["upper"], 1)
    columns = [
        np.log1p(stats["n_words"]), stats["word_chars"] / n, at["symbol"] / chars, at["upper"] / letters, at["digit"] / chars, at["stop"] / n, at["other"] / chars, at["beyond"] / chars, at["newline"] / n,
        stats["n_dup_lines"] / np.maximum(stats["n_lines"], 1), stats["n_repeat_words"] / n, stats["n_distinct"] / n, stats["common"].sum(axis=1) / n, stats["n_pipes"] / n, stats["n_bangs"] / n, stats["n_stops"] / n, stats["n_stutters"] / n, stats["n_long"] / n,
    ]
    return np.round(np.column_stack(columns), 6)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, is_above, threshold) and its weight."""

    terms: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for f, above, cut in self.terms:
            out &= (x[:, f] > cut) if above else (x[:, f] <= cut)
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for f, above, cut in self.terms:
            out = out & ((F.col(FEATURES[f]) > cut) if above else (F.col(FEATURES[f]) <= cut))
        return out


def _grow(x: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, depth: int, least: int) -> tuple[list[tuple], np.ndarray]:
    """One regression tree by histogram splits: paths of all its nodes, and its step."""
    step, paths = np.zeros(len(x)), []

    def split(rows: np.ndarray, path: tuple) -> None:
        g, h = gradient[rows].sum(), hessian[rows].sum()
        best = None
        if len(path) < depth and len(rows) >= 2 * least:
            base = g * g / (h + 1)
            for f, edges in enumerate(cuts):
                if not len(edges):
                    continue
                slot = np.searchsorted(edges, x[rows, f], side="left")
                gs, hs, ns = (np.bincount(slot, weights=w, minlength=len(edges) + 1)[:-1].cumsum() for w in (gradient[rows], hessian[rows], np.ones(len(rows))))
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - base
                gain[(ns < least) | (len(rows) - ns < least)] = -1
                k = int(gain.argmax())
                if gain[k] > 1e-3 and (best is None or gain[k] > best[0]):
                    best = gain[k], f, float(edges[k])
        if best is None:
            step[rows] = -g / (h + 1)
            return
        _, f, cut = best
        above = x[rows, f] > cut
        for flag in (False, True):
            paths.append((*path, (f, flag, cut)))
            split(rows[above == flag], paths[-1])

    split(np.arange(len(x)), ())
    return paths, step


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.4, bins: int = 48, most: int = 240) -> list[Rule]:
    """Distinct rules of boosted trees, at most ``most`` of them, earlier trees first."""
    cuts = []
    for f in range(x.shape[1]):
        values = np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)))
        cuts.append((values[1:] + values[:-1]) / 2)
    margin, seen = np.zeros(len(x)), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        paths, step = _grow(x, cuts, p - y, np.maximum(p * (1 - p), 1e-6), depth, max(5, len(x) // 500))
        margin += rate * step
        for path in paths:
            tight: dict[tuple[int, bool], float] = {}
            for f, above, cut in path:
                old = tight.get((f, above), cut)
                tight[f, above] = max(old, cut) if above else min(old, cut)
            seen.setdefault(tuple(sorted((f, a, c) for (f, a), c in tight.items())), None)
    return [Rule(terms) for terms in list(seen)[:most]]


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 600) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient; the intercept is free."""
    n, k = z.shape
    z1 = np.column_stack([z, np.ones(n)])
    lipschitz = 0.25 * np.linalg.norm(z1, 2) ** 2 / n + 1e-9
    w = v = np.zeros(k + 1)
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z1 @ v, -30, 30)))
        new = v - z1.T @ (p - y) / n / lipschitz
        new[:k] = np.sign(new[:k]) * np.maximum(np.abs(new[:k]) - penalty / lipschitz, 0)
        t, old = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        v, w = new + (old - 1) / t * (new - w), new
    return w[:k], float(w[k])


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[Rule, ...]
    intercept: float

    def score_column(self) -> Column:
        """The probability of label 1 as a column over the feature columns."""
        total = F.lit(self.intercept)
        for rule in self.rules:
            total = total + F.when(rule.column(), F.lit(rule.weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule in self.rules:
            total += np.where(rule.holds(x), rule.weight, 0.0)
        return 1 / (1 + np.exp(-total))


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = 5e-4) -> RuleModel:
    """The sparse ensemble of a sample; a constant score when it shows one label only."""
    if len(y) == 0 or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.5, 0.02, 0.98))
        return RuleModel((), math.log(p / (1 - p)))
    rules = grow_rules(x, y)
    z = np.column_stack([r.holds(x) for r in rules]).astype(float)
    weights, intercept = lasso_logistic(z, y, penalty)
    kept = tuple(Rule(r.terms, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6)
    return RuleModel(kept, intercept)


def with_features(docs: DataFrame, id_col: str, text_col: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """``id``, the extra columns and FEATURES of every whole text; no shuffle."""
    kept = [F.col(id_col).alias("id"), *(F.col(c) for c in extra)]
    picked = docs.select(*kept, F.col(text_col).cast("string").alias("_text"))
    names = [f.name for f in picked.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(batch.num_columns - 1)):
                x = features(block_stats(block))
                part = [batch.column(k).slice(block.first, block.rows) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*part, *(pa.array(x[:, k]) for k in range(x.shape[1]))], names=[*names, *FEATURES])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]] + [f"{n} double" for n in FEATURES])
    return picked.mapInArrow(run, schema)


def sample_labels(labels: DataFrame, id_col: str, label_col: str, most: int) -> DataFrame:
    """At most ``most`` labelled ids, the first by a hash of the id: a sample fixed by the data."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_label_id"), F.col(label_col).cast("double").alias("_label"))
    return known.orderBy(F.xxhash64("_label_id"), "_label").limit(most)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_train: int = 20_000) -> RuleModel:
    """A model of at most ``max_train`` labelled documents; only their statistics are collected."""
    chosen = F.broadcast(sample_labels(labels, id_col, label_col, max_train))
    joined = docs.select(F.col(id_col), F.col(text_col)).join(chosen, F.col(id_col) == F.col("_label_id"))
    got = with_features(joined, id_col, text_col, ("_label",)).toPandas().sort_values("id", kind="stable")
    return fit_rules(got[list(FEATURES)].to_numpy(dtype=float), got["_label"].to_numpy(dtype=float))


def score(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``id_col``, ``score`` (0 to 1) and ``predicted`` of every whole text.

    Null and empty texts are scored as texts without words. Repeated rows get equal scores; an
    empty table gives no rows; other columns are dropped.
    """
    scored = with_features(docs, id_col, text_col).select(F.col("id").alias(id_col), model.score_column().alias("score"))
    return scored.select(id_col, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
