"""Toxicity by a weighted finite-state grammar over clauses.

Words become the symbols insult, threat, target, negation, report and other. Five small
transducers read them: the insult transducer marks insults, the target transducer aims them, the
threat transducer marks a threat that meets a target, and the negation and reported-speech
transducers re-mark what lies in their scope. Their composition is one machine that is reset at
each clause border. A clause makes one match, of its strongest kind and with the weight of its
path: what is asserted counts, and only where nothing is, what is negated or reported. A document is scored by its matched clauses: asserted
kinds can only raise the score, negated and reported ones only lower it. The insult lexicon (word
forms and word beginnings, for inflected languages; mild where only their repetition tells) and
the weights of the kinds are learned from a bounded labelled sample; a kind that the sample does
not show keeps the grammar's own weight.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaweave.llm.kernel import Hasher, blocks, per_row, runs
from deltaweave.llm.storage import cut

OTHER, INSULT, MILD, THREAT, TARGET, NEGATION, REPORT = range(7)

#: Closed-class words of four languages; fixed values.
THREATS = frozenset("kill hurt destroy beat burn smash töten umbringen verletzen tuer frapper détruire matar destruir golpear".split())
TARGETS = frozenset("you your he she they him her them these those people everyone du ihr euch sie er tu vous toi ils elles tú usted ustedes ellos ellas vosotros".split())
NEGATIONS = frozenset("not never no nobody isn aren wasn don doesn didn nicht kein keine nie niemals ne pas jamais aucun aucune no nunca jamás ningún".split())
REPORTS = frozenset("said says wrote claimed called quoted reported sagte schrieb nannte behauptete dit écrit appelé affirmé dijo escribió llamó afirmó".split())

#: Kinds of matches that the composed machine emits, from the strongest; the first four assert.
KINDS = ("threat", "aimed", "insult", "mild", "negated", "reported")
ASSERTED = 4
#: What the logistic layer reads: the clauses of each kind by their path's weight, and per 100
#: words the weight of asserted clauses, with and without the mild ones.
SIGNALS = (*KINDS, "density", "strong_density")
#: The weights that hold where the sample says nothing.
PRIOR = np.array([2.5, 2.5, 2.0, 0.5, -1.0, -0.5, 0.5, 0.5])
_PLACE: dict[object, int] = {kind: k for k, kind in enumerate(KINDS)}
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[.!?;:\n]")
_BORDER = frozenset(b".!?;:\n")
PREFIX_BYTES = (3, 4, 5, 6, 7, 8, 9, 10)


@dataclass(frozen=True)
class Transducer:
    """A finite-state transducer: ``arcs[state, symbol] = (output, weight, next state)``.

    Symbols without an arc are copied and lead to ``arcs[state, None]``'s state, or stay.
    """

    arcs: dict[tuple[object, object], tuple[object, float, object]]
    start: object = 0

    def step(self, state: object, symbol: object) -> tuple[object, float, object]:
        if (arc := self.arcs.get((state, symbol))) is not None:
            return arc
        _, weight, after = self.arcs.get((state, None), (None, 0.0, state))
        return symbol, weight, after

    def __matmul__(self, other: Transducer) -> Transducer:
        """Composition: what this one writes, ``other`` reads; weights add."""
        symbols = {s for _, s in self.arcs if s is not None} | {s for _, s in other.arcs if s is not None} | set(range(7))
        arcs, todo, seen = {}, [(self.start, other.start)], set()
        while todo:
            if (pair := todo.pop()) in seen:
                continue
            seen.add(pair)
            for symbol in symbols:
                middle, w1, left = self.step(pair[0], symbol)
                out, w2, right = other.step(pair[1], middle)
                arcs[pair, symbol] = out, w1 + w2, (left, right)
                todo.append((left, right))
        return Transducer(arcs, (self.start, other.start))


def scope(trigger: int, marks: dict[object, object], span: int, weight: float = 0.0) -> Transducer:
    """After ``trigger``, re-mark the symbols of ``marks`` among the next ``span`` words."""
    arcs: dict[tuple[object, object], tuple[object, float, object]] = {(0, trigger): (trigger, 0.0, span)}
    for k in range(1, span + 1):
        arcs[k, trigger] = (trigger, 0.0, span)
        arcs[k, None] = (None, 0.0, k - 1)
        for old, new in marks.items():
            arcs[k, old] = (new, weight, k - 1)
    return Transducer(arcs)


def grammar() -> Transducer:
    """insult, then target, threat, negation and reported speech, composed left to right."""
    insult = Transducer({(0, INSULT): ("insult", 1.0, 0), (0, MILD): ("mild", 0.5, 0)})
    target = scope(TARGET, {"insult": "aimed"}, 4, 0.25)
    threat = scope(THREAT, {TARGET: "threat"}, 3, 1.25)  # it is aimed by nature
    asserted = ("insult", "mild", "aimed", "threat")
    negation = scope(NEGATION, dict.fromkeys(asserted, "negated"), 4)
    reported = scope(REPORT, dict.fromkeys(("negated", *asserted), "reported"), 8)
    return insult @ target @ threat @ negation @ reported


@dataclass
class Model:
    """Lexicon of word forms and beginnings, and a logistic layer over clause matches."""

    forms: tuple[bytes, ...] = ()
    beginnings: tuple[bytes, ...] = ()
    mild: frozenset[bytes] = frozenset()
    weights: np.ndarray = field(default_factory=PRIOR.copy)
    intercept: float = -3.0

    def compiled(self) -> Matcher:
        return Matcher(self)


def _hashes(words: tuple[bytes, ...]) -> np.ndarray:
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    return Hasher(data, lower=True).ranges(ends - [len(w) for w in words], ends) if words else np.zeros(0, dtype=np.uint64)


class Matcher:
    """Finds the texts with a lexicon or threat word in bulk, and runs the machine over those."""

    def __init__(self, model: Model) -> None:
        self.machine = grammar()
        self.forms, self.beginnings, self.mild = frozenset(model.forms), frozenset(model.beginnings), model.mild
        self.lengths = sorted({len(b) for b in model.beginnings})
        threats = tuple(t.encode() for t in sorted(THREATS))
        self.whole = np.sort(_hashes((*model.forms, *threats)))
        self.by_length = {n: np.sort(_hashes(tuple(b for b in model.beginnings if len(b) == n))) for n in self.lengths}
        self.closed = {w.encode(): kind for kind, words in ((THREAT, THREATS), (TARGET, TARGETS), (REPORT, REPORTS), (NEGATION, NEGATIONS)) for w in words}

    def symbol(self, word: bytes) -> int:
        found = word if word in self.forms else next((word[:n] for n in self.lengths if n <= len(word) and word[:n] in self.beginnings), None)
        if found is not None:
            return MILD if found in self.mild else INSULT
        return self.closed.get(word, OTHER)

    def matches(self, text: bytes) -> np.ndarray:
        """Clauses of one text by the kind of their match, each weighted along the machine's path."""
        total = np.zeros(len(KINDS))
        step, state, start = self.machine.step, self.machine.start, self.machine.start
        path: dict[int, float] = {}

        def close() -> None:
            if path:
                kind = min(path)
                total[kind] += sum(w for k, w in path.items() if k < ASSERTED or k == kind)
                path.clear()

        for token in _TOKEN.findall(text.lower()):
            if token[0] in _BORDER:
                close()
                state = start
                continue
            out, weight, state = step(state, self.symbol(token))
            if (kind := _PLACE.get(out)) is not None:
                path[kind] = path.get(kind, 0.0) + weight
        close()
        return total

    def batch(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
        """For each block: first row, rows, signals."""
        for block in blocks(texts):
            token = runs(_LETTER[block.data], block.offsets)
            hasher = Hasher(block.data, lower=True)
            sizes = token.ends - token.starts
            hit = np.zeros(len(sizes), dtype=bool)
            if len(self.whole):
                hit |= _among(hasher.ranges(token.starts, token.ends), self.whole)
            for n, known in self.by_length.items():
                at = np.flatnonzero(sizes >= n)
                hit[at[_among(hasher.ranges(token.starts[at], token.starts[at] + n), known)]] = True
            out = np.zeros((block.rows, len(SIGNALS)))
            for row in np.flatnonzero(per_row(hit, token.bounds)).tolist():
                out[row, : len(KINDS)] = self.matches(block.data[block.offsets[row] : block.offsets[row + 1]].tobytes())
            share = 100 / np.maximum(token.counts, 20)
            out[:, -2], out[:, -1] = share * out[:, :ASSERTED].sum(axis=1), share * out[:, : KINDS.index("mild")].sum(axis=1)
            yield block.first, block.rows, out


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the sorted known ones."""
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def shapes(text: bytes) -> dict[bytes, int]:
    """Word forms (led by ``=``) and beginnings of a text's words, with their occurrences."""
    out: Counter[bytes] = Counter()
    for word, n in Counter(re.findall(rb"[a-z\x80-\xff]{3,40}", text.lower())).items():
        out[b"=" + word] += n
        for size in PREFIX_BYTES:
            if size < len(word) and not 128 <= word[size] < 192:
                out[word[:size]] += n
    return out


def learn_lexicon(sample: DataFrame, n_toxic: int, n_clean: int, most: int = 600, least: int = 6, odds: float = 3.0) -> tuple[tuple[bytes, ...], tuple[bytes, ...], frozenset[bytes]]:
    """Forms and beginnings far commoner in toxic texts, and which of them are mild: far
    commoner only as repeated. Of shapes that say the same, the most specific stays.

    ``sample`` has ``toxic`` and ``text``. Counts are summed in Spark; at most ``8 * most``
    candidates reach the driver.
    """
    names = ["clean", "toxic", "clean_again", "toxic_again"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter[bytes], ...] = tuple(Counter() for _ in names)
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = shapes((text or "").encode())
                counts[int(toxic)].update(found.keys())
                counts[2 + int(toxic)].update(k for k, n in found.items() if n > 1)
        keys = list(counts[1].keys())  # shapes of clean texts alone cannot be chosen ...
        keys += [k for k in counts[0] if k not in counts[1]]  # ... but their counts add up
        yield pa.RecordBatch.from_arrays([pa.array(keys, type=pa.binary()), *(pa.array([c[k] for k in keys], type=pa.int64()) for c in counts)], names=["shape", *names])

    summed = sample.select("toxic", "text").mapInArrow(run, "shape binary, " + ", ".join(f"{n} long" for n in names)).groupBy("shape").agg(*(F.sum(n).alias(n) for n in names))

    def lift(clean: str, toxic: str) -> Column:
        return F.log((F.col(toxic) + 0.5) / (n_toxic + 1)) - F.log((F.col(clean) + 0.5) / (n_clean + 1))

    support = max(least, n_toxic // 200)
    strong = F.when(F.col("toxic") >= support, lift("clean", "toxic")).otherwise(0.0)
    mild = F.when(F.col("toxic_again") >= support, lift("clean_again", "toxic_again")).otherwise(0.0)
    best = (
        summed.select("shape", strong.alias("strong"), mild.alias("mild"), "toxic", "toxic_again")
        .where((F.col("strong") >= odds) | (F.col("mild") >= odds))
        .withColumn("hits", F.when(F.col("strong") >= odds, F.col("toxic")).otherwise(F.col("toxic_again")))
        .withColumn("gain", F.greatest("strong", "mild") * F.sqrt("hits"))
        .orderBy(F.desc("gain"), "shape")
        .limit(8 * most)
        .collect()
    )
    found = {bytes(r["shape"]): r for r in best}
    forms: list[bytes] = []
    beginnings: list[bytes] = []
    gentle = set()
    for shape in sorted(found, key=lambda s: (-round(found[s].gain, 6), -len(s), s)):
        word, hits = shape.removeprefix(b"="), found[shape].hits
        chosen = [(b"=" + f, f) for f in forms] + [(b, b) for b in beginnings]
        if word in forms or any(word.startswith(b) for b in beginnings):
            continue
        if shape == word and any(w.startswith(word) and hits < 1.2 * found[s].hits for s, w in chosen):
            continue
        (beginnings if shape == word else forms).append(word)
        if found[shape].strong < odds:
            gentle.add(word)
        if len(forms) + len(beginnings) >= most:
            break
    return tuple(forms), tuple(beginnings), frozenset(gentle)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_toxic: int = 4_000, max_clean: int = 8_000) -> Model:
    """A model of at most ``max_toxic`` and ``max_clean`` labelled documents, the first by a
    hash of their id. The sample is written once in the shared folder; only lexicon candidates
    and match counts are collected."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_label_id"), F.col(label_col).cast("int").alias("toxic"))
    order = (F.xxhash64("_label_id"), F.col("toxic"))
    chosen = known.where("toxic = 1").orderBy(*order).limit(max_toxic).unionByName(known.where("toxic = 0").orderBy(*order).limit(max_clean))
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), F.col("_id") == F.col("_label_id")).select("_id", "toxic", "text")
    sample = cut(sample)
    counts = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Model(intercept=math.log(0.95 / 0.05) if counts.get(1) else math.log(0.05 / 0.95))
    model = Model(*learn_lexicon(sample.repartition(8, F.xxhash64("_id")), counts[1], counts[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.compiled()
        for batch in batches:
            for first, rows, found in matcher.batch(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), *(pa.array(found[:, k]) for k in range(len(SIGNALS)))], names=["toxic", *SIGNALS])

    got = sample.select("toxic", "text").mapInArrow(run, "toxic int, " + ", ".join(f"{k} double" for k in SIGNALS)).toPandas()
    x, y = np.log1p(got[list(SIGNALS)].to_numpy(dtype=float)), got["toxic"].to_numpy(dtype=float)
    model.weights, model.intercept = _logistic(x, y)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 800) -> tuple[np.ndarray, float]:
    """Weights near the grammar's own and intercept. More asserted clauses never mean less toxic,
    an aimed insult weighs no less than another, and denials and quotations never mean more."""
    order = np.lexsort((*x.T, y))  # sums in a fixed order, whatever the tasks' order
    x, y = x[order], y[order]
    z = np.column_stack([x, np.ones(len(x))])
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    rate = 1 / (0.25 * np.linalg.norm(z * np.sqrt(share)[:, None], 2) ** 2 + ridge)
    asserted = [k for k, name in enumerate(SIGNALS) if name not in ("negated", "reported")]
    doubted = [SIGNALS.index("negated"), SIGNALS.index("reported")]
    prior = np.r_[PRIOR, 0.0]
    w = prior.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= rate * (z.T @ (share * (p - y)) + ridge * (w - prior))
        w[asserted] = np.maximum(w[asserted], 0)
        w[doubted] = np.minimum(w[doubted], -0.05)
        w[SIGNALS.index("aimed")] = max(w[SIGNALS.index("aimed")], w[SIGNALS.index("insult")])
    return w[:-1], float(w[-1])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``id_col``, ``score``, ``predicted`` and the matched clauses of each kind of every whole
    text, whatever its length.

    Null and empty texts have no matches. Repeated rows get equal
    scores; an empty table gives no rows; other columns are dropped. No shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.compiled()
        for batch in batches:
            for first, rows, found in matcher.batch(batch.column(1)):
                p = 1 / (1 + np.exp(-(np.log1p(found) @ model.weights + model.intercept)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, rows), pa.array(p), pa.array((p >= threshold).astype(np.int32)), *(pa.array(found[:, k]) for k in range(len(SIGNALS)))],
                    names=["id", "score", "predicted", *SIGNALS],
                )

    schema = f"id {kind}, score double, predicted int, " + ", ".join(f"{k} double" for k in SIGNALS)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
