"""Exact n-gram Jaccard join by blocked sparse products of document-by-shingle incidence.

Documents with equal shingle sets form a class (128-bit signature); classes are joined:

1. A hash range of all shingles is counted by class. A class with more shingles found to be
   unique than a pair may miss cannot have a partner and leaves (a size-derived bound).
2. The rest, the candidates, give their whole incidence rows. Shingles of one class alone are
   dropped; the others are ordered by frequency, rarest first, and of each class only the
   prefix that any partner must touch is kept.
3. Inside a shingle's column, classes are first multiplied with one pivot each (a linear number
   of pairs), several times with different pivots. Columns that are then connected need no more.
4. What is still apart in a column of many classes is split by a second shingle: classes that
   can reach the limit share two in prefixes longer by one. All pairs across components that meet in a
   column or such a pair of shingles, and that the size and place bounds allow, are multiplied too, so no link
   between components is lost.

A product's block is one incidence row and the rows that it is multiplied with, taken from the
columns in strips: overlaps are accumulated strip by strip, and after each strip the pairs leave
that can no longer reach the limit with the entries that remain. The rows of a block are dealt over
as many tasks as they need. Equality of shingles is equality of 64-bit hashes inside a pair.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltaweave.llm.components import EDGES_A_TASK, components
from deltaweave.llm.kernel import U64, Block, Hasher, blocks, mix, tidy, window_owner_mask, windows, words
from deltaweave.llm.storage import arrow_rows, cut, release

#: Share of the hash space whose shingles are counted in step 1, and bits of its keys.
SAMPLED, KEY_BITS = 0.4, 48
#: Candidates up to which a bitmap of them is broadcast (2**27 bits at most); a join beyond.
BITMAP_CLASSES, BITMAP_BITS, BITMAP_BLOCK = 1 << 23, 27, 1 << 16
#: Classes that a task remembers to leave out copies; more only mean repeated rows.
REMEMBERED = 1_000_000
#: Rows of a part of a product's block; strips of the hash space, as a power of two.
BLOCK_ROWS, STRIP_BITS = 2_000, 3
#: Rows of an Arrow batch, each with a document's text or shingles.
ARROW_ROWS = 1_000
#: Classes up to which a column's remaining pairs are all tried: a pair tried in a task costs far
#: less than a row shuffled. Larger columns are split by a second shingle.
SPLIT = 4096
#: Classes from which a shingle's column is hot, and the most heavy shingles broadcast (16 MB).
HOT_COLUMN, HEAVY = 1_000, 1 << 20


class Sets:
    """Distinct shingles of a block's documents, row by row, with class signatures."""

    def __init__(self, block: Block, width: int) -> None:
        found = words(block)
        hashes = Hasher(block.data, lower=True).ranges(found.starts, found.ends)
        counts = found.counts
        inside = window_owner_mask(found.bounds, width, len(hashes))
        owners = found.owners()[: len(inside)][inside]
        grams = windows(hashes, width, 5)[inside]
        few = np.flatnonzero((counts > 0) & (counts < width))
        if len(few):  # the whole sequence is one shingle
            whole = np.zeros(len(few), dtype=U64)
            for k in range(width - 1):
                has = counts[few] > k
                at = np.minimum(found.bounds[few] + k, len(hashes) - 1)
                whole = np.where(has, mix(whole * U64(0x9E3779B97F4A7C55) + hashes[at], 17), whole)
            owners, grams = np.r_[owners, few], np.r_[grams, whole]
        order = np.lexsort((grams, owners))
        owners, grams = owners[order], grams[order]
        if len(grams):
            new = np.r_[True, (grams[1:] != grams[:-1]) | (owners[1:] != owners[:-1])]
            owners, grams = owners[new], grams[new]
        self.owners, self.grams = owners, grams
        self.bounds = np.searchsorted(owners, np.arange(block.rows + 1))
        self.sizes = np.diff(self.bounds)
        self.first, self.second = (self._sum(mix(grams, seed)) for seed in (1, 2))

    def _sum(self, values: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(values) + 1, dtype=U64)
        np.cumsum(values, out=sums[1:])
        return mix(sums[self.bounds[1:]] - sums[self.bounds[:-1]] + self.sizes.astype(U64), 3)

    def keys(self) -> pa.Array:
        """The signature as 16 bytes."""
        both = np.column_stack([self.first, self.second]).tobytes()
        marks = (16 * np.arange(len(self.sizes) + 1)).astype(np.int32).tobytes()
        return pa.Array.from_buffers(pa.binary(), len(self.sizes), [None, pa.py_buffer(marks), pa.py_buffer(both)])


class Fresh:
    """Which classes a task has not met yet."""

    def __init__(self) -> None:
        self.seen: set[int] = set()

    def __call__(self, sets: Sets, wanted: np.ndarray | None = None) -> np.ndarray:
        out = np.zeros(len(sets.sizes), dtype=bool)
        for row in np.flatnonzero(sets.sizes if wanted is None else (sets.sizes > 0) & wanted).tolist():
            if (key := int(sets.first[row])) not in self.seen:
                self.seen.add(key)
                out[row] = True
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        return out


def _members(docs: DataFrame, width: int) -> DataFrame:
    """``id, n, c, c1``: set size, class signature and its first half of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                sets = Sets(block, width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.rows), pa.array(sets.sizes.astype(np.int64)), sets.keys(), pa.array(sets.first.view(np.int64))], names=["id", "n", "c", "c1"])

    return docs.mapInArrow(tidy(run), "id long, n long, c binary, c1 long")


def _sampled(docs: DataFrame, width: int) -> DataFrame:
    """``s, c1``: shingles of the sampled hash range, once a class and task."""
    limit, shift = U64(int(SAMPLED * 2.0**64)), U64(64 - KEY_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = Fresh()
        for batch in batches:
            for block in blocks(batch.column(1)):
                sets = Sets(block, width)
                at = np.flatnonzero((sets.grams < limit) & fresh(sets)[sets.owners]) if len(sets.grams) else np.zeros(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((sets.grams[at] >> shift).view(np.int64)), pa.array(sets.first[sets.owners[at]].view(np.int64))], names=["s", "c1"])

    return docs.mapInArrow(tidy(run), "s long, c1 long")


def _bitmap(classes: DataFrame, count: int) -> tuple[np.ndarray, int]:
    """Bits of the classes' hashed signatures (column ``c1``), merged block by block."""
    bits = min(BITMAP_BITS, max(16, (16 * count).bit_length()))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen = None, np.zeros(BITMAP_BLOCK, dtype=bool)
        for batch in batches:
            cells = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.r_[True, cells[1:] >> 16 != cells[:-1] >> 16]) if len(cells) else []
            for a, b in zip(cuts, [*cuts[1:], len(cells)], strict=True):
                if at is not None and cells[a] >> 16 != at:
                    yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([zlib.compress(np.packbits(seen).tobytes(), 1)])], names=["block", "bits"])
                    seen[:] = False
                at = int(cells[a] >> 16)
                seen[cells[a:b] & (BITMAP_BLOCK - 1)] = True
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([zlib.compress(np.packbits(seen).tobytes(), 1)])], names=["block", "bits"])

    cell = F.shiftrightunsigned(F.xxhash64("c1"), 64 - bits).alias("cell")
    merged = classes.select(cell).repartition(F.shiftright("cell", 16)).sortWithinPartitions("cell").mapInArrow(tidy(merge), "block long, bits binary")
    out = np.zeros((max(1, (1 << bits) // BITMAP_BLOCK), BITMAP_BLOCK // 8), dtype=np.uint8)
    for row in merged.toLocalIterator():
        out[row.block] = np.frombuffer(zlib.decompress(row.bits), dtype=np.uint8)
    return out.reshape(-1), bits


def _candidate_sets(docs: DataFrame, members: DataFrame, classes: DataFrame, count: int, width: int) -> DataFrame:
    """``c, c1, n, grams`` of the candidate classes (and maybe a few more), once a class and task."""
    if count <= BITMAP_CLASSES:
        bitmap, bits = _bitmap(classes, count)
        # the same hash as in the bitmap is computed natively from c1 after the set is known
        shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    else:
        docs = docs.join(members.join(classes.select("c"), "c", "left_semi").select("id"), "id", "left_semi")
        shared, bits = None, 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = Fresh()
        for batch in batches:
            for block in blocks(batch.column(1)):
                sets = Sets(block, width)
                if shared is None:
                    wanted = None
                else:
                    cells = (_xxhash64(sets.first) >> U64(64 - bits)).astype(np.int64)
                    wanted = (shared.value[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1
                rows = np.flatnonzero(fresh(sets, wanted))
                keep = np.zeros(block.rows, dtype=bool)
                keep[rows] = True
                flat = sets.grams[keep[sets.owners]].view(np.int64) if len(sets.grams) else np.zeros(0, dtype=np.int64)
                marks = np.r_[0, np.cumsum(sets.sizes[rows])].astype(np.int32)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([sets.keys().take(take), pa.array(sets.first[rows].view(np.int64)), pa.array(sets.sizes[rows].astype(np.int64)), pa.ListArray.from_arrays(pa.array(marks), pa.array(flat))], names=["c", "c1", "n", "grams"])

    return docs.select("id", "text").mapInArrow(tidy(run), "c binary, c1 long, n long, grams array<long>")


def _xxhash64(values: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of one long column (seed 42); fixed constants of the XXH64 algorithm."""
    p1, p2, p3, p4, p5 = (U64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def rotate(x: np.ndarray, r: int) -> np.ndarray:
        return (x << U64(r)) | (x >> U64(64 - r))

    h = (U64(42) + p5 + U64(8)) ^ (rotate(values * p2, 31) * p1)
    h = rotate(h, 27) * p1 + p4
    h = (h ^ (h >> U64(33))) * p2
    h = (h ^ (h >> U64(29))) * p3
    return h ^ (h >> U64(32))


def _fits(n1: Column, n2: Column) -> Column:
    """Sizes of which a pair can reach 75 percent."""
    return 4 * F.least(n1, n2) >= 3 * F.greatest(n1, n2)


def _reaches(n1: Column, p1: Column, n2: Column, p2: Column) -> Column:
    """Whether a pair whose first common shingle has these places can still reach it."""
    return 7 * F.least(n1 - p1, n2 - p2) >= 3 * (n1 + n2)


def _overlaps(block: np.ndarray, rows: np.ndarray, sizes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which rows of a block (their shingles ``block``, each one's row in ``rows``) reach the
    limit with one sorted incidence row: a sparse product in strips of the hash space."""
    live = (4 * np.minimum(sizes, len(row)) >= 3 * np.maximum(sizes, len(row))) & (sizes > 0)
    overlap, left = np.zeros(len(sizes), dtype=np.int64), sizes.copy()
    need = -(-3 * (sizes + len(row)) // 7)  # the overlap of a pair at the limit
    strip = (block >> U64(64 - STRIP_BITS)).astype(np.int64)
    bounds = np.searchsorted((row >> U64(64 - STRIP_BITS)).astype(np.int64), np.arange((1 << STRIP_BITS) + 1))
    for k in range(1 << STRIP_BITS):
        at = np.flatnonzero((strip == k) & live[rows])
        own = row[bounds[k] : bounds[k + 1]]
        left -= np.bincount(rows[at], minlength=len(sizes))
        if len(own) and len(at):
            place = np.minimum(np.searchsorted(own, block[at]), len(own) - 1)
            overlap += np.bincount(rows[at], weights=own[place] == block[at], minlength=len(sizes)).astype(np.int64)
        live &= overlap + np.minimum(left, len(row) - bounds[k + 1]) >= need
    return live & (overlap >= need)


def _products(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``u, v`` whose sets overlap enough, block by block.

    Each pair belongs to the block of its class that has more pairs, so a pivot's row is not
    repeated for each of them. Blocks are dealt in parts of ``BLOCK_ROWS`` rows.
    """
    both = pairs.select("u", "v").withColumn("k", F.xxhash64("u", "v"))
    degree = both.select(F.explode(F.array("u", "v")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("d"))
    of = (degree.select(F.col("c").alias(x), F.col("d").alias(f"d{x}")) for x in "uv")
    faced = both.join(next(of), "u").join(next(of), "v")
    turned = F.col("du") > F.col("dv")
    placed = faced.select(F.when(turned, F.col("u")).otherwise(F.col("v")).alias("hub"), F.when(turned, F.col("v")).otherwise(F.col("u")).alias("c"), F.pmod("k", F.ceil(F.greatest("du", "dv") / BLOCK_ROWS).cast("long")).alias("part"))
    placed = placed.withColumn("kind", F.lit(1))
    hubs = placed.select("hub", F.col("hub").alias("c"), "part").distinct().withColumn("kind", F.lit(0))
    rows = placed.select("hub", "c", "part", "kind").unionByName(hubs.select("hub", "c", "part", "kind")).join(sets.select("c", "grams"), "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, part, row = None, None, np.zeros(0, dtype=U64)
        for batch in batches:
            hubs, parts, kinds, names = (batch.column(k) for k in range(4))
            grams, n = np.array(batch.column(4).flatten()).view(U64), np.array(batch.column(4).value_lengths()).astype(np.int64)
            ends = np.cumsum(n)
            hub_list, part_list, kind_list = hubs.to_pylist(), parts.to_pylist(), kinds.to_pylist()
            marks = [i for i in range(batch.num_rows) if i == 0 or kind_list[i] == 0 or (hub_list[i], part_list[i]) != (hub_list[i - 1], part_list[i - 1])]
            linked = np.zeros(batch.num_rows, dtype=bool)
            for a, b in zip(marks, [*marks[1:], batch.num_rows], strict=True):
                if kind_list[a] == 0:
                    hub, part, row = hub_list[a], part_list[a], np.sort(grams[ends[a] - n[a] : ends[a]])
                    a += 1
                if a < b:
                    if (hub, part) != (hub_list[a], part_list[a]):
                        raise RuntimeError("a block came without its row")
                    block = grams[ends[a] - n[a] : ends[b - 1]]
                    linked[a:b] = _overlaps(block, np.repeat(np.arange(b - a), n[a:b]), n[a:b], row)
            take = pa.array(np.flatnonzero(linked))
            yield pa.RecordBatch.from_arrays([hubs.take(take), names.take(take)], names=["u", "v"])

    dealt = rows.select("hub", "part", "kind", "c", "grams").repartition("hub", "part").sortWithinPartitions("hub", "part", "kind")
    found = dealt.mapInArrow(tidy(run), "u binary, v binary")
    return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _heavy_shingles(sets: DataFrame) -> DataFrame:
    """``s, weight``: shingles of very many classes, estimated from one class in 64; at most
    ``HEAVY``, the heaviest, so what is not among them is held by fewer classes than these are."""
    sampled = sets.where(F.pmod(F.xxhash64("c1", F.lit(3)), F.lit(64)) == 0).select(F.explode("grams").alias("s"))
    counted = sampled.groupBy("s").agg((64 * F.count(F.lit(1))).alias("weight")).where(F.col("weight") > 16 * HOT_COLUMN)
    return counted.orderBy(F.desc("weight"), "s").limit(HEAVY)


def _ranked(sets: DataFrame) -> DataFrame:
    """``s, c, n, df, place, central``: each class's shared shingles, rarest first. ``df`` is the
    number of rows that hold the shingle, or its weight if it is a heavy one: one number a
    shingle, so all classes agree on the order. Heavy shingles need not meet in one task."""
    heavy = cut(_heavy_shingles(sets))  # 16 bytes each, HEAVY of them at most
    rows = sets.select("c", "n", F.explode("grams").alias("s")).join(F.broadcast(heavy), "s", "left")
    whole = Window.partitionBy("s")
    light = rows.where("weight IS NULL").select("s", "c", "n", F.min("c").over(whole).alias("lo"), F.max("c").over(whole).alias("hi"), F.count(F.lit(1)).over(whole).alias("df"))
    shared = light.where("lo <> hi").select("s", "c", "n", "df").unionByName(rows.where("weight IS NOT NULL").select("s", "c", "n", F.col("weight").alias("df")))
    # a class may come from several tasks: equal rows have one rank and one of them stays
    order = Window.partitionBy("c").orderBy("df", "s")
    ranked = shared.select("s", "c", "n", "df", (F.dense_rank().over(order) - 1).alias("k"), F.lag("s").over(order).alias("before")).withColumn("kept", F.max("k").over(Window.partitionBy("c")) + 1)
    return ranked.where("before IS NULL OR before <> s").select("s", "c", "n", "df", (F.col("n") - F.col("kept") + F.col("k")).alias("place"), (F.col("kept") / F.col("n")).alias("central"))


def _over_columns(rows: DataFrame, **aggregates: Column) -> DataFrame:
    """Rows with aggregates over their shingle's column. Columns of many classes are aggregated
    map-side and joined back, which the adaptive planner can split; the others are windows."""
    few, many = rows.where(F.col("df") <= HOT_COLUMN), rows.where(F.col("df") > HOT_COLUMN)
    whole = Window.partitionBy("s")
    light = few.select("*", *(a.over(whole).alias(name) for name, a in aggregates.items()))
    summed = many.groupBy("s").agg(*(a.alias(name) for name, a in aggregates.items()))
    return light.unionByName(many.join(summed, "s").select(light.columns))


def _labelled(prefix: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Prefix rows with their class's component."""
    if labels is None:
        return prefix.withColumn("label", F.col("c"))
    known = labels.select(F.col("a").alias("c"), F.col("b").alias("root"))
    return prefix.join(known, "c", "left").withColumn("label", F.coalesce("root", "c")).drop("root")


#: Of a column: its smallest and largest component. It is open while these differ.
_SPAN = {"lo": F.min, "hi": F.max}


def _pivot_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """Each class of an open column with its pivot: the most central one, later others by hash."""
    rank = -F.col("central") if turn == 0 else F.xxhash64("c", F.lit(turn)).cast("double")
    pivot = F.min(F.struct(rank.alias("r"), F.col("c").alias("v"), F.col("n").alias("nv"), F.col("place").alias("pv"), F.col("label").alias("lv")))
    paired = _over_columns(rows, p=pivot, **{k: f("label") for k, f in _SPAN.items()}).where("lo <> hi").select("c", "n", "place", "label", "p.v", "p.nv", "p.pv", "p.lv").where("label <> lv")
    fit = paired.where(_fits(F.col("n"), F.col("nv")) & _reaches(F.col("n"), F.col("place"), F.col("nv"), F.col("pv")))
    return fit.select(F.least("c", "v").alias("u"), F.greatest("c", "v").alias("v")).distinct()


def _second_shingles(rows: DataFrame, ranked: DataFrame) -> DataFrame:
    """The rows of columns that are still apart, split by each other shingle of the class's
    prefix that is longer by one: a pair that reaches the limit shares two shingles there, the
    column's own and another, if it shares the column's own at all. Sets of one shingle leave:
    only equal sets are similar to them, and these are one class."""
    longer = ranked.where(F.col("place") <= F.floor(F.col("n") / 4) + 1).select("c", F.col("s").alias("s2"))
    return rows.where("n > 1").join(longer, "c").where("s <> s2").select(F.xxhash64(F.least("s", "s2"), F.greatest("s", "s2")).alias("key"), "c", "n", "place", "label")


def _remaining_pairs(rows: DataFrame, ranked: DataFrame) -> DataFrame:
    """All pairs across components that meet in a column, or, in columns of more than ``SPLIT``
    classes, in a pair of shingles; what is connected is not paired."""
    sized = cut(_over_columns(rows, m=F.count(F.lit(1)), **{k: f("label") for k, f in _SPAN.items()}).where("lo <> hi").select("s", "c", "n", "place", "label", "m"))
    found = _pairs_by_key(sized.where(F.col("m") <= SPLIT).withColumnRenamed("s", "key"))
    many = sized.where(F.col("m") > SPLIT)
    if not many.isEmpty():
        split = cut(_second_shingles(many, ranked))
        apart = split.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
        found = found.unionByName(_pairs_by_key(split.join(apart, "key")))
    return found.distinct()


def _pairs_by_key(rows: DataFrame) -> DataFrame:
    a, b = (rows.select("key", *(F.col(x).alias(x + t) for x in ("c", "n", "place", "label"))) for t in "12")
    joined = a.join(b, "key").where("c1 < c2 AND label1 <> label2")
    fit = joined.where(_fits(F.col("n1"), F.col("n2")) & _reaches(F.col("n1"), F.col("place1"), F.col("n2"), F.col("place2")))
    return fit.select(F.col("c1").alias("u"), F.col("c2").alias("v"))


def _linked(base: DataFrame, width: int, pivots: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The members, the classes, and the components of classes that have links."""
    spark = base.sparkSession
    members = cut(_members(base, width))
    classes = members.where("n > 0").groupBy("c").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("c1").alias("c1"))
    unique = _sampled(base, width).groupBy("s").agg(F.min("c1").alias("k"), F.max("c1").alias("hi")).where("k = hi").groupBy("k").agg(F.count(F.lit(1)).alias("alone"))
    candidates = cut(classes.join(unique, F.col("c1") == F.col("k"), "left").where(F.coalesce("alone", F.lit(0)) <= F.floor(F.col("n") / 4)).select("c", "c1", "n"))
    release(spark)
    labels = None
    if count := candidates.count():
        sets = cut(_candidate_sets(base, members, candidates, count, width))
        ranked = cut(_ranked(sets).where(F.col("place") <= F.floor(F.col("n") / 4) + 1))
        prefix = ranked.where(F.col("place") <= F.floor(F.col("n") / 4))
        release(spark)
        links = None
        for turn in range(pivots + 1):
            rows = _labelled(prefix, labels)
            pairs = cut(_pivot_pairs(rows, turn) if turn < pivots else _remaining_pairs(rows, ranked))
            if pairs.isEmpty():
                if turn == pivots:
                    break
                continue
            used = pairs.select(F.explode(F.array("u", "v")).alias("c")).distinct()
            own = sets.join(used, "c", "left_semi").dropDuplicates(["c"])
            found = cut(_products(pairs, own))
            del rows, pairs, used, own
            release(spark)
            if not (links_found := found.count()):
                continue
            found = found.coalesce(1 + links_found // EDGES_A_TASK)
            links = found if links is None else links.unionByName(found)
            labels = components(links)
    return members, classes, labels


def join_components(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text", pivots: int = 3) -> DataFrame:
    """``id_col, n_shingles, component_id`` of every document: set size, and the smallest id
    reachable over links of Jaccard similarity 0.75 or more.

    Words are runs outside ASCII white space with A-Z lowered; shingles have ``width`` words,
    shorter texts are one shingle. Null and empty texts have no shingles and link with nothing.
    Texts of any length are taken whole. Ids must be integers; a row without id has a null
    component. Repeated rows share their component; an empty table gives no rows; other columns are not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        members, classes, labels = _linked(base, width, pivots)
    if labels is None:
        final = classes.select("c", F.col("rep").alias("component_id"))
    else:
        rooted = classes.join(labels.select(F.col("a").alias("c"), F.col("b").alias("root")), "c", "left").withColumn("root", F.coalesce("root", "c"))
        least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
        final = rooted.join(least, "root").select("c", "component_id")
    own = F.when(F.col("n") == 0, F.col("id")).when(F.col("id").isNotNull(), F.col("component_id"))
    return members.join(final, "c", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))


def oracle(width: int = 5) -> str:
    """The components of all documents as DuckDB SQL."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, hash(w[i:i + {width - 1}]) AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - {width - 1}, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS u, y.doc_id AS v, count(*) AS common FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * common >= 75 * (a.n + b.n - common)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.v FROM r JOIN e ON e.u = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = d.doc_id"""
