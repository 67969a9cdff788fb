"""Removal of passages that repeat across documents, by a count-min prefilter.

A window is ``width`` consecutive words. Its anchor is the smallest hash among the ``gram``-word
runs inside it, so equal windows have equal anchors, and a document has few distinct ones. Pass
one sketches, per partition, how many documents hold each anchor; the merged sketch
overestimates the count of every window. Pass two hashes (128 bits) only the windows whose
anchor is estimated to occur in two documents or more and groups them exactly; a true repeat is
never left out. The sketch is kept in blocks of cells, and grows with the text: up to a bound it
is broadcast; beyond, its blocks stay distributed and each document's anchors are joined with
their blocks. Before the exact grouping each task settles what it can: of equal windows it has
seen, only those of the smallest document travel, so a passage held by a third of all documents
is one row a task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deltaweave.llm.kernel import Block, Hasher, blocks, fresh, mix, per_row, tidy, window_owner_mask, windows, words

#: Anchor runs are this many words (or the whole window, if that is shorter).
GRAM = 10
#: Cells of an anchor, all in its block; cells of one depth of a block, and the fewest of one
#: depth of a sketch, as powers of two.
DEPTH, CELL_BITS, LEAST_BITS = 2, 16, 18
#: Sketches of up to so many cells a depth are broadcast (64 MB); larger ones are joined by block.
BROADCAST_BITS = 28
#: Windows a task holds before it settles and emits them.
HELD = 1_500_000


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    span, out = 1, values
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def sketch_bits(text_bytes: int) -> int:
    """log2 of a sketch row's cells: about eight for each anchor expected."""
    return max(LEAST_BITS, int(text_bytes / 15 + 1).bit_length())


def _anchored(block: Block, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, and of each whole window its start, owner row and anchor."""
    found = words(block)
    hashes = Hasher(block.data).ranges(found.starts, found.ends)
    inside = np.flatnonzero(window_owner_mask(found.bounds, width, len(hashes)))
    if not len(inside):
        return hashes, inside, inside, np.zeros(0, dtype=np.uint64)
    gram = min(GRAM, width)
    anchors = sliding_min(windows(hashes, gram, 11), width - gram + 1)[inside]
    owners = np.searchsorted(found.bounds, inside, side="right") - 1
    return hashes, inside - found.bounds[owners], owners, anchors


def _cells(anchors: np.ndarray, bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each anchor's block, and its cell at each depth of the block."""
    block = (mix(anchors, 20) >> np.uint64(64 - (bits - CELL_BITS))).astype(np.int64)
    return block, [(mix(anchors, 21 + d) >> np.uint64(64 - CELL_BITS)).astype(np.int64) + (d << CELL_BITS) for d in range(DEPTH)]


def _once_a_document(owners: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((anchors, owners))
    o, a = owners[order], anchors[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (o[1:] != o[:-1])][: len(a)]
    return o[new], a[new]


def merged_sketch(docs: DataFrame, bits: int, width: int, text_col: str = "text") -> DataFrame:
    """``block, cells``: bitmaps of the cells that have been hit by two documents or more.

    Partition sketches travel sparse, as lists of a block's cells hit once and more than once.
    """
    size = DEPTH << CELL_BITS

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = 0

        def flush() -> pa.RecordBatch:
            cells, n = np.unique(np.concatenate(held), return_counts=True)
            numbers, first = np.unique(cells // size, return_index=True)
            once, more = [], []
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(cells)], strict=True):
                own, twice = (cells[a:b] % size).astype("<u4"), n[a:b] > 1
                once.append(own[~twice].tobytes())
                more.append(own[twice].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(once, type=pa.binary()), pa.array(more, type=pa.binary())], names=["block", "once", "more"])

        for batch in batches:
            for text in blocks(batch.column(0)):
                _, _, owners, anchors = _anchored(text, width)
                if len(anchors):
                    block, cells = _cells(_once_a_document(owners, anchors)[1], bits)
                    held += [block * size + c for c in cells]
                    count += len(block)
            if count > 4 * HELD:
                yield flush()
                held, count = [], 0
        if count:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen = None, np.zeros(size, dtype=np.uint8)

        def bitmap() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], type=pa.int64()), pa.array([np.packbits(seen > 1).tobytes()], type=pa.binary())], names=["block", "cells"])

        for batch in batches:
            for number, once, more in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if number != at:
                    if at is not None:
                        yield bitmap()
                    at, seen = number, np.zeros(size, dtype=np.uint8)
                cells = np.frombuffer(once, dtype="<u4")
                seen[cells] = np.minimum(seen[cells], 1) + 1
                seen[np.frombuffer(more, dtype="<u4")] = 2
        if at is not None:
            yield bitmap()

    sketches = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(partial), "block long, once binary, more binary")
    return sketches.repartition("block").sortWithinPartitions("block").mapInArrow(tidy(merge), "block long, cells binary")


def collected(sketch: DataFrame, bits: int) -> np.ndarray:
    """The bitmaps of all blocks on the driver: ``DEPTH * 2**bits / 8`` bytes."""
    out = np.zeros((1 << (bits - CELL_BITS), (DEPTH << CELL_BITS) // 8), dtype=np.uint8)

    def pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([zlib.compress(c, 1) for c in batch.column(1).to_pylist()], type=pa.binary())], names=["block", "cells"])

    for row in sketch.mapInArrow(tidy(pressed), "block long, cells binary").toLocalIterator():
        out[row.block] = np.frombuffer(zlib.decompress(row.cells), dtype=np.uint8)
    return out


def _suspected(anchors: np.ndarray, sketch: np.ndarray, bits: int) -> np.ndarray:
    """Which anchors the sketch estimates at two documents or more."""
    out = np.ones(len(anchors), dtype=bool)
    block, depths = _cells(anchors, bits)
    for cells in depths:
        out &= (sketch[block, cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1
    return out


def with_suspected_anchors(docs: DataFrame, sketch: DataFrame, bits: int, width: int) -> DataFrame:
    """``id, sig, text, anchors``: documents and those of their anchors that the distributed
    sketch estimates at two documents or more. A document's anchors (about one for twenty words)
    are joined with their blocks; the adaptive planner splits a block that many anchors share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in blocks(batch.column(2)):
                _, _, owners, anchors = _anchored(text, width)
                o, a = _once_a_document(owners, anchors)
                block, cells = _cells(a, bits)
                rows = pa.array(text.first + o)
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(a.view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array(c) for c in cells)], names=["block", "a", "id", "sig", *(f"c{d}" for d in range(DEPTH))])

    held = docs.mapInArrow(tidy(run), "block long, a long, id long, sig long, " + ", ".join(f"c{d} long" for d in range(DEPTH)))
    hit = F.lit(True)
    for d in range(DEPTH):
        octet = F.conv(F.hex(F.substring("cells", F.shiftright(f"c{d}", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        place = (F.lit(7) - F.col(f"c{d}").bitwiseAND(F.lit(7))).cast("int")
        hit = hit & (F.call_function("shiftright", octet, place).bitwiseAND(F.lit(1)) == 1)
    own = held.join(sketch, "block").where(hit).groupBy("id", "sig").agg(F.collect_list("a").alias("anchors"))
    return docs.join(own, ["id", "sig"]).select("id", "sig", "text", "anchors")


_WINDOW_FIELDS = "h1 long, h2 long, id long, sig long, span long, settled boolean"


def with_repeated_anchors(docs: DataFrame, width: int) -> DataFrame:
    """``id, sig, text, anchors``: documents that hold anchors which other documents hold too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2)):
                _, _, owners, anchors = _anchored(block, width)
                order = np.lexsort((anchors, owners))
                a, o = anchors[order], owners[order]
                new = np.r_[True, (a[1:] != a[:-1]) | (o[1:] != o[:-1])] if len(a) else np.zeros(0, dtype=bool)
                rows = pa.array(block.first + o[new])
                yield pa.RecordBatch.from_arrays([pa.array(a[new].view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows)], names=["a", "id", "sig"])

    held = docs.mapInArrow(tidy(run), "a long, id long, sig long")
    shared = held.groupBy("a").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("a")
    own = held.join(shared, "a").groupBy("id", "sig").agg(F.collect_set("a").alias("anchors"))
    return docs.join(own, ["id", "sig"]).select("id", "sig", "text", "anchors")


def _suspect_windows(docs: DataFrame, sketch: np.ndarray | None, bits: int, width: int) -> DataFrame:
    """Windows to group exactly; ``settled`` ones are known to have a smaller document.

    ``span`` is the first window's start times 2**32 plus the number of consecutive windows
    (one, unless settled). Without a sketch, ``docs`` has a column of each one's suspected anchors.
    """
    shared = None if sketch is None else docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def settle() -> pa.RecordBatch:
            h1, h2, ids, sigs, starts = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((ids, h2, h1))
            h1, h2, ids, sigs, starts = (x[order] for x in (h1, h2, ids, sigs, starts))
            new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            first = np.flatnonzero(new)
            settled = ids > np.repeat(ids[first], np.diff(np.r_[first, len(ids)]))
            open_ = ~settled
            span = (starts[open_] << 32) + 1
            by = np.lexsort((starts[settled], sigs[settled], ids[settled]))
            i, g, t = ids[settled][by], sigs[settled][by], starts[settled][by]
            head = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (g[1:] != g[:-1]) | (t[1:] > t[:-1] + 1)]) if len(t) else np.zeros(0, dtype=np.int64)
            length = t[np.r_[head[1:], len(t)][: len(head)] - 1] - t[head] + 1
            # settled runs need no partner: they are dealt evenly
            key = mix(i[head].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + t[head].astype(np.uint64), 41).view(np.int64)
            parts = (
                (h1[open_].view(np.int64), key), (h2[open_].view(np.int64), np.zeros(len(head), dtype=np.int64)), (ids[open_], i[head]), (sigs[open_], g[head]),
                (span, (t[head] << 32) + length), (np.zeros(len(span), dtype=bool), np.ones(len(head), dtype=bool)),
            )
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in parts], names=["h1", "h2", "id", "sig", "span", "settled"])

        for batch in batches:
            ids, sigs = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for block in blocks(batch.column(2)):
                hashes, starts, owners, anchors = _anchored(block, width)
                if not len(anchors):
                    hit = []
                elif shared is not None:
                    hit = np.flatnonzero(_suspected(anchors, shared.value, bits))
                else:
                    own = batch.column(3).slice(block.first, block.rows)
                    known = mix(np.array(own.flatten()).view(np.uint64) ^ mix(np.repeat(np.arange(block.rows), own.value_lengths()).astype(np.uint64), 9), 9)
                    hit = np.flatnonzero(np.isin(mix(anchors ^ mix(owners.astype(np.uint64), 9), 9), known))
                if len(hit):
                    # window positions in the flat word array, to hash them
                    found = words(block)
                    at = found.bounds[owners[hit]] + starts[hit]
                    h1, h2 = windows(hashes, width, 31)[at], windows(hashes, width, 37)[at]
                    rows = block.first + owners[hit]
                    held.append((h1, h2, ids[rows], sigs[rows], starts[hit].astype(np.int64)))
                    count += len(hit)
                if count > HELD:
                    yield settle()
                    held, count = [], 0
        if count:
            yield settle()

    return docs.mapInArrow(tidy(run), _WINDOW_FIELDS)


def repeated_starts(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``id, sig, spans``: runs of windows of each document that also start in a smaller one."""
    keyed = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("sig"), F.col(text_col).cast("string").alias("text"))
    total = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = sketch_bits(total)
    sketch = merged_sketch(keyed, bits, width)
    if bits <= BROADCAST_BITS:
        suspects = _suspect_windows(keyed, collected(sketch, bits), bits, width)
    else:
        suspects = _suspect_windows(with_suspected_anchors(keyed, sketch, bits, width), None, bits, width)
    least = F.min("id").over(Window.partitionBy("h1", "h2"))
    gone = suspects.withColumn("least", least).where(F.col("settled") | (F.col("id") > F.col("least")))
    return gone.groupBy("id", "sig").agg(F.collect_list("span").alias("spans"))


def removal(bounds: np.ndarray, spans: list[np.ndarray | None], width: int) -> np.ndarray:
    """Which words (flat) lie in a window that goes."""
    edge = np.zeros(int(bounds[-1]) + 1, dtype=np.int64)
    for row, own in enumerate(spans):
        if own is not None and len(own):
            start = bounds[row] + (own >> 32)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + (own & 0xFFFFFFFF) - 1 + width, -1)
    return np.cumsum(edge[:-1]) > 0


def dedup(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text", rejoin: bool = True, keep_columns: bool = False, counts: str | None = "_dedup") -> DataFrame:
    """``id_col, n_words, n_removed, kept`` of every document; ``kept`` is its text without the
    words of windows that also start in a document with a smaller id.

    With ``rejoin`` the kept words are joined by one space; else the kept words stay with the
    white space that follows them. With ``keep_columns`` all input columns come first, the text
    replaced, and the counts follow in one struct ``counts`` (with underscores added where the
    input has a column of that name; none for ``counts=None``); null texts stay null. Texts are
    read whole, whatever their length. Ids must be integers. Null and empty texts have no words. Texts under 50 words have
    no window and stay. Rows without an id take no part and stay. Rows that share an id count
    as one document. An empty table gives no rows.
    """
    removals = repeated_starts(docs, width, id_col, text_col).withColumnRenamed("id", "_rid").withColumnRenamed("sig", "_rsig")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    base = docs.select(row, F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.col(text_col)).alias("_sig"))
    joined = base.join(removals, (F.col("_id") == F.col("_rid")) & (F.col("_sig") == F.col("_rsig")), "left")
    text = F.col("_row").getField(text_col).cast("string")
    flat = joined.select(*((F.col("_row").getField(c).alias(f"c{k}") for k, c in enumerate(docs.columns)) if keep_columns else [F.col("_row").getField(id_col).alias("c0")]), text.alias("_text"), "spans")
    carried = [f.name for f in flat.schema.fields[:-2]]
    at = docs.columns.index(text_col) if keep_columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(carried))
            marked = batch.column(len(carried) + 1)
            for block in blocks(texts):
                found = words(block)
                own = marked.slice(block.first, block.rows)
                spans = [None if v is None else np.array(v, dtype=np.int64) for v in own.to_pylist()]
                gone = removal(found.bounds, spans, width)
                lost = per_row(gone, found.bounds)
                kept = []
                for r in range(block.rows):
                    raw = block.data[block.offsets[r] : block.offsets[r + 1]].tobytes()
                    if lost[r] == 0:
                        kept.append(b" ".join(raw.split()) if rejoin else raw)
                        continue
                    stay = (~gone[found.bounds[r] : found.bounds[r + 1]]).tolist()
                    if rejoin:
                        kept.append(b" ".join(compress(raw.split(), stay)))
                    else:
                        begin = (found.starts[found.bounds[r] : found.bounds[r + 1]] - block.offsets[r]).tolist()
                        upto = [*begin[1:], len(raw)]
                        kept.append(raw[: begin[0]] + b"".join(raw[a:b] for a, b, s in zip(begin, upto, stay, strict=True) if s))
                text_array = pa.array(kept, type=pa.binary()).cast(pa.string())
                tallies = [pa.array(found.counts.astype(np.int64)), pa.array(lost.astype(np.int64))]
                columns = [batch.column(k).slice(block.first, block.rows) for k in range(len(carried))]
                if keep_columns:
                    columns[at] = pa.compute.if_else(columns[at].is_valid(), text_array, pa.scalar(None, pa.string()))
                    yield pa.RecordBatch.from_arrays([*columns, pa.StructArray.from_arrays(tallies, names=["n_words", "n_removed"])], names=[*carried, "counts"])
                else:
                    yield pa.RecordBatch.from_arrays([*columns, *tallies, text_array], names=["c0", "n_words", "n_removed", "kept"])

    kinds = [f.dataType.simpleString() for f in flat.schema.fields[: len(carried)]]
    if keep_columns:
        kinds[at] = "string"
        schema = ", ".join(f"{n} {t}" for n, t in zip(carried, kinds, strict=True)) + ", counts struct<n_words: bigint, n_removed: bigint>"
        names = [F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)]
        return flat.mapInArrow(tidy(run), schema).select(*names, *([] if counts is None else [F.col("counts").alias(fresh(counts, docs.columns))]))
    return flat.mapInArrow(tidy(run), f"c0 {kinds[0]}, n_words long, n_removed long, kept string").withColumnRenamed("c0", id_col)


def digests(deduped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return deduped.select(id_col, "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def oracle(width: int = 50) -> str:
    """The digests of all documents as DuckDB SQL."""
    return f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, unnest(generate_series(1, len(w) - {width - 1})) AS i, w FROM d WHERE len(w) >= {width}),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {width - 1}], ' ')) AS h FROM p),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS least FROM h),
g AS (SELECT doc_id, list(i) AS starts FROM m WHERE least < doc_id GROUP BY doc_id),
c AS (SELECT doc_id, list_distinct(flatten(list_transform(starts, lambda s: generate_series(s, s + {width - 1})))) AS gone FROM g),
k AS (SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN c ON d.doc_id = c.doc_id),
u AS (SELECT doc_id, len(w) AS n_words, len(gone) AS n_removed, w, gone FROM k),
e AS (SELECT u.doc_id, string_agg(t.x, ' ' ORDER BY t.i) AS kept FROM u, (SELECT doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS i FROM d) t
      LEFT JOIN (SELECT doc_id, unnest(gone) AS i FROM c) r ON r.doc_id = t.doc_id AND r.i = t.i WHERE u.doc_id = t.doc_id AND r.i IS NULL GROUP BY u.doc_id)
SELECT u.doc_id, n_words, n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM u LEFT JOIN e ON u.doc_id = e.doc_id"""
