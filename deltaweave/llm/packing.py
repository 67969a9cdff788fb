"""Best-fit-decreasing packing of tokenised documents into fixed windows.

Each task tokenises its partition, cuts overlong documents into full windows and fits the
rest, longest first, into the open window with the least room that still suffices; a segment
tree indexed by remaining capacity finds it. Tasks pack bounded blocks of tokens, so memory
does not grow with the partition and nothing is shuffled; sequence ids carry the task's
partition in their high bits. A block leaves at most a few windows with room, which with the
default block is far below one percent of its tokens.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaweave.llm.kernel import ChunkStore, blocks, tidy

#: Bits of a sequence id below the partition's number.
LOCAL_BITS = 36
BLOCK_TOKENS = 6_000_000
#: The pre-tokenisation pattern that belongs to the 50k byte-level vocabulary; fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class CapacityTree:
    """Open windows by remaining capacity; ``best(need)`` pops the tightest that suffices."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def push(self, room: int, window: int) -> None:
        self.open[room].append(window)
        node = room + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def best(self, need: int) -> tuple[int, int] | None:
        node = need + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        while node:
            self.count[node] -= 1
            node >>= 1
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Window and offset of each piece (1 to ``capacity`` tokens), and the number of windows."""
    tree, windows = CapacityTree(capacity), 0
    window, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = tree.best(need) if need < capacity else None
        if found is None:
            found, windows = (capacity, windows), windows + 1
        room, window[i] = found
        offset[i] = capacity - room
        if room > need:
            tree.push(room - need, int(window[i]))
    return window, offset, windows


_ENCODERS: dict[str, ChunkStore] = {}
#: Chunks of more bytes go to the tokenizer's own library, whose time and stack do not grow
#: faster than the chunk.
LONG_CHUNK = 512


def encoder(path: str) -> ChunkStore:
    """A worker's store of encoded chunks for a byte-level BPE ``tokenizer.json``.

    Chunks of one word are put together and split again by the sizes of their tokens; all others
    (long ones, ones that hold a special token's string, white space or line ends) are encoded
    one by one by the library of the file, as it stands.
    """
    if path not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        if any(any(c.isspace() for c in t) for t in special):
            raise ValueError("special tokens with white space inside are not supported")
        marks = [t.encode() for t in special]
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        codec = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

        lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        lengths[list(ranks.values())] = [len(b) for b in ranks]

        def encode(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            # chunks that begin with a space and end in print do not touch when put together
            regular = np.fromiter((c[0] == 32 and 32 < c[-1] < 127 and len(c) <= LONG_CHUNK and not any(m in c for m in marks) for c in chunks), dtype=bool, count=len(chunks))
            joined = b"".join(c for c, r in zip(chunks, regular.tolist(), strict=True) if r)
            flat = codec.encode_to_numpy(joined.decode("utf-8")).astype(np.int32) if joined else np.zeros(0, dtype=np.int32)
            sizes = np.zeros(len(chunks), dtype=np.int64)
            ends = np.cumsum(np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))[regular])
            sizes[regular] = np.diff(np.r_[0, np.searchsorted(np.cumsum(lengths[flat]), ends) + 1]) if len(ends) else 0
            odd = np.flatnonzero(~regular)
            if not len(odd):
                return flat, sizes
            rest = [e.ids for e in library.encode_batch_fast([chunks[i].decode("utf-8") for i in odd], add_special_tokens=False)]
            sizes[odd] = [len(x) for x in rest]
            out = np.zeros(int(sizes.sum()), dtype=np.int32)
            own = np.repeat(regular, sizes)
            out[own] = flat
            out[~own] = np.fromiter((i for x in rest for i in x), dtype=np.int32)
            return out, sizes

        _ENCODERS[path] = ChunkStore(encode)
    return _ENCODERS[path]


#: Bytes of printable ASCII, between which and a following space a text may be cut without
#: changing its pre-tokens (the cut is where a run of white space begins).
_PRINTABLE = np.zeros(256, dtype=bool)
_PRINTABLE[33:127] = True


def encode_batch(texts: pa.Array, path: str, end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each block: its first row, its ids flat (each text closed by ``end_id``), id bounds."""
    store = encoder(path)
    for block in blocks(texts, 2 << 20):
        data = block.data
        cut = np.zeros(len(data), dtype=bool)
        if len(data):
            cut[1:] = (data[1:] == 32) & _PRINTABLE[data[:-1]]
            cut[block.offsets[:-1][np.diff(block.offsets) > 0]] = True
        starts = np.flatnonzero(cut)
        ends = np.r_[starts[1:], len(data)] if len(starts) else starts
        ids, sizes = store.gather(data, starts, ends)
        bounds = np.r_[0, np.cumsum(sizes)][np.searchsorted(starts, block.offsets)]
        yield block.first, np.insert(ids, bounds[1:], end_id), bounds + np.arange(len(bounds))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Pieces of all documents: id, ``start``, ``length``, ``ids`` (little-endian unsigned
    32-bit, binary), ``doc_tokens``, ``sequence_id``, ``offset``.

    Ids are those of the ``tokenizers`` library with the file as it stands and without added
    special tokens, so the string of a special token in a text becomes that token. A null or
    empty text is the end id alone; texts of any length are cut, never shortened. Rows with equal ids are packed separately; an empty table gives no pieces; other
    columns are dropped. ``tokenizer_path`` must be readable on every executor.
    """
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << LOCAL_BITS
        used, held, tokens = 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal used
            names = pa.chunked_array([x[0] for x in held]).combine_chunks()
            sizes = np.concatenate([np.diff(x[2]) for x in held])
            ids = np.concatenate([x[1] for x in held])
            at = np.cumsum(sizes) - sizes
            pieces = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), pieces)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
            length = np.minimum(sizes[row] - start, capacity)
            window, offset, windows = best_fit_decreasing(length, capacity)
            raw = ids.astype("<u4", copy=False)
            # pieces follow each other in the flat ids, so they are slices of one buffer
            assert int(length.sum()) == len(raw)
            marks = np.r_[0, np.cumsum(length)] * 4
            binary = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(marks.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())]).cast(pa.binary())
            out = pa.RecordBatch.from_arrays(
                [names.take(pa.array(row)), *(pa.array(x.astype(np.int64)) for x in (start, length)), binary, *(pa.array(x.astype(np.int64)) for x in (sizes[row], base + used + window, offset))],
                names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )
            used += windows
            return out

        for batch in batches:
            for first, ids, bounds in encode_batch(batch.column(1), tokenizer_path, end_id):
                held.append((batch.column(0).slice(first, len(bounds) - 1), ids, bounds))
                tokens += len(ids)
                if tokens >= block_tokens:
                    yield flush()
                    held, tokens = [], 0
        if held:
            yield flush()

    schema = f"id {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), schema).withColumnRenamed("id", id_col)


def digests(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select(id_col, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
