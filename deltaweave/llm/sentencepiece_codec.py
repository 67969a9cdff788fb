"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut before each run of spaces; no piece of a fitting model crosses such a cut, so
the chunks ("words") merge independently. All new distinct words of a block lie in one flat
symbol array. A round finds each word's smallest pair rank (segmented minimum), merges there
(all non-overlapping occurrences from the left, or the leftmost only where a merge could open
a pair of no higher rank), and compacts the arrays; words without a pair leave. In words longer
than a piece, pairs of the smallest rank within a piece's reach merge in the same round: what
merges before them lies in pieces that cannot touch them, so a long word takes no more rounds
than its neighbourhoods do. Remaining symbols outside the vocabulary become byte pieces. Text
and ids equal the library's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaweave.llm.kernel import ChunkStore, blocks

SPACE = "▁"
NO_RANK = np.int32(2**31 - 1)


def _least_around(values: np.ndarray, reach: int) -> np.ndarray:
    """The smallest value at most ``reach`` places from each place."""
    width, out = 2 * reach + 1, np.full(len(values) + 2 * reach, NO_RANK, dtype=values.dtype)
    out[reach : reach + len(values)] = values
    span = 1
    while span < width:
        step = min(span, width - span)
        out = np.minimum(out[: len(out) - step], out[step:])
        span += step
    return out


class PieceModel:
    """Vocabulary, pair table and byte pieces of a SentencePiece BPE model."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_file=path)
        self.size, self.unk, self.end = library.vocab_size(), library.unk_id(), library.eos_id()
        pieces = [library.id_to_piece(i) for i in range(self.size)]
        self.special = np.array([library.is_control(i) or library.is_unknown(i) for i in range(self.size)])
        self.is_byte = np.array([library.is_byte(i) for i in range(self.size)])
        self.byte_ids = np.full(256, self.unk, dtype=np.int32)
        for i in np.flatnonzero(self.is_byte):
            self.byte_ids[int(pieces[i][3:5], 16)] = i
        self.byte_fallback = bool(self.is_byte.any())
        normal = {p: i for i, p in enumerate(pieces) if not self.special[i] and not self.is_byte[i]}
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("pieces with a space inside are not supported")
        scores = np.array([library.get_score(i) for i in range(self.size)])
        ranks = np.searchsorted(np.unique(-scores), -scores).astype(np.int32)
        #: Characters that pieces use without being pieces get symbols past the vocabulary.
        symbols = dict(normal)
        for p in normal:
            for c in p:
                symbols.setdefault(c, self.size + len(symbols))
        self.chars = np.full(0x110000, -1, dtype=np.int32)
        for s, i in symbols.items():
            if len(s) == 1:
                self.chars[ord(s)] = i
        pairs: dict[tuple[int, int], int] = {}
        unsafe = np.zeros(self.size, dtype=bool)
        for p, i in normal.items():
            for k in range(1, len(p)):
                left, right = symbols.get(p[:k]), symbols.get(p[k:])
                if left is not None and right is not None:
                    pairs[left, right] = i
                    for part in (left, right):
                        if part < self.size and ranks[i] <= ranks[part]:
                            unsafe[part] = True
        self.pairs, self.ranks, self.unsafe = pairs, ranks, unsafe
        self.longest = max(map(len, normal), default=1)
        self._hash_table()
        parts = [b"" if self.special[i] else bytes([int(p[3:5], 16)]) if self.is_byte[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        parts[self.unk] = " ⁇ ".encode()
        self.surface = pa.array(parts, type=pa.large_binary())
        self.plain = ~self.is_byte & ~self.special
        self.begins_space = np.array([p.startswith(SPACE) for p in pieces])

    def _hash_table(self) -> None:
        self.bits = 20
        self.keys, self.values = np.full(1 << self.bits, -1, dtype=np.int64), np.zeros(1 << self.bits, dtype=np.int32)
        keys = np.array([(a << 20) | b for a, b in self.pairs], dtype=np.int64)
        for key, slot, value in zip(keys.tolist(), self._slots(keys).tolist(), self.pairs.values(), strict=True):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.keys[slot], self.values[slot] = key, value

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece each pair makes, or -1."""
        keys = (left.astype(np.int64) << 20) | right
        keys[(left < 0) | (right < 0)] = -2
        slots = self._slots(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], np.int32(-1))
        open_ = np.flatnonzero((found != keys) & (found >= 0) & (keys >= 0))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slots[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def encode_words(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, flat, and the number of ids of each."""
        texts = [w.decode("utf-8") for w in raw]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        points = np.where(points == 32, np.uint32(ord(SPACE)), points)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        symbols = self.chars[points]
        symbols = np.where(symbols < 0, -1 - points.astype(np.int32), symbols)  # unknown characters keep their code
        done_word, done_symbol, done_order = [], [], []
        word = np.repeat(np.arange(len(texts)), sizes)
        order = np.arange(len(symbols))
        while len(symbols) > 1:
            made = np.full(len(symbols), -1, dtype=np.int32)
            made[:-1] = self.merged(symbols[:-1], symbols[1:])
            made[:-1][word[1:] != word[:-1]] = -1
            rank = np.where(made >= 0, self.ranks[made], NO_RANK)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lengths = np.diff(np.r_[starts, len(word)])
            least = np.minimum.reduceat(rank, starts)
            if (least == NO_RANK).any():
                stay = np.repeat(least != NO_RANK, lengths)
                done_word.append(word[~stay])
                done_symbol.append(symbols[~stay])
                done_order.append(order[~stay])
                symbols, word, order, made, rank = symbols[stay], word[stay], order[stay], made[stay], rank[stay]
                lengths, least = lengths[least != NO_RANK], least[least != NO_RANK]
                if not len(symbols):
                    break
                starts = np.cumsum(lengths) - lengths
            lowest = rank == np.repeat(least, lengths)
            at = np.flatnonzero(lowest)
            loose = self.unsafe[made[at]]
            owner = word[at]
            first = np.r_[True, owner[1:] != owner[:-1]]
            at = at[np.where(loose, first, self._from_the_left(at, made))]
            if lengths.max() > self.longest:
                near = (rank == _least_around(rank, self.longest)) & (rank != NO_RANK) & ~lowest
                near[made >= 0] &= ~self.unsafe[made[made >= 0]]
                also = np.flatnonzero(near & self._whole_runs(near, made))
                at = np.sort(np.r_[at, also[self._from_the_left(also, made)]])
            symbols[at] = made[at]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            symbols, word, order = symbols[keep], word[keep], order[keep]
        done_word.append(word)
        done_symbol.append(symbols)
        done_order.append(order)
        word, symbols, order = np.concatenate(done_word), np.concatenate(done_symbol), np.concatenate(done_order)
        by = np.argsort(order, kind="stable")
        return self._with_bytes(word[by], symbols[by], points, order[by], len(texts))

    def _with_bytes(self, word, symbols, points, order, n_words) -> tuple[np.ndarray, np.ndarray]:
        unknown = np.flatnonzero((symbols < 0) | (symbols >= self.size))
        if not len(unknown):
            return symbols.astype(np.int32), np.bincount(word, minlength=n_words)
        if not self.byte_fallback:
            symbols = symbols.copy()
            symbols[unknown] = self.unk
            return symbols.astype(np.int32), np.bincount(word, minlength=n_words)
        spelled = [np.frombuffer(chr(int(points[order[i]])).encode("utf-8"), dtype=np.uint8) for i in unknown]
        repeat = np.ones(len(symbols), dtype=np.int64)
        repeat[unknown] = [len(b) for b in spelled]
        ids, starts = np.repeat(symbols, repeat), np.cumsum(repeat) - repeat
        fill = np.repeat(starts[unknown], repeat[unknown]) + np.concatenate([np.arange(len(b)) for b in spelled])
        ids[fill] = self.byte_ids[np.concatenate(spelled)]
        return ids.astype(np.int32), np.bincount(np.repeat(word, repeat), minlength=n_words)

    @staticmethod
    def _from_the_left(at: np.ndarray, made: np.ndarray) -> np.ndarray:
        """Every other place of each run of neighbouring places that make the same piece."""
        adjacent = np.r_[False, (at[1:] == at[:-1] + 1) & (made[at[1:]] == made[at[:-1]])][: len(at)]
        run = np.flatnonzero(~adjacent)
        offset = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
        return offset % 2 == 0

    @staticmethod
    def _whole_runs(chosen: np.ndarray, made: np.ndarray) -> np.ndarray:
        """Where a run of neighbouring equal pairs is chosen as a whole: a part of one waits, as
        the place where the run begins decides which of its pairs merge."""
        same = np.r_[False, (made[1:] == made[:-1]) & (made[1:] >= 0)]
        run = np.cumsum(~same) - 1
        return ~np.bincount(run, weights=~chosen, minlength=int(run[-1]) + 1).astype(bool)[run]

    def decode_flat(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """Texts of id sequences ``ids[bounds[k]:bounds[k+1]]``."""
        n_rows = len(bounds) - 1
        if not len(ids):
            return pa.array([""] * n_rows, type=pa.large_string())
        surface = self.surface.take(pa.array(ids))
        offsets = np.frombuffer(surface.buffers()[1], dtype=np.int64)[: len(ids) + 1]
        raw = surface.buffers()[2].to_pybytes() if surface.buffers()[2] is not None else b""
        bytes_at = np.r_[0, np.cumsum(self.is_byte[ids])]
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            plain = np.flatnonzero(~self.special[ids[a : min(b, a + 8)]])
            if len(plain) == 0 and b - a > 8:
                plain = np.flatnonzero(~self.special[ids[a:b]])
            # the first piece that shows loses the space that encoding put before the text
            strip = len(plain) > 0 and self.begins_space[ids[a + plain[0]]]
            start = offsets[a] + (1 if strip else 0)
            if self.unk in ids[a:b].tolist():
                strip = strip and self.unk not in ids[a : a + plain[0]].tolist()
                start = offsets[a] + (1 if strip else 0)
            piece = raw[start : offsets[b]]
            if bytes_at[b] > bytes_at[a] and self.special[ids[a : b - 1]].any():
                out.append(self._decode_slow(ids[a:b], strip))
            elif bytes_at[b] > bytes_at[a]:
                try:
                    out.append(piece.decode("utf-8"))
                except UnicodeDecodeError:
                    out.append(self._decode_slow(ids[a:b], strip))
            else:
                out.append(piece.decode("utf-8"))
        return pa.array(out, type=pa.large_string())

    def _decode_slow(self, ids: np.ndarray, strip: bool) -> str:
        """Malformed runs of byte pieces: one U+FFFD for each byte that starts no character."""
        out, run = [], bytearray()

        def flush() -> None:
            k = 0
            while k < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[k : k + size]).decode("utf-8"))
                        k += size
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    k += 1
            run.clear()

        first = True
        for i in ids.tolist():
            part = self.surface[i].as_py()
            if self.is_byte[i]:
                run += part
                first = False
                continue
            flush()
            if part:
                out.append(part.decode("utf-8")[1 if first and strip else 0 :])
                first = False
        flush()
        return "".join(out)


_MODELS: dict[str, tuple[PieceModel, ChunkStore]] = {}


def model(path: str) -> tuple[PieceModel, ChunkStore]:
    """A worker's model and word store, loaded once."""
    if path not in _MODELS:
        loaded = PieceModel(path)
        _MODELS[path] = loaded, ChunkStore(loaded.encode_words)
    return _MODELS[path]


def encode_batch(texts: pa.Array, path: str, add_end: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each block: its first row, its ids flat, and the id bounds of its rows."""
    loaded, store = model(path)
    texts = texts.cast(pa.large_string()).fill_null("")
    mark = pc.replace_substring(texts, SPACE, " ")
    empty, lead = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    led = pc.if_else(pc.equal(mark, empty), empty, pc.binary_join_element_wise(lead, mark, empty))
    for block in blocks(led):
        data = block.data
        if len(data):
            space = data == 32
            cut = space.copy()
            cut[1:] &= ~space[:-1]
            cut[block.offsets[:-1][np.diff(block.offsets) > 0]] = True
            starts = np.flatnonzero(cut)
            ends = np.r_[starts[1:], len(data)]
        else:
            starts = ends = np.zeros(0, dtype=np.int64)
        ids, sizes = store.gather(data, starts, ends)
        at = np.r_[0, np.cumsum(sizes)]
        bounds = at[np.searchsorted(starts, block.offsets)]
        if add_end:
            ids = np.insert(ids, bounds[1:], loaded.end)
            bounds = bounds + np.arange(len(bounds))
        yield block.first, ids, bounds


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", add_end: bool = True) -> DataFrame:
    """``id_col``, ``ids`` array<int>, ``decoded`` string of every whole text; no shuffle.

    Texts are encoded whole, whatever their length; words without spaces of any length merge by
    the same rounds. A null or empty text gives only the end id (none without ``add_end``) and decodes to "".
    Other columns are dropped, so clashing names cannot occur; repeated rows stay repeated; an
    empty table gives an empty result. ``model_path`` must be readable on every executor.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = model(model_path)[0]
        for batch in batches:
            for first, ids, bounds in encode_batch(batch.column(1), model_path, add_end):
                rows = len(bounds) - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, rows), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, type=pa.int32())), loaded.decode_flat(ids, bounds).cast(pa.string())],
                    names=["id", "ids", "decoded"],
                )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and SHA-256 digests of ids (decimal, joined by a space) and of the decoded text."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
