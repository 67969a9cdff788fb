"""Vectorised text primitives over Arrow batches, shared by the operators of this subpackage.

A *block* is a bounded slice of an Arrow batch: the UTF-8 bytes of its texts in one numpy
array with document offsets. Everything here works on whole texts; blocks only bound memory
(a text longer than the bound is a block of its own). Null texts count as empty.

Hashes are 64-bit polynomials over fixed pseudo-random symbol values, finished by a mixer;
where equality must hold across a whole corpus, callers pair two of them (128 bits).
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
U64 = np.uint64

#: ASCII white space as the contracts define words: space and tab to carriage return.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_VALUES = np.random.Generator(np.random.PCG64(20_240_917)).integers(1, 1 << 63, size=256, dtype=np.int64).astype(U64)
_LOWER_VALUES = _VALUES.copy()
_LOWER_VALUES[65:91] = _VALUES[97:123]
_BASE = 0x9E3779B97F4A7C55
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Bijective 64-bit finaliser; different seeds give independent-looking values."""
    x = x ^ U64((seed * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) & (2**64 - 1))
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(29))) * U64(0xCA5A826395121157)
    return x ^ (x >> U64(32))


def fresh(name: str, taken: Iterable[str]) -> str:
    """The name, with underscores added until no taken one equals it (as Spark compares names)."""
    lowered = {t.lower() for t in taken}
    while name.lower() in lowered:
        name += "_"
    return name


def give_back() -> None:
    """Return freed memory to the system: Arrow's pool and the C library keep it otherwise, and a
    worker that waits for its next task holds what its executor needs."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that leaves no freed memory in its worker."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                a = np.full(size, base, dtype=U64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


@dataclass
class Block:
    first: int  # row of the batch at which the block starts
    data: np.ndarray  # uint8, all texts of the block
    offsets: np.ndarray  # int64, len = rows + 1

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Slices of consecutive rows with at most ``limit`` bytes, or one longer row."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield Block(row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end


class Hasher:
    """Hashes of byte ranges of a block, by one running sum."""

    def __init__(self, data: np.ndarray, lower: bool = False) -> None:
        up, self.down = _POWERS.upto(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum((_LOWER_VALUES if lower else _VALUES)[data] * up[:-1], out=self.sums[1:])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


@dataclass
class Words:
    starts: np.ndarray  # byte positions in the block
    ends: np.ndarray
    bounds: np.ndarray  # word index at each document's start; len = rows + 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def runs(inside: np.ndarray, offsets: np.ndarray) -> Words:
    """Maximal runs of True bytes, cut at document borders."""
    n = len(inside)
    if not n:
        empty = np.zeros(0, dtype=np.int64)
        return Words(empty, empty, np.zeros(len(offsets), dtype=np.int64))
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    borders = offsets[:-1][np.diff(offsets) > 0]
    before[borders] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:] & before[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets))


def words(block: Block) -> Words:
    """Runs of bytes outside ASCII white space."""
    return runs(~WHITE[block.data], block.offsets)


def windows(hashes: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Order-sensitive hash of each ``width`` consecutive word hashes (across borders too)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    values = mix(hashes, seed)
    if width <= 8:
        total = np.zeros(n, dtype=U64)
        for k in range(width):
            total = total * U64(_BASE) + values[k : k + n]
        return mix(total, seed)
    up, down = _POWERS.upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[:n], seed)


def window_owner_mask(bounds: np.ndarray, width: int, total: int) -> np.ndarray:
    """Which window starts lie wholly inside one document."""
    n = total - width + 1
    if n <= 0:
        return np.zeros(0, dtype=bool)
    counts = np.diff(bounds)
    last = np.repeat(bounds[1:] - width, counts)[:n]
    return np.arange(n) <= last


def per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` between consecutive bounds."""
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


class HashIndex:
    """Open-addressed map from 64-bit hashes to small integers, looked up in bulk."""

    def __init__(self, bits: int = 20) -> None:
        self.bits = bits
        self.keys, self.values = np.zeros(1 << bits, dtype=U64), np.full(1 << bits, -1, dtype=np.int64)

    def _probe(self, hashes: np.ndarray):
        """Rounds of (positions still open, their slots)."""
        slots = (hashes >> U64(64 - self.bits)).astype(np.int64)
        open_ = np.arange(len(hashes))
        while len(open_):
            going = yield open_, slots[open_]
            open_ = open_[going]
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)

    def get(self, hashes: np.ndarray) -> np.ndarray:
        """Values of the hashes, -1 where there is none."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        rounds = self._probe(hashes)
        try:
            open_, slots = next(rounds)
            while True:
                taken = self.values[slots] >= 0
                hit = taken & (self.keys[slots] == hashes[open_])
                out[open_[hit]] = self.values[slots[hit]]
                open_, slots = rounds.send(taken & ~hit)
        except StopIteration:
            return out

    def put(self, hashes: np.ndarray, values: np.ndarray) -> None:
        """Add hashes that are distinct and not there yet."""
        rounds = self._probe(hashes)
        try:
            open_, slots = next(rounds)
            while True:
                free = self.values[slots] < 0
                self.values[slots[free]] = values[open_[free]]  # of several, the last stays
                won = free & (self.values[slots] == values[open_])
                self.keys[slots[won]] = hashes[open_[won]]
                open_, slots = rounds.send(~won)
        except StopIteration:
            return


class ChunkStore:
    """Results for distinct chunks of text, kept flat and looked up by 64-bit hash.

    ``encode`` maps a list of byte strings to all their values, flat, and the number of values
    of each. The store is emptied when it passes ``limit`` chunks or eight times as many
    values, so a worker's memory is bounded whatever the corpus.
    """

    def __init__(self, encode, limit: int = 400_000) -> None:
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.index, self.count = HashIndex(), 0
        self.flat, self.used = np.zeros(1 << 16, dtype=np.int32), 0
        self.starts, self.sizes = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64)

    def gather(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All values of all chunks in order, and the number of values of each chunk."""
        if not len(starts):
            return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        hashes = Hasher(data).ranges(starts, ends)
        if self.count > self.limit or self.used > 8 * self.limit:
            self.clear()
        slots = self.index.get(hashes)
        if len(missing := np.flatnonzero(slots < 0)):
            new, first, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            if self.count + len(new) > 2 * self.limit:  # a huge text: its chunks get an index of their own
                self.index = HashIndex(int(self.count + len(new)).bit_length() + 1)
                self.count = self.used = 0
                new, first, back = np.unique(hashes, return_index=True, return_inverse=True)
                missing = np.arange(len(hashes))
            raw, at, to = data.tobytes(), starts[missing[first]].tolist(), ends[missing[first]].tolist()
            flat, sizes = self.encode([raw[a:b] for a, b in zip(at, to, strict=True)])
            numbers = self.count + np.arange(len(new))
            self.index.put(new, numbers)
            slots[missing] = numbers[back]
            self._put("flat", self.used, flat)
            self._put("starts", self.count, self.used + np.cumsum(sizes) - sizes)
            self._put("sizes", self.count, sizes)
            self.used += len(flat)
            self.count += len(new)
        sizes = self.sizes[slots]
        shift = np.repeat(self.starts[slots] - (np.cumsum(sizes) - sizes), sizes)
        return self.flat[shift + np.arange(len(shift))], sizes

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        array = getattr(self, name)
        if at + len(values) > len(array):
            grown = np.zeros(max(at + len(values), 2 * len(array)), dtype=array.dtype)
            grown[:at] = array[:at]
            setattr(self, name, array := grown)
        array[at : at + len(values)] = values
