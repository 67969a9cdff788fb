"""Statistics of whole texts, vectorised over blocks of UTF-8 bytes."""

from __future__ import annotations

import numpy as np

from deltaweave.llm.kernel import WHITE, Block, Hasher, mix, per_row, runs, window_owner_mask, windows, words

SYMBOLS = "#*$%&|<>"

#: Common words of four languages; fixed values.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he this are or his from at which but have an had they you were their one all we can her has there been if more when will would who so no".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen zum war nur oder aber vor zur bis durch man".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son ont aux mais ou comme cette nous leur elle être sa ses je".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta".split(),
}
LANGUAGES = tuple(COMMON_WORDS)
VOCABULARY = tuple(dict.fromkeys(w for ws in COMMON_WORDS.values() for w in ws))

#: Character classes of bytes (continuation bytes belong to their first byte).
CLASSES = ("lower", "upper", "digit", "space", "newline", "stop", "quote", "symbol", "other", "beyond")
_CLASS = np.full(256, CLASSES.index("other"), dtype=np.uint8)
for _bytes, _name in (
    (range(97, 123), "lower"),
    (range(65, 91), "upper"),
    (range(48, 58), "digit"),
    (b" \t\x0b\x0c\r", "space"),
    (b"\n", "newline"),
    (b".,;:!?", "stop"),
    (b"'\"()-", "quote"),
    (SYMBOLS.encode(), "symbol"),
    (range(192, 256), "beyond"),
):
    _CLASS[list(_bytes)] = CLASSES.index(_name)
_CLASS[128:192] = len(CLASSES)  # continuation bytes


def _word_hashes(texts: tuple[str, ...]) -> np.ndarray:
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    ends = np.cumsum([len(r) for r in raw])
    return Hasher(data, lower=True).ranges(ends - [len(r) for r in raw], ends)


_VOCABULARY_HASHES = _word_hashes(VOCABULARY)
_BY_HASH = np.argsort(_VOCABULARY_HASHES)
_SORTED_HASHES = _VOCABULARY_HASHES[_BY_HASH]
_IS_TRAIL = np.zeros(256, dtype=bool)
_IS_TRAIL[list(b".,;:!?")] = True


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which elements occur at least twice."""
    if not len(keys):
        return np.zeros(0, dtype=bool)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def _distinct_per_row(keys: np.ndarray, owners: np.ndarray, rows: int) -> np.ndarray:
    if not len(keys):
        return np.zeros(rows, dtype=np.int64)
    order = np.lexsort((keys, owners))
    k, o = keys[order], owners[order]
    return np.bincount(o[np.r_[True, (k[1:] != k[:-1]) | (o[1:] != o[:-1])]], minlength=rows)


def block_stats(block: Block, more: bool = True) -> dict[str, np.ndarray]:
    """Per document: the base counts, and with ``more`` histograms and further counts.

    ``classes`` is rows x len(CLASSES); ``common`` is rows x len(VOCABULARY), counts of common
    words (A-Z lowered, without one trailing stop mark).
    """
    data, offsets, rows = block.data, block.offsets, block.rows
    found = words(block)
    bounds, owners = found.bounds, found.owners()
    counts = found.counts
    kinds = _CLASS[data]
    white = WHITE[data]
    first_bytes = kinds < len(CLASSES)
    hasher = Hasher(data)
    hashes = hasher.ranges(found.starts, found.ends)

    new_line = data == 10
    inside = runs(~new_line, offsets)
    with_word = per_row(~white, offsets) if len(data) == 0 else None
    sums = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(~white, out=sums[1:])
    with_word = sums[inside.ends] > sums[inside.starts]
    line_hash = hasher.ranges(inside.starts[with_word], inside.ends[with_word])
    line_owner = inside.owners()[with_word]
    n_lines = np.bincount(line_owner, minlength=rows)

    triples = windows(hashes, 3, 3)
    mine = window_owner_mask(bounds, 3, len(hashes))
    at = np.flatnonzero(mine)
    again = at[_repeats(triples[at] ^ mix(owners[at].astype(np.uint64), 9))]
    covered = np.zeros(len(hashes), dtype=bool)
    for k in range(3):
        covered[again + k] = True

    out = {
        "n_words": counts,
        "word_chars": per_row(first_bytes & ~white, offsets),
        "n_symbols": per_row(kinds == CLASSES.index("symbol"), offsets),
        "n_dup_lines": n_lines - _distinct_per_row(line_hash, line_owner, rows),
        "n_repeat_words": per_row(covered, bounds),
    }
    if not more:
        return out
    owner_of_byte = np.repeat(np.arange(rows, dtype=np.int64), np.diff(offsets))
    out["classes"] = np.bincount(owner_of_byte * (len(CLASSES) + 1) + kinds, minlength=rows * (len(CLASSES) + 1)).reshape(rows, -1)[:, :-1]
    last = found.ends - 1
    short = (found.ends - found.starts > 1) & _IS_TRAIL[data[last]] if len(last) else np.zeros(0, dtype=bool)
    small = np.flatnonzero(found.ends - found.starts <= 8)
    lowered = Hasher(data, lower=True).ranges(found.starts[small], found.ends[small] - short[small])
    slot = np.minimum(np.searchsorted(_SORTED_HASHES, lowered), len(_SORTED_HASHES) - 1)
    hit = _SORTED_HASHES[slot] == lowered
    out["common"] = np.bincount(owners[small][hit] * len(VOCABULARY) + _BY_HASH[slot[hit]], minlength=rows * len(VOCABULARY)).reshape(rows, -1)
    out["n_lines"] = n_lines
    out["n_distinct"] = _distinct_per_row(hashes, owners, rows)
    out["n_pipes"] = per_row(data == 124, offsets)
    out["n_bangs"] = per_row(data == 33, offsets)
    out["n_stops"] = per_row(data == 46, offsets)
    if len(hashes):
        same = np.zeros(len(hashes), dtype=bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (owners[1:] == owners[:-1])
        out["n_stutters"] = per_row(same, bounds)
        long_ = found.ends - found.starts > 20
        out["n_long"] = per_row(long_, bounds)
    else:
        out["n_stutters"] = out["n_long"] = np.zeros(rows, dtype=np.int64)
    return out
