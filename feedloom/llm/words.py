"""Words and code points of many texts at once, as numpy arrays.

A word is a run of bytes other than space and 0x09-0x0D. Words go by 64-bit content
hashes that are the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from feedloom.llm.common import CHUNK_BYTES

WORD = r"[^\x20\x09-\x0D]+"
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z in small letters, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * 2 + 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit over all others."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS = _powers(256, _BASE)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of all texts and where each begins (one more at the end); null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``limit`` bytes each; a longer text is a range alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte after the last, and number of the text of each word."""
    none = np.zeros(0, np.int64)
    if not len(data):
        return none, none, none
    word = ~_SEPARATOR[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    at = offsets[:-1][offsets[:-1] < len(data)]
    first[at] = word[at]
    at = offsets[1:][offsets[1:] > 0] - 1
    last[at] = word[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    before = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum())) - np.repeat(before, lens)
    longest = int(lens.max())
    powers = _POWERS if longest <= len(_POWERS) else _powers(longest, _BASE)
    values = _BYTE_VALUES[data[np.repeat(starts, lens) + place]] * powers[place]
    return mix(np.add.reduceat(values, before) + lens.astype(np.uint64) * np.uint64(_BASE))


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, their counts, and the order that sorts ``keys``."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(keys) else order
    return ordered[first], np.diff(np.r_[first, len(keys)]), order


def code_points(texts: list[str]) -> np.ndarray:
    """Code points of all texts, each text followed by one 0."""
    joined = "\0".join(texts) + "\0"
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)


_fold: np.ndarray | None = None


def folded(points: np.ndarray, digits: bool = False) -> np.ndarray:
    """Letters (and digits, if asked for) in lower case, all else 0."""
    global _fold
    if _fold is None:
        _fold = np.zeros(0x10000, np.uint32)
        for c in range(0x10000):
            s = chr(c)
            if s.isalpha() or s.isdigit():
                _fold[c] = ord(s.lower()[0])
    wide = points >= 0x10000
    out = _fold[np.where(wide, 0, points)]
    if wide.any():
        found, back = np.unique(points[wide], return_inverse=True)
        out[wide] = np.array([c if chr(c).isalnum() else 0 for c in found.tolist()], np.uint32)[back]
    if not digits:
        out[(out >= 48) & (out <= 57)] = 0
    return out
