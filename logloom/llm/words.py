"""Words and their 64-bit hashes for whole Arrow batches, computed on the UTF-8 bytes.

A word is a run of word bytes; which bytes those are is a 256-entry table. All texts of a slice are
hashed at once, so no Python code runs per word. Two different words share a hash with a chance of about 2**-64.
"""

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

SLICE_BYTES = 2_000_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: every byte but ASCII white space
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[32, 9, 10, 11, 12, 13]] = False
#: digits, letters and all bytes of characters beyond ASCII
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[48:58] = ALPHANUMERIC[97:123] = ALPHANUMERIC[128:] = True
#: letters and all bytes of characters beyond ASCII
LETTERS = ALPHANUMERIC.copy()
LETTERS[48:58] = False

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 bits (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    pair = []
    for base in (_BASE, _INVERSE):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        np.multiply.accumulate(p, out=p)
        pair.append(p)
    if n <= 2 * SLICE_BYTES:  # one very long text must not stay in memory
        _powers[:] = pair
    return pair[0], pair[1]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets); a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of at most ``limit`` bytes together; a longer text stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): bytes of every word, and per text the index of its first word (n + 1 entries)."""
    if len(data) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = kind[_LOWER[data]]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = edges[edges > 0] - 1
    ends[last] = inside[last]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets)


def running_hash(data: np.ndarray) -> np.ndarray:
    """Sums from which ``span_hashes`` takes the hash of any span, with A-Z in lower case."""
    power, _ = _grown(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_VALUE[_LOWER[data]] * power[: len(data)], out=total[1:])
    return total


def span_hashes(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inverse = _grown(len(total))
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each word with A-Z in lower case."""
    return span_hashes(running_hash(data), start, end)


def parts(column: pa.Array, kind: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of whole texts: (index of the first text, bytes, word starts, word ends, first word per text and one more)."""
    data, offsets = text_bytes(column)
    for lo, hi in slices(offsets, limit):
        part = data[offsets[lo] : offsets[hi]]
        yield lo, part, *spans(part, offsets[lo : hi + 1] - offsets[lo], kind)


def hashed(column: pa.Array, kind: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the slice's first text, word hashes, first word per text with one entry more)."""
    for lo, part, start, end, first in parts(column, kind):
        yield lo, word_hashes(part, start, end), first


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words (empty if there are fewer)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _BASE + words[i : i + n]
    return mix(out + np.uint64(k))


def ascii_lower(text: Column) -> Column:
    """Only A-Z in lower case; texts without other letters take the quicker way."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))
