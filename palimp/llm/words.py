"""Words of whole Arrow batches as numpy arrays, without a Python loop over texts.

A batch of texts becomes one byte buffer; words are runs of ASCII letters and
digits; each word gets a 64-bit hash that depends on its bytes only. The hash
of a run is a difference of prefix sums times the inverse of the base's power.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text that are held as arrays at once.
SLICE_BYTES = 1 << 20


def _byte_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    is_word = np.zeros(256, bool)
    is_word[48:58] = is_word[97:123] = is_word[65:91] = True
    value = mix(np.arange(1, 257, dtype=np.uint64))
    return lower, is_word, value[lower]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (the one of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_LOWER, _IS_WORD, _VALUE = _byte_tables()
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[65:91] = _IS_LETTER[97:123] = True
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of them."""
    if "p" not in _powers or len(_powers["p"]) < n:
        m = max(n, SLICE_BYTES + 4096)
        for k, b in (("p", _BASE), ("i", _BASE_INVERSE)):
            a = np.full(m, b, np.uint64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers["p"], _powers["i"]


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row and the n + 1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def binary_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values in a row and the n + 1 offsets into them; null is empty."""
    return text_buffer(column.cast(pa.large_binary()).view(pa.large_string()) if not column.null_count else column.fill_null(b"").cast(pa.large_binary()).view(pa.large_string()))


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes; a longer text is alone in its range."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = to


def words(raw: np.ndarray, offsets: np.ndarray, commands: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and length of every word of the texts, in order.

    ``commands``: a backslash followed by ASCII letters is a blank.
    """
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = _IS_WORD[raw]
    first = np.zeros(len(raw), bool)
    cuts = offsets[:-1][offsets[:-1] < len(raw)]
    first[cuts] = True
    if commands and (slash := np.flatnonzero(raw[:-1] == 92)).size:
        letter = _IS_LETTER[raw]
        slash = slash[letter[slash + 1] & ~first[slash + 1]]
        if slash.size:
            stop = np.flatnonzero(~letter | first)
            end = np.searchsorted(stop, slash + 1)
            end = np.where(end < len(stop), np.append(stop, len(raw))[end], len(raw))
            delta = np.zeros(len(raw) + 1, np.int32)
            np.add.at(delta, slash + 1, 1)
            np.add.at(delta, end, -1)
            inside &= np.cumsum(delta[:-1]) == 0
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | first))
    if not start.size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:] & ~first[1:]
    end = np.flatnonzero(inside & ~after) + 1
    power, inverse = _power(len(raw) + 1)
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_VALUE[raw] * power[: len(raw)], out=sums[1:])
    length = end - start
    h = (sums[end] - sums[start]) * inverse[start]
    h = mix(h + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    counts = np.searchsorted(start, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(counts))
    return h, text, length


def grams(h: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and first word of every run of n words within a text."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(text[: len(text) - n + 1] == text[n - 1 :])
    g = np.zeros(len(at), np.uint64)
    for k in range(n):
        g = mix(g + h[at + k] + np.uint64(k + 1))
    return g, text[at], at
