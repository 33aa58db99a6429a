"""Words, lines and shingles of Arrow string columns, computed with numpy on the UTF-8 buffers.

White space is the ASCII set ``[\\x20\\x09-\\x0D]`` throughout.  Spans are hashed by their 8-byte blocks, all spans of a
chunk at once, without a Python object for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

pa.set_memory_pool(pa.system_memory_pool())  # gives back what large batches took; other pools keep it for later ones

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CHUNK = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MULT = np.random.default_rng(20).integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEED = np.random.default_rng(19).integers(1, 1 << 63, 2, dtype=np.uint64)
_TAIL = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts with about ``limit`` bytes; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        end = min(end, len(column))
        yield row, body[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of the maximal runs of bytes that ``gap`` (256 flags) does not mark."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    body = ~gap[data]
    before = np.empty_like(body)
    before[0], before[1:] = False, body[:-1]
    begin = offsets[:-1]
    before[begin[begin < len(data)]] = False
    after = np.empty_like(body)
    after[-1], after[:-1] = False, body[1:]
    stop = offsets[1:]
    after[stop[stop > 0] - 1] = False
    first, last = np.flatnonzero(body & ~before), np.flatnonzero(body & ~after) + 1
    return first, last, np.searchsorted(offsets, first, "right") - 1


def span_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of each span: the sum of its 8-byte blocks, each put through a mixing function that its place in the span
    selects.  The two values of ``which`` give independent hashes."""
    if not len(first):
        return np.zeros(0, np.uint64)
    size = (last - first).astype(np.int64)
    many = np.maximum((size + 7) >> 3, 1)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.ndarray((len(data) + 8,), "<u8", padded, strides=(1,))
    if many.max() == 1:
        body = mix((eight[first] & _TAIL[size]) ^ mix(_SEED[which : which + 1]))
    else:
        start = np.cumsum(many) - many
        place = np.arange(start[-1] + many[-1]) - np.repeat(start, many)
        block = eight[np.repeat(first, many) + 8 * place] & _TAIL[np.minimum(np.repeat(size, many) - 8 * place, 8)]
        body = np.add.reduceat(mix(block ^ mix(place.astype(np.uint64) * _ODD + _SEED[which])), start)
    return mix(body + size.astype(np.uint64) * _MULT[which])


def windows(words: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and position of each window of ``k`` words within a text."""
    if len(words) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(words) - k + 1
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h += words[j : j + n] * _MULT[j]
    at = np.flatnonzero(text[:n] == text[k - 1 :])
    return mix(h[at]), at


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes) of the ``k``-word shingles of each lower-cased text that has a word."""
    for row, data, offsets in chunks(column):
        data = LOWER[data]
        first, last, text = spans(data, offsets, SPACE)
        words = span_hashes(data, first, last)
        whole, at = windows(words, text, k)
        bounds = np.searchsorted(text[at], np.arange(len(offsets)))
        count = np.searchsorted(text, np.arange(len(offsets)))
        for i in range(len(offsets) - 1):
            if bounds[i] < bounds[i + 1]:
                h = np.sort(whole[bounds[i] : bounds[i + 1]])
                yield row + i, h[np.concatenate(([True], h[1:] != h[:-1]))]
            elif count[i] < count[i + 1]:
                own = words[count[i] : count[i + 1]]
                yield row + i, mix((own * _MULT[: len(own)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own)))
