"""Vectorised hashes over the UTF-8 bytes of a batch of texts; used inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
#: Odd multipliers for the places of a shingle.
_PLACES = (np.arange(1, 65, dtype=U) * U(0xD6E8FEB86659FD93)) | U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, U), np.full(n, inverse, U)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; sizes are rounded up, so that batches share them."""
    up, down = _powers(1 << max(10, (n + 1).bit_length()))
    return up, down


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and the offsets of its values; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(data: np.ndarray, offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, end, bytes, offsets)`` of runs of whole texts with about ``limit`` bytes, which bounds the memory for their hashes."""
    i = 0
    while i < len(offsets) - 1:
        k = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, k, data[offsets[i] : offsets[k]], offsets[i : k + 1] - offsets[i]
        i = k


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums; ``(p[b] - p[a]) * inverse[a]`` hashes ``data[a:b]``."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], dtype=U, out=out[1:])
    return out


def ranges_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums) - 1)
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(U) * U(0xA0761D6478BD642F))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and the offsets of each text's words among them."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    begin = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return ranges_hash(prefix_sums(data), begin, end), np.searchsorted(begin, offsets)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` neighbouring word hashes, across texts too; the caller takes those inside a text."""
    if len(words) < n:
        return np.zeros(0, U)
    out = np.zeros(len(words) - n + 1, U)
    for k in range(n):
        out += words[k : len(words) - n + 1 + k] * _PLACES[k]
    return mix(out)


def short_hash(words: np.ndarray) -> np.ndarray:
    """The one shingle of a text with fewer words than a shingle has."""
    return mix((words * _PLACES[: len(words)]).sum(dtype=U, keepdims=True) + np.array([len(words)], U) * U(0xE7037ED1A0B428DB))


def set_id(distinct: np.ndarray) -> int:
    """A 63-bit digest of a set of hashes."""
    a = mix(distinct ^ U(0x8EBC6AF09C88C6E3)).sum(dtype=U, keepdims=True)
    b = np.bitwise_xor.reduce(mix(distinct ^ U(0x589965CC75374CC3)), keepdims=True)
    return int(mix(a + mix(b) + np.array([len(distinct)], U))[0] >> U(1))


def character_shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` characters of each text (one for a shorter text), and each text's first; no text may be empty."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    texts = np.searchsorted(at, offsets)
    last = np.repeat(texts[1:], np.diff(texts))
    place = np.arange(len(at))
    begins = np.flatnonzero((place + n <= last) | (place == np.repeat(texts[:-1], np.diff(texts))))
    ends = np.minimum(begins + n, last[begins])
    bounds = np.append(at, len(data))
    return ranges_hash(prefix_sums(data), bounds[begins], bounds[ends]), np.searchsorted(begins, texts[:-1])


def quick_shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``character_shingles`` with 32-bit hashes, several times as fast: for signatures, not for exact sets."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    value = data[at].astype(np.uint32)
    wide = np.flatnonzero(np.diff(at, append=len(data)) > 1)
    for k in range(1, 4):
        wide = wide[np.diff(np.append(at, len(data)))[wide] > k]
        value[wide] |= data[at[wide] + k].astype(np.uint32) << np.uint32(8 * k)
    place = (mix(_PLACES[:n]) >> U(32)).astype(np.uint32) | np.uint32(1)
    begin = np.searchsorted(at, offsets)
    long = np.diff(begin)
    whole = max(0, len(value) - n + 1)
    out = np.zeros(len(value), np.uint32)
    for k in range(n):
        out[:whole] += value[k : k + whole] * place[k]
    kept = np.ones(len(value), bool)
    for k in range(1, n):
        kept[(begin[1:] - k)[long >= k]] = False
    for m in range(1, n):  # a shorter text is one shingle
        first = begin[:-1][long == m]
        out[first] = 0x9E3779B1 * m & 0xFFFFFFFF
        for k in range(m):
            out[first] += value[first + k] * place[k]
        kept[first] = True
    out = out[kept]
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x85EBCA6B)
    out ^= out >> np.uint32(13)
    out *= np.uint32(0xC2B2AE35)
    out ^= out >> np.uint32(16)
    return out, np.concatenate(([0], np.cumsum(np.maximum(long - n + 1, 1))[:-1])).astype(np.int64)
