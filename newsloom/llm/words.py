"""Word and shingle hashes of Arrow text columns, a whole batch at a time.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D after lower-casing A-Z. A document's shingles are its
five-word windows; with one to four words the whole sequence is its only shingle; with none it has none. Hashes have
64 bits and do not depend on the process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_PLACE, _SIZE = _U(0x9E3779B97F4A7C55), _U(0xC2B2AE3D27D4EB4F)
#: What of eight bytes belongs to a word that has so many left.
_LEFT = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], _U)
_Q = [_U(pow(0xD1342543DE82EF95, j, 2**64)) for j in range(8)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
SHINGLE = 5
#: Bytes of text worked on at once; a longer text is worked on by itself, its words SLICE_WORDS at a time.
CHUNK_BYTES, SLICE_WORDS = 1 << 18, 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and the documents' offsets in them; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(at: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about `size` bytes each; a longer document is a range of its own."""
    first = 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        yield first, last
        first = last


def _word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and how many words come before each document."""
    n = len(raw)
    if not n:
        return np.empty(0, _U), np.zeros(len(at), np.int64)
    solid = ~_SPACE[raw]
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    firsts, lasts = at[:-1], at[1:] - 1
    full = lasts >= firsts
    start[firsts[full]] |= solid[firsts[full]]
    end[lasts[full]] |= solid[lasts[full]]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end)
    data = np.zeros(n + 8, np.uint8)
    data[:n] = _LOWER[raw]
    out = np.empty(len(starts), _U)
    for first in range(0, len(starts), SLICE_WORDS):
        part = slice(first, first + SLICE_WORDS)
        out[part] = _spans(data, starts[part], ends[part] + 1 - starts[part])
    return out, np.searchsorted(starts, at)


def _spans(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of spans of data, which ends with eight bytes of no span: each eight bytes of a span are mixed with their place
    in it, added up, and mixed with its size. No such sum has collisions by its form, as a polynomial modulo 2^64 does."""
    eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    n = (sizes + 7) >> 3
    first = np.cumsum(n) - n
    of = np.repeat(np.arange(len(sizes)), n)
    place = np.arange(len(of)) - first[of]
    read = eights[starts[of] + 8 * place] & _LEFT[np.minimum(sizes[of] - 8 * place, 8)]
    return mix(np.add.reduceat(mix(mix(read) ^ ((place + 1).astype(_U) * _PLACE)), first) + sizes.astype(_U) * _SIZE)


def word_hashes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, hash of every word, words before each row) for ranges of rows."""
    whole, at = text_buffer(column)
    with np.errstate(over="ignore"):
        for a, b in chunks(at):
            yield a, b, *_word_hashes(whole[at[a] : at[b]], at[a : b + 1] - at[a])


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """For each document its shingle hashes, ascending, each once."""
    whole, at = text_buffer(column)
    with np.errstate(over="ignore"):
        for a, b in chunks(at):
            words, first = _word_hashes(whole[at[a] : at[b]], at[a : b + 1] - at[a])
            m = max(0, len(words) - SHINGLE + 1)
            rolled = np.zeros(m, _U)
            for j in range(SHINGLE):
                rolled += words[j : j + m] * _Q[j]
            rolled = mix(rolled)
            for i in range(b - a):
                lo, hi = first[i], first[i + 1]
                if hi - lo >= SHINGLE:
                    own = np.sort(rolled[lo : hi - SHINGLE + 1])
                    yield own[np.concatenate(([True], own[1:] != own[:-1]))]
                elif hi > lo:
                    yield mix(np.array([sum(int(w) * int(q) for w, q in zip(words[lo:hi], _Q[1:])) + int(hi - lo) & (2**64 - 1)], _U))
                else:
                    yield np.empty(0, _U)
