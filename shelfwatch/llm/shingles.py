"""Word shingles of whole batches of texts as numpy hashes.

Texts are lower-cased by the caller and taken as UTF-8. A word's hash is a polynomial over its bytes modulo 2^64,
got for all words at once from prefix sums; a shingle's hash mixes the hashes of its words in order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; neighbouring inputs give unrelated outputs."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(33))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes and the n + 1 offsets of the texts (null counts as empty)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the number of words of each text."""
    data, offsets = bytes_of(texts)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.append(False, inside[:-1])))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.append(inside[1:], False))) + 1
    counts = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    if not len(starts):
        return np.empty(0, np.uint64), counts
    sums = np.append(np.uint64(0), np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), dtype=np.uint64))
    return mixed((sums[ends] - sums[starts]) * _powers(_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64)), counts


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every shingle and the text it belongs to; a text of fewer words is one shingle, one without words none."""
    words, counts = word_hashes(texts)
    if not len(words):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    acc, factor = np.zeros(len(words), np.uint64), 1
    place = np.arange(len(words)) - first[owner]
    for j in range(width):
        factor = (factor * 0xD6E8FEB86659FD93 + 0x632BE59BD9B4E019) % (1 << 64)
        there = np.flatnonzero(place + j < counts[owner])
        acc[there] += words[there + j] * np.uint64(factor)
    full = (place + width <= counts[owner]) | (place == 0)
    return mixed(acc[full]), owner[full]
