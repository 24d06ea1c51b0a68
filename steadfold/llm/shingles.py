"""Word-shingle sets of whole texts as sorted 64-bit fingerprints, in numpy over Arrow buffers.

Words are runs of bytes outside 0x20 and 0x09-0x0D after lower-casing A-Z.  A text's set holds its
distinct ``k``-word shingles; a text with fewer words has one element, its whole sequence; a text
without words (or null) has none.  Memory follows the slice in work (about 1 MB of text, or one text
if that is longer), not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on 64-bit words (the public splitmix64 constants)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def stream(index: np.ndarray, salt: int = 0) -> np.ndarray:
    """Reproducible odd 64-bit coefficients by position."""
    return mix((index.astype(U) + U(1 + (salt << 40))) * U(0x9E3779B97F4A7C15)) | U(1)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
IN_WORD = stream(np.arange(4096))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes and where each begins (one more entry than texts); null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def slices(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about SLICE_BYTES each."""
    lo = 0
    while lo < len(at) - 1:
        hi = int(np.searchsorted(at, at[lo] + SLICE_BYTES, side="right")) - 1
        hi = min(max(hi, lo + 1), len(at) - 1)
        yield lo, hi
        lo = hi


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of consecutive texts, and the range of words of each text."""
    base, end = int(at[0]), int(at[-1])
    data = raw[base:end]
    inside = IS_WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = (at[:-1] - base)[at[:-1] < at[1:]]
    begins[heads] = inside[heads]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, U), np.zeros(len(at), np.int64)
    place = np.arange(len(data), dtype=np.int64)
    place -= starts[np.maximum(np.cumsum(begins) - 1, 0)]
    place[~inside] = 0
    weight = IN_WORD[place] if place.max() < len(IN_WORD) else stream(place)
    weight *= LOWER[data].astype(U) + U(1)
    weight[~inside] = 0
    return mix(np.add.reduceat(weight, starts)), np.searchsorted(starts, at - base)


def shingle_hashes(words: np.ndarray, spans: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of every text in order of place, repeats included, and each text's range."""
    factors = stream(np.arange(k), 1)
    counts = np.diff(spans)
    made = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_at = np.concatenate([[0], np.cumsum(made)])
    out = np.empty(int(out_at[-1]), U)
    if len(words) >= k:
        every = np.zeros(len(words) - k + 1, U)
        for j in range(k):
            every += words[j : len(words) - k + 1 + j] * factors[j]
        every = mix(every)
        inner = np.ones(len(every), bool)  # shingles that do not run over the end of their text
        ends = spans[1:]
        for j in range(1, k):
            cut = ends - j
            cut = cut[(cut >= 0) & (cut < len(every))]
            inner[cut] = False
        long = np.repeat(counts >= k, made)
        out[long] = every[inner]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        own = words[spans[i] : spans[i + 1]]
        out[out_at[i]] = mix(np.array([(own * stream(np.arange(len(own)), 2 + len(own))).sum(dtype=U)], U))[0]
    return out, out_at


def shingle_sets(texts: pa.Array, k: int = 5) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of the texts: first and last index, sorted distinct hashes, and each text's range."""
    raw, at = text_bytes(texts)
    for lo, hi in slices(at):
        values, ranges = shingle_hashes(*word_hashes(raw, at[lo : hi + 1]), k)
        for a, b in zip(ranges[:-1], ranges[1:]):
            if b - a > 1:
                values[a:b].sort()
        fresh = np.ones(len(values), bool)
        fresh[1:] = values[1:] != values[:-1]
        firsts = ranges[:-1][ranges[:-1] < ranges[1:]]
        fresh[firsts] = True
        kept = np.concatenate([[0], np.cumsum(fresh)])
        yield lo, hi, values[fresh], kept[ranges]


def set_prints(values: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name a set: two sums of differently mixed elements (0, 0 for the empty set)."""
    sums = []
    for salt in (3, 4):
        run = np.concatenate([np.zeros(1, U), np.cumsum(mix(values * stream(np.array([salt]), 5)[0]), dtype=U)])
        sums.append((run[ranges[1:]] - run[ranges[:-1]]).view(np.int64))
    return sums[0], sums[1]


def bins_of(values: np.ndarray, n_bins: int) -> np.ndarray:
    """Bin of each hash by its high bits, so sorted hashes have sorted bins."""
    return (((values >> U(32)) * U(n_bins)) >> U(32)).astype(np.int64)
