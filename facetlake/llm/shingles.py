"""Word shingles of whole texts as 64-bit hashes, and their one-permutation sketches, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH = 5  # words in a shingle
BINS = 128
ROWS = 4  # bins in a band
BANDS = BINS // ROWS

_RANDOM = np.random.default_rng(20240229)
_ODD = (_RANDOM.integers(0, 1 << 63, size=64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_BYTE = _RANDOM.integers(0, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
# For each bin the order in which it asks the others for a value: optimal densification with
# probes that never repeat.
PROBES = np.array([_RANDOM.permutation(BINS) for _ in range(BINS)])
_BIN_STARTS = np.arange(BINS, dtype=np.uint64) << np.uint64(57)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, _BASE | np.uint64(1), dtype=np.uint64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, A-Z lower-cased, and the number of words of each."""
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    data = _LOWER[np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)]
    inside = ~_BLANK[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edges[0::2], edges[1::2]
    counts = np.bincount(
        np.searchsorted(np.cumsum(sizes), starts, side="right"), minlength=len(texts))
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), counts
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    weighted = _BYTE[data[inside]] * _powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(weighted, first) + lengths.astype(np.uint64) * _ODD[0]), counts


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes; the whole sequence if it is shorter."""
    words, counts = word_hashes(texts)
    n = max(0, len(words) - WIDTH + 1)
    windows = np.zeros(n, dtype=np.uint64)
    for k in range(WIDTH):
        windows += words[k:k + n] * _ODD[1 + k]
    windows = mix(windows)
    at = 0
    for count in counts.tolist():
        if count >= WIDTH:
            yield np.unique(windows[at:at + count - WIDTH + 1])
        elif count:
            one = np.array([(words[at:at + count] * _ODD[1:1 + count]).sum(dtype=np.uint64)])
            yield mix(one + _ODD[10 + count])
        else:
            yield np.zeros(0, dtype=np.uint64)
        at += count


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, whatever their order."""
    a = mix(shingles ^ _ODD[20]).sum(dtype=np.uint64)
    b = mix(shingles ^ _ODD[21]).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """One permutation: the least hash of each of 128 ranges; an empty range takes over the
    value of the first filled one in its probing order."""
    at = np.searchsorted(shingles, _BIN_STARTS)
    filled = at < np.append(at[1:], len(shingles))
    donor = np.arange(BINS)
    empty = np.flatnonzero(~filled)
    if len(empty):
        probes = PROBES[empty]
        donor[empty] = probes[np.arange(len(empty)), np.argmax(filled[probes], axis=1)]
    return shingles[at[donor]]


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of four bins; keys of different bands differ."""
    rows = (values.reshape(BANDS, ROWS) * _ODD[30:30 + ROWS]).sum(axis=1, dtype=np.uint64)
    return mix(rows + np.arange(BANDS, dtype=np.uint64) * _ODD[40]).view(np.int64)


def sketch_bits(values: np.ndarray) -> np.ndarray:
    """One bit of each bin, in two 64-bit words: equal sets agree in all, others in half."""
    return np.packbits((mix(values) & np.uint64(1)).astype(np.uint8)).view(np.int64)
