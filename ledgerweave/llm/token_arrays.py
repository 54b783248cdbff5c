"""Words and shingles of a whole Arrow batch as flat numpy arrays; small helpers inside tasks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Blanks become spaces and A-Z become a-z; both are single bytes in UTF-8, so lengths stay.
_FOLD = bytes(
    32 if b in (9, 10, 11, 12, 13) else b + 32 if 65 <= b <= 90 else b for b in range(256)
)
_KEEP_CASE = bytes(32 if b in (9, 10, 11, 12, 13) else b for b in range(256))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


@dataclass
class Words:
    """``ids`` index ``dictionary``; row i owns ids[offsets[i]:offsets[i + 1]].

    ``begin`` and ``end`` are code points from the row's start; ``stop`` marks a word that ends a sentence or line,
    ``line`` one that ends a line.
    """

    ids: np.ndarray
    dictionary: pa.Array
    offsets: np.ndarray
    begin: np.ndarray | None = None
    end: np.ndarray | None = None
    stop: np.ndarray | None = None
    line: np.ndarray | None = None


def split_words(texts: pa.Array, fold: bool = True, places: bool = False) -> Words:
    """Cut all texts at blanks (code points 32 and 9 to 13); a null has no words."""
    texts = texts.cast(pa.large_string()).fill_null("")
    starts_of_rows = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    lo, hi = int(starts_of_rows[0]), int(starts_of_rows[-1])
    data = texts.buffers()[2]
    raw = memoryview(data)[lo:hi].tobytes() if data is not None else b""
    buf = np.frombuffer(raw.translate(_FOLD if fold else _KEEP_CASE), dtype=np.uint8)
    rows = starts_of_rows - lo
    word = buf != 32
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[rows] = True
    before = np.empty(len(buf), dtype=bool)
    if len(buf):
        before[0] = True
        before[1:] = ~word[:-1]
    starts = np.flatnonzero(word & (before | edge[:-1]))
    after = np.empty(len(buf), dtype=bool)
    if len(buf):
        after[-1] = True
        after[:-1] = ~word[1:]
    ends = np.flatnonzero(word & (after | edge[1:])) + 1
    bounds = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=bounds[1:])
    flat = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(buf[word])]
    )
    coded = flat.dictionary_encode()
    found = Words(
        np.asarray(coded.indices).astype(np.int64), coded.dictionary, np.searchsorted(starts, rows, side="left").astype(np.int64)
    )

    if places:
        bytes_ = np.frombuffer(raw, dtype=np.uint8)
        points = np.zeros(len(bytes_) + 1, dtype=np.int64)
        np.cumsum((bytes_ & 0xC0) != 0x80, out=points[1:])
        row = np.repeat(np.arange(len(rows) - 1), np.diff(found.offsets))
        found.begin, found.end = points[starts] - points[rows[row]], points[ends] - points[rows[row]]
        lines = np.zeros(len(bytes_) + 1, dtype=np.int64)
        np.cumsum(bytes_ == 10, out=lines[1:])
        following = np.append(starts[1:], len(bytes_))
        found.line = lines[following] > lines[ends]
        found.stop = np.isin(buf[ends - 1], (33, 46, 63)) | found.line
    return found


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash for every word position."""
    unique = np.fromiter(
        (xxhash.xxh3_64_intdigest(w) for w in words.dictionary.to_pylist()), dtype=np.uint64, count=len(words.dictionary)
    )
    return unique[words.ids]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _shingles(texts: pa.Array, k: int, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles row after row, and the rows' offsets.

    A row with fewer than k words has its whole sequence as one shingle, a row without words none.
    """
    words = split_words(texts, fold)
    h = word_hashes(words)
    full = np.zeros(max(len(h) - k + 1, 0), dtype=np.uint64)
    for j in range(k):
        full += h[j : len(h) - k + 1 + j] * _ODD[j]
    full = mix(full)
    length = np.diff(words.offsets)
    count = np.where(length >= k, length - k + 1, np.minimum(length, 1))
    offsets = np.append(0, np.cumsum(count))
    at = np.arange(offsets[-1]) + np.repeat(words.offsets[:-1] - offsets[:-1], count)
    out = np.zeros(len(at), dtype=np.uint64)
    whole = np.repeat(length >= k, count)
    out[whole] = full[at[whole]]
    for i in np.flatnonzero((length > 0) & (length < k)):
        short = np.uint64(length[i]) * np.uint64(0x2545F4914F6CDD1D)
        with np.errstate(over="ignore"):
            for j in range(length[i]):
                short = short + h[words.offsets[i] + j] * _ODD[j]
        out[offsets[i]] = mix(np.array([short], dtype=np.uint64))[0]
    return out, offsets


def shingle_sets(texts: pa.Array, k: int, fold: bool = True) -> list[np.ndarray]:
    """Per row the sorted distinct 64-bit hashes of its k-word shingles."""
    full, offsets = _shingles(texts, k, fold)
    return [np.unique(full[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]


def distinct_shingles(texts: pa.Array, k: int, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct k-word shingles of every row, row after row, and the rows' offsets; one sort for the whole batch."""
    full, offsets = _shingles(texts, k, fold)
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    _, first = np.unique(mix(full + row.astype(np.uint64) * _ODD[4]), return_index=True)
    first.sort()
    return full[first], np.append(0, np.cumsum(np.bincount(row[first], minlength=len(texts))))


def segments(flat: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of ``rows`` one after the other, and the number of values of each."""
    size = np.diff(offsets)[rows]
    upto = np.cumsum(size) - size
    return flat[np.arange(size.sum()) + np.repeat(offsets[rows] - upto, size)], size


def minmax_signature(values: np.ndarray, scale: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Minimum and maximum of every multiply-shift permutation: 2 * len(scale) values of 32 bits."""
    low = np.full(len(scale), 0xFFFFFFFF, dtype=np.uint64)
    high = np.zeros(len(scale), dtype=np.uint64)
    for at in range(0, len(values), 2048):
        p = (values[at : at + 2048, None] * scale + shift) >> np.uint64(32)
        np.minimum(low, p.min(axis=0), out=low)
        np.maximum(high, p.max(axis=0), out=high)
    return np.concatenate([low, high])


def permutations(n: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band over ``rows`` values each; the band's number is part of the key."""
    grid = signature[: bands * rows].reshape(rows, bands)
    key = mix(np.arange(1, bands + 1, dtype=np.uint64) * _ODD[0])
    for r in range(rows):
        key = mix(key ^ (grid[r] * _ODD[1 + r % 7]))
    return key.view(np.int64)


def in_pieces(batches, *texts: int, most: int = 2 << 20):
    """The same rows in batches whose columns ``texts`` hold at most ``most`` bytes, or one row; Spark bounds its own by 64 MB.

    Work arrays take some tens of bytes per byte of text, so this bounds a task's memory whatever the lengths of the texts.
    """
    for batch in batches:
        size = np.zeros(batch.num_rows, dtype=np.int64)
        for at in texts:
            size += np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0), dtype=np.int64)
        upto = np.cumsum(size)
        first = 0
        while first < batch.num_rows:
            done = upto[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(upto, done + most, side="right")))
            yield batch.slice(first, last - first)
            first = last
        if not batch.num_rows:
            yield batch
