"""Words, shingles and their 64-bit hashes, for whole Arrow columns at once.

A word's hash depends on its bytes alone, with A-Z lower-cased. Two different
words or shingles share a hash with a chance of about 2**-60; every exactness
statement of the operators that use these hashes is up to that chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

WINDOW = 1 << 19
SLICE_BYTES = 1 << 23
_SPACES = [9, 10, 11, 12, 13, 32]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _series(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_STEP = 0x9E3779B97F4A7C15 | 1
_POWERS = np.cumprod(np.full(WINDOW + 1, _STEP, np.uint64)) * np.uint64(pow(_STEP, -1, 1 << 64))
_BACK = np.cumprod(np.full(WINDOW + 1, pow(_STEP, -1, 1 << 64), np.uint64)) * np.uint64(_STEP)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _series(11, 256)[_LOWER]
_ORDER = _series(23, 64) | np.uint64(1)

#: True where a byte ends a word.
AT_SPACE = np.zeros(256, bool)
AT_SPACE[_SPACES] = True
#: The same, with every ASCII character that is no letter or digit.
AT_MARK = np.ones(256, bool)
AT_MARK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


class Words(NamedTuple):
    """The words of a column: hash, row, and byte range within the buffer."""

    hash: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about `size` bytes of text, so that memory stays bounded."""
    _, offsets = buffer_of(batch.column(column))
    first, rows = 0, batch.num_rows
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield batch.slice(first, last - first)
        first = last


def words_of(data: np.ndarray, offsets: np.ndarray, stops: np.ndarray = AT_SPACE) -> Words:
    """Every word of every row, in order."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, none)
    inside = ~stops[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    found = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = int(np.searchsorted(end, start[i] + WINDOW, side="right"))
        if j <= i:  # one word longer than the window
            word = _LOWER[data[start[i] : end[i]]].tobytes()
            found[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
            i += 1
            continue
        base = start[i]
        part = data[base : end[j - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * _POWERS[: len(part)], out=sums[1:])
        s, e = start[i:j] - base, end[i:j] - base
        found[i:j] = mix((sums[e] - sums[s]) * _BACK[s] + (e - s).astype(np.uint64) * _ORDER[60])
        i = j
    return Words(found, row, start, end)


def joined(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word's index of every run of `size` words within a row."""
    n = len(words.hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += words.hash[k : k + n] * _ORDER[k]
    at = np.flatnonzero(words.row[:n] == words.row[size - 1 :])
    return mix(total[at] + np.uint64(size)), at


class Sets(NamedTuple):
    """Distinct shingles of each row: row i has token[first[i]:first[i + 1]], ascending."""

    token: np.ndarray
    first: np.ndarray


def shingle_sets(column: pa.Array, size: int = 5) -> Sets:
    """Distinct shingles; a row of fewer words has its whole sequence as one."""
    data, offsets = buffer_of(column)
    rows = len(offsets) - 1
    words = words_of(data, offsets)
    many = np.bincount(words.row, minlength=rows) if rows else np.zeros(0, np.int64)
    begin = np.concatenate([[0], np.cumsum(many)]).astype(np.int64)
    token, at = joined(words, size)
    row = words.row[at]
    for k in range(1, size):
        short = np.flatnonzero(many == k)
        if len(short):
            total = np.full(len(short), k + 1000, np.uint64)
            for j in range(k):
                total += words.hash[begin[short] + j] * _ORDER[j]
            token, row = np.concatenate([token, mix(total)]), np.concatenate([row, short])
    if len(token):
        by = np.argsort(row, kind="stable")
        token, row = token[by], row[by]
    edge = np.searchsorted(row, np.arange(rows + 1))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        token[a:b].sort()
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (row[1:] != row[:-1])
    token, row = token[new], row[new]
    return Sets(token, np.searchsorted(row, np.arange(rows + 1)))


def set_keys(sets: Sets) -> np.ndarray:
    """One 64-bit key for each row's set, equal for equal sets; 0 for an empty set."""
    sizes = np.diff(sets.first)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets.token ^ _ORDER[61]))])
    other = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets.token + _ORDER[62]))])
    a = sums[sets.first[1:]] - sums[sets.first[:-1]]
    b = other[sets.first[1:]] - other[sets.first[:-1]]
    keys = mix(a ^ mix(b + sizes.astype(np.uint64)))
    return np.where(sizes > 0, keys, np.uint64(0))
