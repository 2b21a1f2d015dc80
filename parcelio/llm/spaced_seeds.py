"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over consecutive words: some positions are hashed, others
ignored, so that a substituted word there does not hide the passage. Training
and test texts that share a seed's hash are laid on each other at that place,
and the words around it are compared. The masks are chosen so that no passage
can avoid all of them (see MASKS). An item shorter than SHORT words is hashed as
a whole, and found where all its words stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelio.llm import tokens as T
from parcelio.llm.shared import filtered, ship, texts

#: 1: the word counts; 0: it is ignored. In every stretch that makes a passage of an item of SHORT
#: or more words, however the substituted words lie, at least one mask has all its words equal. This
#: was found by covering all placements of the substitutions in 11 to 20 words, and holds for longer
#: stretches by a search over all endings; the tests go through the placements in 11 to 25 words.
MASKS = ("1111011", "1110100011", "10011111", "1100010111")
#: Items with fewer words are found by exact copies.
SHORT = 11
#: A passage: so many equal words (or this share of a shorter item) in a stretch with at least this share of equal words.
LEAST_WORDS = 13
LEAST_SHARE = 0.8
#: Words of the benchmark that one pass holds in every task; more are taken in several passes.
BLOCK_WORDS = 1 << 20
#: Hits, and words of alignments, that a task handles at a time.
HITS_AT_ONCE = 1 << 18
WORDS_AT_ONCE = 1 << 21
_HITS = "doc_id long, text_key long, n_equal long, n_words long, first_word long"


class Index(NamedTuple):
    """Seed hashes in order with their text and place; the texts' keys, words and bounds; lengths of the short ones."""

    seed: np.ndarray
    item: np.ndarray
    place: np.ndarray
    keys: np.ndarray
    word: np.ndarray
    first: np.ndarray
    lengths: list


def _seeds(words: T.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each mask: hash and first word's index of every run of words within a row."""
    for number, mask in enumerate(MASKS):
        n = len(words.hash) - len(mask) + 1
        if n <= 0:
            continue
        total = np.full(n, number + 1, np.uint64)
        for k in (k for k, on in enumerate(mask) if on == "1"):
            total += words.hash[k : k + n] * np.uint64(2 * T.WINDOW * (k + 1) + 1)
        at = np.flatnonzero(words.row[:n] == words.row[len(mask) - 1 :])
        yield T.mix(T.mix(total[at]) + np.uint64(number)), at


def _runs(words: T.Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word's index of every run of so many words within a row, apart from the seeds."""
    token, at = T.joined(words, length)
    return T.mix(token + np.uint64(len(MASKS) + length)), at


def _index(items: pa.Table) -> Index:
    """The index of distinct texts (`text_key`, `text`)."""
    words = T.words_of(*T.buffer_of(items["text"]), T.AT_MARK)
    first = np.searchsorted(words.row, np.arange(items.num_rows + 1))
    sizes = np.diff(first)
    found = [(seed[long], at[long]) for seed, at in _seeds(words) for long in [sizes[words.row[at]] >= SHORT]]
    lengths = [k for k in np.unique(sizes).tolist() if 0 < k < SHORT]
    for k in lengths:
        seed, at = _runs(words, k)
        whole = sizes[words.row[at]] == k
        found.append((seed[whole], at[whole]))
    seed = np.concatenate([s for s, _ in found]) if found else np.zeros(0, np.uint64)
    at = np.concatenate([a for _, a in found]) if found else np.zeros(0, np.int64)
    by = np.argsort(seed, kind="stable")
    seed, at = seed[by], at[by]
    row = words.row[at]
    return Index(seed, row, at - first[row], items["text_key"].to_numpy(), words.hash, first, lengths)


def _best(equal: np.ndarray, least: int) -> tuple[int, int, int] | None:
    """Equal words, length and start of the stretch with most equal words, then fewest words, of those long and equal enough."""
    place = np.flatnonzero(equal)
    if len(place) < least:
        return None
    # A stretch is equal enough where the score doesn't fall from its start to its end.
    share = round(100 * LEAST_SHARE)
    score = np.concatenate([[0], np.cumsum(np.where(equal, 100 - share, -share))])
    many = np.concatenate([[0], np.cumsum(equal)])
    # From each new low on, the last place where the score is as high again; other starts gain nothing.
    start = np.concatenate([[0], 1 + np.flatnonzero(score[1:] < np.minimum.accumulate(score)[:-1])])
    high = np.maximum.accumulate(score[::-1])[::-1]
    end = np.searchsorted(-high, -score[start], side="right") - 1
    same = int((many[end] - many[start]).max())
    if same < max(least, 1):
        return None
    size = place[same - 1 :] - place[: len(place) - same + 1] + 1
    k = int(np.argmin(size))
    return same, int(size[k]), int(place[k])


def _hits(index: Index, words: T.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of the rows and places of the index whose seeds agree, some at a time."""
    seeds = ((*found, False) for found in _seeds(words))
    runs = ((*_runs(words, k), True) for k in index.lengths)
    for seed, at, short in chain(seeds, runs) if len(index.seed) else ():
        left = np.minimum(np.searchsorted(index.seed, seed), len(index.seed) - 1)
        hit = np.flatnonzero(index.seed[left] == seed)
        if short:  # one copy in a row is as good as another
            in_row = T.mix(seed[hit] + words.row[at[hit]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            hit = hit[np.sort(np.unique(in_row, return_index=True)[1])]
        low = left[hit]
        many = np.searchsorted(index.seed, seed[hit], side="right") - low
        until = np.cumsum(many)
        for begin in range(0, int(until[-1]) if len(until) else 0, HITS_AT_ONCE):
            flat = np.arange(begin, min(begin + HITS_AT_ONCE, int(until[-1])))
            own = np.searchsorted(until, flat, side="right")
            yield at[hit[own]], low[own] + flat - (until[own] - many[own])


def _equal_words(index: Index, words: T.Words, mine: np.ndarray, theirs: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of alignments: the first one's number, whether each word is equal, the bounds of each one, and its equal words.

    `mine` and `theirs` are the first words of each alignment, `size` its words.
    """
    until = np.cumsum(size)
    first = 0
    while first < len(size):
        done = until[first] - size[first]
        last = max(first + 1, int(np.searchsorted(until, done + WORDS_AT_ONCE, side="right")))
        some = size[first:last]
        bounds = np.concatenate([[0], np.cumsum(some)])
        step = np.arange(bounds[-1]) - np.repeat(bounds[:-1], some)
        equal = words.hash[np.repeat(mine[first:last], some) + step] == index.word[np.repeat(theirs[first:last], some) + step]
        sums = np.concatenate([[0], np.cumsum(equal)])
        yield first, equal, bounds, sums[bounds[1:]] - sums[bounds[:-1]]
        first = last


def _passages(index: Index, column: pa.Array, any_item: bool = False) -> dict[tuple[int, int], tuple[int, int, int]]:
    """For each row and text with a passage in common: equal words, length, and place in the row.

    With `any_item` a row's first one found is enough.
    """
    words = T.words_of(*T.buffer_of(column), T.AT_MARK)
    begin = np.searchsorted(words.row, np.arange(len(column) + 1))
    sizes, lengths = np.diff(index.first), np.diff(begin)
    least = np.minimum(LEAST_WORDS, np.ceil(LEAST_SHARE * sizes).astype(np.int64))
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    done = np.zeros(len(column), bool)
    for at, k in _hits(index, words):
        row, item = words.row[at], index.item[k]
        shift = at - begin[row] - index.place[k]
        name = T.mix(row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + T.mix(item.astype(np.uint64) + T.mix(shift.astype(np.uint64))))
        once = np.unique(name, return_index=True)[1]
        once = once[~done[row[once]]]
        row, item, shift = row[once], item[once], shift[once]
        from_ = np.maximum(0, shift)
        size = np.minimum(lengths[row], shift + sizes[item]) - from_
        wide = size >= least[item]
        row, item, shift, from_, size = (x[wide] for x in (row, item, shift, from_, size))
        for first, equal, bounds, many in _equal_words(index, words, begin[row] + from_, index.first[item] + from_ - shift, size):
            for number in np.flatnonzero(many >= least[item[first : first + len(many)]]).tolist():
                of = first + number
                r, i = int(row[of]), int(item[of])
                if done[r]:
                    continue
                best = _best(equal[bounds[number] : bounds[number + 1]], int(least[i]))
                if best and best[:2] > found.get((r, i), (0, 0))[:2]:
                    found[r, i] = (best[0], best[1], best[2] + int(from_[of]))
                    done[r] = any_item
    return found


def _items(benchmark: DataFrame) -> DataFrame:
    """`item_id`, `text`, `text_key`; without null texts and repeats."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text IS NOT NULL")
    return items.dropDuplicates(["item_id", "text"]).withColumn("text_key", F.xxhash64("text"))


def _indexes(items: DataFrame) -> Iterator[Index]:
    """The index of the distinct texts, in blocks of about BLOCK_WORDS words at most."""
    distinct = items.select("text_key", "text").dropDuplicates(["text_key"])
    total = distinct.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + total // (4 * BLOCK_WORDS)
    for k in range(blocks):
        yield _index(distinct.filter(F.pmod("text_key", F.lit(blocks)) == k).orderBy("text_key").toArrow())


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document row and benchmark item that share a passage.

    Columns: `doc_id`, `item_id`, `n_equal` (equal words), `n_words` (length of
    the stretch), `first_word` (its place in the document, from 0). Words are
    runs of letters, digits and characters beyond ASCII, A-Z lower-cased. A
    passage has at least LEAST_WORDS equal words, or LEAST_SHARE of a shorter
    item's, and LEAST_SHARE of its words are equal; words are substituted, not
    added or left out, within it. Every passage of an item of SHORT words or more
    is found; shorter items are found by exact copies only, null and empty texts
    never; equal stretches of one item keep one of them. Repeated document rows
    are found each; repeated items count once, and each id of a text has its
    rows. Empty tables give no rows; other columns are ignored.
    """
    ship(docs.sparkSession)
    items = _items(benchmark)
    parts = []
    for index in _indexes(items):

        def find(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in (part for batch in batches for part in T.slices(batch)):
                ids, keys = batch.column("doc_id").to_pylist(), index.keys.tolist()
                rows = [(ids[row], keys[item], *best) for (row, item), best in _passages(index, batch.column("text")).items()]
                columns = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "text_key", "n_equal", "n_words", "first_word"])

        parts.append(texts(docs).mapInArrow(find, _HITS))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    named = found.join(items.select("item_id", "text_key"), "text_key")
    return named.select("doc_id", "item_id", "n_equal", "n_words", "first_word")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that share no passage with any item; all columns, null texts stay."""
    for index in _indexes(_items(benchmark)):

        def keep(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in (part for batch in batches for part in T.slices(batch)):
                clean = np.ones(batch.num_rows, bool)
                clean[[row for row, _ in _passages(index, batch.column("text"), any_item=True)]] = False
                yield batch.filter(pa.array(clean))

        docs = filtered(docs, keep)
    return docs
