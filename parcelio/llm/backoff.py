"""Stupid-backoff scores from n-gram counts of the corpus itself.

Documents are dealt to groups. A group's distinct n-grams of all orders are sent,
sorted and packed, to the owners of their hash ranges; an owner adds up the
counts of all groups, drops rare n-grams, and answers each group in its own
order. The answers are joined to the group's documents, whose n-grams they
score. So an n-gram costs a group a few bytes, however frequent it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelio.llm import tokens as T
from parcelio.llm.shared import texts

ORDER = 3
#: Factor for each step to a shorter context.
BACKOFF = 0.4
#: N-grams of more than one word with fewer occurrences count as unknown; 1 cuts none off.
CUTOFF = 1
#: Bytes of text that a group, and an owner of a hash range, handles.
GROUP_BYTES = 12 << 20
OWNER_BYTES = 8 << 20


def _grams(column: pa.Array, order: int) -> tuple[T.Words, list[tuple[np.ndarray, np.ndarray]]]:
    """The words, and for each order the tokens and their first word's index. The lowest bit is 0 for single words."""
    words = T.words_of(*T.buffer_of(column))
    found = []
    for k in range(1, order + 1):
        token, at = T.joined(words, k)
        found.append(((token & ~np.uint64(1)) | np.uint64(k > 1), at))
    return words, found


def _planes(x: np.ndarray) -> bytes:
    """Ascending 64-bit values as differences, byte plane after byte plane, so that zeros lie together."""
    steps = np.diff(x, prepend=np.uint64(0))
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T), 1)


def _from_planes(data: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(steps, dtype=np.uint64)


def _small(x: np.ndarray) -> bytes:
    """Counts in a byte each; those from 255 on follow in full."""
    return zstandard.compress(np.minimum(x, 255).astype(np.uint8).tobytes() + x[x >= 255].astype(np.int64).tobytes(), 1)


def _from_small(data: bytes, n: int) -> np.ndarray:
    data = zstandard.decompress(data)
    found = np.frombuffer(data, np.uint8, n).astype(np.int64)
    found[found == 255] = np.frombuffer(data, np.int64, offset=n)
    return found


def _order(token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending order, first places of the distinct values in it, and each place's value's number."""
    by = np.argsort(token)
    ordered = token[by]
    new = np.ones(len(token), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return by, np.flatnonzero(new), np.cumsum(new) - 1


def _sent(order: int, owners: int):
    """A group's distinct n-grams, cut by hash range."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        _, found = _grams(table["text"], order)
        token, many = np.unique(np.concatenate([t for t, _ in found]), return_counts=True)
        cuts = np.searchsorted(token >> np.uint64(32), (np.arange(owners + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(owners))
        cuts[-1] = len(token)
        parts = [(k, a, b) for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if b > a]
        return pa.table({
            "owner": pa.array([k for k, _, _ in parts], pa.int32()),
            "part": pa.array([key[0].as_py()] * len(parts), pa.int32()),
            "tokens": pa.array([_planes(token[a:b]) for _, a, b in parts], pa.binary()),
            "counts": pa.array([_small(many[a:b]) for _, a, b in parts], pa.binary()),
        })

    return run


def _answered(cutoff: int):
    """The corpus counts of every group's n-grams; 0 for a rare one of more than one word."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        tokens = [_from_planes(x.as_py()) for x in table["tokens"]]
        sizes = np.cumsum([0] + [len(t) for t in tokens])
        token = np.concatenate(tokens)
        del tokens
        many = np.concatenate([_from_small(x.as_py(), n) for x, n in zip(table["counts"], np.diff(sizes).tolist())])
        by, first, number = _order(token)
        total = np.add.reduceat(many[by], first)
        total[(total < cutoff) & (token[by[first]] & np.uint64(1) == 1)] = 0
        back = np.empty(len(by), np.int64)
        back[by] = total[number]
        return pa.table({
            "part": table["part"],
            "owner": pa.array([key[0].as_py()] * table.num_rows, pa.int32()),
            "n": pa.array(np.diff(sizes).astype(np.int64)),
            "counts": pa.array([_small(back[a:b]) for a, b in zip(sizes[:-1], sizes[1:])], pa.binary()),
        })

    return run


def _scored(order: int, backoff: float, words_in_all: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        words, found = _grams(left["text"], order)
        rows = left.num_rows
        size = np.bincount(words.row, minlength=rows)
        by, _, number = _order(np.concatenate([t for t, _ in found]))
        answers = right.sort_by("owner")
        count = [_from_small(x.as_py(), m) for x, m in zip(answers["counts"], answers["n"].to_pylist())]
        all_counts = np.empty(len(by), np.int64)
        all_counts[by] = np.concatenate(count)[number] if len(by) else 0
        n = len(words.hash)
        # Of the n-gram that begins at a word: its count, 0 where there is none.
        counts, done = [], 0
        for _, at in found:
            here = np.zeros(n, np.int64)
            here[at] = all_counts[done : done + len(at)]
            done += len(at)
            counts.append(here)
        place = np.arange(n) - np.concatenate([[0], np.cumsum(size)])[words.row]
        score = np.log10(np.maximum(counts[0], 1) / max(words_in_all, 1)) + np.log10(backoff) * np.minimum(place, order - 1)
        for k in range(2, order + 1):
            # An n-gram of k words that ends at word i begins at i - k + 1.
            end = np.flatnonzero(place >= k - 1)
            have = counts[k - 1][end - k + 1]
            end, have = end[have > 0], have[have > 0]
            context = counts[k - 2][end - k + 1]
            steps = np.minimum(place[end], order - 1) - (k - 1)
            score[end] = np.log10(have / context) + np.log10(backoff) * steps
        total = np.bincount(words.row, weights=score, minlength=rows)
        return pa.table({"doc_id": left["doc_id"], "n_words": pa.array(size.astype(np.int64)), "log10_score": pa.array(total)})

    return run


def score_documents(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, cutoff: int = CUTOFF) -> DataFrame:
    """One row per document: `doc_id`, `n_words`, `log10_score`, `log10_mean`.

    Counts cover the whole table, repeated rows included. The score of a word is
    the count of the longest known n-gram that ends with it over the count of
    its context, times `backoff` for each word by which the context is shorter
    than it could be; known are n-grams that occur `cutoff` times or more, and
    all single words (count over number of words). `log10_score` adds up the
    logarithms, `log10_mean` divides by the number of words. Words are runs of
    characters other than ASCII white space, A-Z lower-cased. Null and empty
    texts have 0 words, score 0 and mean null. An empty table gives no rows;
    other columns are ignored.
    """
    rows = texts(docs).withColumn("text", F.coalesce("text", F.lit("")))
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    size, all_words = rows.agg(F.sum(F.octet_length("text")), F.sum(words)).first()
    groups, owners = (max(1, -(-(size or 0) // n)) for n in (GROUP_BYTES, OWNER_BYTES))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int"))
    sent = rows.groupBy("part").applyInArrow(_sent(order, owners), "owner int, part int, tokens binary, counts binary")
    answers = sent.groupBy("owner").applyInArrow(_answered(cutoff), "part int, owner int, n long, counts binary")
    scored = rows.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(
        _scored(order, backoff, all_words or 0), "doc_id long, n_words long, log10_score double"
    )
    return scored.withColumn("log10_mean", F.when(F.col("n_words") > 0, F.col("log10_score") / F.col("n_words")))
