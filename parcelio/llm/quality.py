"""Quality scores by nearest-neighbour voting among latent-semantic vectors.

A text becomes weighted counts of hashed three-byte runs, with a few shares of
its form (words that repeat the one before, marks, capitals), is projected on
the leading directions of a labelled sample (latent semantic analysis), and is
compared with every labelled vector; the labels of the nearest ones vote with
their cosine as weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelio.llm import tokens as T
from parcelio.llm.language import in_training
from parcelio.llm.shared import ship, texts

#: Labelled rows that the classifier is fitted on, at most.
LABELLED_ROWS = 4096
#: Hashed features, latent directions, neighbours that vote, documents in a block.
FEATURES = 1024
DIRECTIONS = 64
NEIGHBOURS = 15
BLOCK = 256
#: Shares of form beside the features, and their weight against the unit vector of the features.
FORM = 3
FORM_WEIGHT = 1.5
_BLOCK_BYTES = 1 << 21


def _weighted(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return np.hstack([_unit(x[:, :FEATURES] * weight), x[:, FEATURES:] * FORM_WEIGHT])


class Model(NamedTuple):
    """Feature weights, directions, and the labelled vectors with their labels."""

    weight: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray


def _counts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """First row, and log counts with the shares of form, of block after block of rows; a long row is read in pieces."""
    rows, first = len(offsets) - 1, 0
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + _BLOCK_BYTES, side="right")) - 1
        last = min(max(last, first + 1), first + BLOCK, rows)
        found = np.zeros((last - first) * FEATURES)
        for a in range(int(offsets[first]), int(offsets[last]) - 2, _BLOCK_BYTES):
            part = data[a : min(a + _BLOCK_BYTES + 2, int(offsets[last]))].astype(np.uint32)
            code = part[:-2] * np.uint32(65536) + part[1:-1] * np.uint32(256) + part[2:]
            code = (code * np.uint32(2654435761)) >> np.uint32(22)
            at = a + np.arange(len(code))
            row = np.searchsorted(offsets, at, side="right") - 1
            inside = at + 2 < offsets[row + 1]
            cell = (row[inside] - first) * FEATURES + code[inside]
            found += np.bincount(cell, minlength=len(found))
        form = _form(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        yield first, np.hstack([np.log1p(found.reshape(last - first, FEATURES)), form])
        first = last


def _form(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Shares of words that equal the one before, of marks, and of capitals, for each row."""
    rows = len(offsets) - 1
    words = T.words_of(data, offsets)
    many = np.maximum(np.bincount(words.row, minlength=rows), 1)
    again = (words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1])
    row = np.repeat(np.arange(rows), np.diff(offsets))
    mark = T.AT_MARK[data] & ~T.AT_SPACE[data]
    capital = (data >= 65) & (data <= 90)
    share = [
        np.bincount(words.row[1:][again], minlength=rows) / many,
        np.bincount(row[mark], minlength=rows) / (4 * many),
        np.bincount(row[capital], minlength=rows) / np.maximum(np.diff(offsets), 1),
    ]
    return np.minimum(np.stack(share, axis=1), 1.0)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, found in _counts(*T.buffer_of(batch.column("text"))):
            rows = [x.astype(np.float32).tobytes() for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(first, len(rows)), batch.column("label").slice(first, len(rows)), pa.array(rows, pa.binary())],
                ["doc_id", "label", "counts"],
            )


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model of a bounded sample of labelled training rows; None without any.

    The sample are the LABELLED_ROWS ids with the smallest hash among those that
    may be learned from and have a label; ids labelled more than once count with
    the mean of their labels. Only the sample's counts reach the driver.
    """
    ship(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("double").alias("label"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & in_training(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.avg("label").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_ROWS)
    rows = texts(docs).join(F.broadcast(known), "doc_id").select("doc_id", "label", "text")
    sample = rows.mapInArrow(_features, "doc_id long, label double, counts binary").dropDuplicates(["doc_id"])
    table = sample.orderBy("doc_id").toArrow()
    if not table.num_rows:
        return None
    x = np.frombuffer(b"".join(table["counts"].to_pylist()), np.float32).reshape(table.num_rows, FEATURES + FORM).astype(np.float64)
    weight = np.log((1 + len(x)) / (1 + (x[:, :FEATURES] > 0).sum(axis=0))) + 1
    x = _weighted(x, weight)
    _, directions = np.linalg.eigh(x.T @ x)
    directions = directions[:, ::-1][:, :DIRECTIONS]
    return Model(weight, directions, _unit(x @ directions).astype(np.float32), table["label"].to_numpy())


def _score(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, found in _counts(*T.buffer_of(batch.column("text"))):
                score = np.full(len(found), 0.5)
                if model is not None:
                    mine = _unit(_weighted(found, model.weight) @ model.directions).astype(np.float32)
                    cosine = np.round(mine @ model.vectors.T, 5)
                    k = min(NEIGHBOURS, cosine.shape[1])
                    least = np.partition(cosine, -k, axis=1)[:, -k]
                    vote = np.where((cosine >= least[:, None]) & (cosine > 0), cosine, 0).astype(np.float64)
                    total = vote.sum(axis=1)
                    mean = float(model.labels.mean())
                    score = np.where(total > 0, (vote @ model.labels) / np.where(total > 0, total, 1), mean)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(found)), pa.array(np.clip(score, 0, 1))], ["doc_id", "score"]
                )

    return run


def score_quality(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: `doc_id`, `held_out`, `score`, `predicted`.

    The labels of the NEIGHBOURS nearest labelled vectors, and of all that tie
    with the last of them, vote with their cosine. Texts without a three-byte
    run (null and empty ones too) and those with no positive cosine get the mean
    label; without any labelled row the score is 0.5. Labels outside 0 to 1 are
    not expected; the score is kept within. Null labels and ids are not learned
    from. An empty table gives no rows; other columns are ignored.
    """
    model = fit(docs, labels) if model is None else model
    ship(docs.sparkSession)
    scored = texts(docs).mapInArrow(_score(model), "doc_id long, score double")
    return scored.select(
        "doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
