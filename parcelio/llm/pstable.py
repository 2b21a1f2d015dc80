"""Near-duplicate vectors by p-stable hashing for the Euclidean distance.

Normalised vectors are projected on random normal directions; a projection plus
a random shift, divided by a width and rounded down, is one hash. Several
hashes together name a bucket, and several tables have buckets of their own.
Vectors that share a bucket are compared exactly, in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelio.llm.components import components
from parcelio.llm.shared import ship, written
from parcelio.llm.tokens import mix

THRESHOLD = 0.9
#: Of pairs exactly at the threshold, the expected share that meets in a table.
RECALL = 0.95
#: Width of a hash, in units of the distance at the threshold.
WIDTH = 4.0


def _same_hash(width: float, distance: float) -> float:
    """Chance that two points at this distance get the same hash."""
    r = width / distance
    inside = math.erf(r / math.sqrt(2))
    return inside - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[float, int, int]:
    """Width, hashes in a table, and tables for n vectors.

    So many hashes that an unrelated vector shares a bucket with about one
    other; so many tables that the recall at the threshold is reached.
    """
    near = math.sqrt(2 - 2 * threshold)
    width = WIDTH * near
    hashes = max(2, math.ceil(math.log(max(n, 4) / 2) / -math.log(_same_hash(width, math.sqrt(2)))))
    meet = _same_hash(width, near) ** hashes
    return width, hashes, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All components, with NaN for null ones, and the offsets of the rows; null rows are empty."""
    if column.null_count:
        column = column.fill_null(pa.scalar([], column.type))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector's id, key and unit vector; both null where it links with nothing."""
    for batch in batches:
        flat, first = _values(batch.column("embedding"))
        keys, units = [], []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            part = flat[a:b]
            top = np.abs(part).max() if b > a else 0.0
            if not top > 0 or not np.isfinite(part).all():
                keys.append(None)
                units.append(None)
                continue
            unit = part / top  # no overflow in the norm
            unit = unit / np.sqrt((unit * unit).sum()) + 0.0
            bits = mix(unit.view(np.uint64) + mix(np.arange(len(unit), dtype=np.uint64)))
            keys.append(int(mix(np.array([bits.sum(dtype=np.uint64) + np.uint64(len(unit))], np.uint64)).view(np.int64)[0]))
            units.append(unit)
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array(keys, pa.int64()), pa.array(units, pa.list_(pa.float64()))],
            ["vec_id", "key", "unit"],
        )


def _buckets(width: float, hashes: int, tables: int, seed: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            flat, first = _values(batch.column("unit"))
            sizes = np.diff(first)
            keys = batch.column("key").to_numpy()
            for size in np.unique(sizes).tolist():
                if size not in drawn:
                    rng = np.random.default_rng([seed, size])
                    drawn[size] = rng.standard_normal((size, hashes * tables)), rng.uniform(0, width, hashes * tables)
                ray, shift = drawn[size]
                rows = np.flatnonzero(sizes == size)
                for part in np.array_split(rows, len(rows) // 1024 + 1):
                    x = flat[first[part][:, None] + np.arange(size)]
                    cell = np.floor((x @ ray + shift) / width).astype(np.int64).view(np.uint64).reshape(len(part), tables, hashes)
                    weight = mix(np.arange(hashes, dtype=np.uint64) + np.uint64(size << 8)) | np.uint64(1)
                    name = mix((mix(cell) * weight).sum(axis=2, dtype=np.uint64) + mix(np.arange(tables, dtype=np.uint64) + np.uint64(7)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(name.view(np.int64).ravel()), pa.array(np.repeat(keys[part], tables))], ["bucket", "key"]
                    )

    return emit


def _close(threshold: float):
    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = _values(batch.column("ua"))
            y, other = _values(batch.column("ub"))
            sizes = np.diff(at)
            keep = sizes == np.diff(other)
            cosine = np.zeros(len(sizes))
            for size in np.unique(sizes[keep]).tolist():
                rows = np.flatnonzero(keep & (sizes == size))
                for part in np.array_split(rows, len(rows) // 1024 + 1):
                    cells = np.arange(size)
                    cosine[part] = (x[at[part][:, None] + cells] * y[other[part][:, None] + cells]).sum(axis=1)
            yield batch.select(["a", "b"]).filter(pa.array(keep & (cosine >= threshold)))

    return test


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, seed: int = 17) -> DataFrame:
    """One row per vector: `vec_id`, `n_links`, `component_id`, `kept`.

    Pairs whose cosine is at least `threshold` link if they share a bucket; no
    other pair links. Null, zero and empty vectors and those with null or
    non-finite components link with nothing; nor do vectors of different
    lengths. Vectors of equal direction (to the bit) are one class and link with
    each other. `component_id` is the smallest id reachable; a null id is
    ignored for it. An empty table gives no rows; other columns are ignored.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = written(rows.mapInArrow(_keyed, "vec_id long, key long, unit array<double>"), "units")
    of_rows = rows.select("vec_id", "key")
    classes = written(
        of_rows.filter("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vector-classes"
    )
    width, hashes, tables = plan(classes.count(), threshold, recall)
    distinct = rows.filter("key IS NOT NULL").join(classes, "key").filter(F.col("vec_id").eqNullSafe(F.col("rep")))
    units = written(distinct.select("key", "unit").dropDuplicates(["key"]), "unit-vectors")

    hashed = units.mapInArrow(_buckets(width, hashes, tables, seed), "bucket long, key long")
    several = hashed.groupBy("bucket").count().filter("count > 1").select("bucket")
    hashed = written(hashed.join(several, "bucket"), "buckets")
    pairs = (
        hashed.withColumnRenamed("key", "a")
        .join(hashed.withColumnRenamed("key", "b"), "bucket")
        .filter("a < b")
        .select("a", "b")
        .distinct()
    )
    one = units.select(F.col("key").alias("a"), F.col("unit").alias("ua"))
    two = units.select(F.col("key").alias("b"), F.col("unit").alias("ub"))
    compared = pairs.join(one, "a").join(two, "b").select("a", "b", "ua", "ub")
    links = written(compared.mapInArrow(_close(threshold), "a long, b long"), "vector-links")

    ends = links.select(F.col("a").alias("key"), F.col("b").alias("other")).unionAll(links.select("b", "a"))
    others = classes.select(F.col("key").alias("other"), "copies")
    degree = ends.join(others, "other").groupBy("key").agg(F.sum("copies").alias("linked"))
    labels = components(links).withColumnRenamed("node", "key")
    named = classes.join(labels, "key", "left").join(degree, "key", "left")
    named = named.select("key", "rep", F.coalesce("label", "key").alias("label"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    final = named.join(least, "label").select("key", "n_links", "component_id")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return of_rows.join(final, "key", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
