"""Mixing sources to target weights, with weights that change during training.

Each source has a share of all words and a rate that changes linearly over
training time; the rate's integral over the whole time is the source's target.
A source's documents are strung together in hash order, and each pass over them
is an epoch. The place of a document's middle word in this string, put through
the inverse of the integral, is the time at which the document is trained on;
sorting all copies by time, by ranges, gives the training order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelio.llm.shared import written

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: How much a source's rate rises over the whole time, as a share of its mean: from 1 - r to 1 + r. Repeating.
RAMPS = (-0.5, 0.0, 0.5)
#: A target is at most so many times its source's size.
REPEAT_LIMIT = 3
#: Hash digits that split a source into even groups for its running sums.
GROUP_DIGITS = 3
#: Columns that the training order has beside those of the documents.
ADDED = ("mix_epoch", "mix_position")
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, ramps: Sequence[float] = RAMPS) -> DataFrame:
    """`key`, `source_size`, `target`, `ramp` from one row per source (`key`, `source`, `source_size`).

    The targets share the sum of all sizes by weight. No target exceeds
    REPEAT_LIMIT times its source's size; what is cut off is shared among the
    others by weight. In the order of cap over weight, the sources up to some
    place are cut, and one level times weight is the target of the rest.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    place = F.row_number().over(by_name) - 1

    def pick(values: Sequence[float], kind: str) -> Column:
        return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), (place % len(values) + 1).cast("int"))

    rows = sizes.select(
        "key",
        "source",
        "source_size",
        (F.col("source_size") * REPEAT_LIMIT).alias("cap"),
        pick(weights, "long").alias("weight"),
        pick(ramps, "double").alias("ramp"),
    )
    rows = rows.select(
        "*",
        F.sum("source_size").over(Window.partitionBy()).alias("total"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cut"),
        F.sum("weight").over(onward).alias("left"),
    )
    rows = rows.withColumn("level", (F.col("total") - F.col("cut")).cast("double") / F.col("left"))
    free = F.col("level") * F.col("weight") <= F.col("cap")
    # The level of the first source that is not cut holds for all after it.
    level = F.first(F.when(free, F.col("level")), ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    target = F.coalesce(level * F.col("weight"), F.col("cap").cast("double"))
    return rows.select("key", "source_size", target.alias("target"), "ramp")


def _copy(epoch: int) -> Column:
    """What one epoch takes of a document, all or nothing: `epoch`, `words`, `position`."""
    begin = F.col("from") + F.col("source_size") * epoch
    # Whole if its middle lies before the target's end, which leaves the source as near to its target as it can come.
    words = F.when(2 * begin + F.col("size") <= 2 * F.floor("target"), F.col("size")).otherwise(0).cast("long")
    wanted = F.try_divide(begin + words / F.lit(2.0), F.col("target"))
    # By time t the share (1 - r) t + r t * t of the words is trained on; this is its inverse.
    rest, ramp = 1 - F.col("ramp"), F.col("ramp")
    time = 2 * wanted / (rest + F.sqrt(rest * rest + 4 * ramp * wanted))
    return F.struct(F.lit(epoch).alias("epoch"), words.alias("words"), time.alias("position"))


def schedule(docs: DataFrame, weights: Sequence[int] = WEIGHTS, ramps: Sequence[float] = RAMPS) -> DataFrame:
    """One row per document: `doc_id`, `size`, `source_size`, `target`, `copies`, `row`.

    `size` is the number of words, runs of characters other than ASCII white
    space (null: 0). `copies` holds for each time that the mix takes the document
    its `epoch`, `words` and `position` in (0, 1]; the words of a source's copies
    add up to its target, rounded down. The copy at which the target ends has
    the document's first words only; a copy without words is left out. `row` is
    the whole input row. Sources are ordered by code point, null last, null being
    a source like the others. The order within a source is that of a hash of id
    and text, so reruns agree; equal rows are interchangeable. Sources without
    words have target 0. An empty table gives no rows.
    """
    text = F.col("text").cast("string")
    mark = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        # null is apart from every source, the empty one too
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("key"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit(":"), mark).cast("binary")).alias("name"),
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"),
    ).withColumn("part", F.substring("name", 1, GROUP_DIGITS))
    parts = written(rows.groupBy("key", "part").agg(F.min("source").alias("source"), F.sum("size").alias("words")), "mix-parts")
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy("key").agg(F.min("source").alias("source"), F.sum("words").alias("source_size"))
    plan = targets(sizes, weights, ramps)
    ahead = parts.select("key", "part", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("ahead"))
    rows = rows.drop("source").join(ahead.join(plan, "key"), ["key", "part"])
    within = Window.partitionBy("key", "part").orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("from", F.col("ahead") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    copies = F.filter(F.array(*[_copy(k) for k in range(REPEAT_LIMIT)]), lambda c: c["words"] > 0)
    return rows.select("doc_id", "size", "source_size", "target", copies.alias("copies"), "row")


def taken(docs: DataFrame) -> DataFrame:
    """One row per document: `doc_id`, `size`, `source_size`, `target`, `taken`, `first_position`."""
    plan = schedule(docs)
    words = F.aggregate(F.col("copies"), F.lit(0).cast("long"), lambda n, c: n + c["words"])
    return plan.select(
        "doc_id", "size", "source_size", "target", words.alias("taken"), F.round(F.array_min("copies.position"), 6).alias("first_position")
    )


def training_order(docs: DataFrame) -> DataFrame:
    """A row for each copy, sorted by position: the columns of `docs`, `mix_epoch`, `mix_position`.

    Texts are whole and unchanged. Documents that the mix doesn't take, those
    without words among them, are not in it. Columns of `docs` named like the two new ones are
    replaced.
    """
    copies = schedule(docs).select("row", F.explode("copies").alias("copy"))
    columns = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() not in ADDED]
    out = copies.select(*columns, F.col("copy.epoch").alias("mix_epoch"), F.col("copy.position").alias("mix_position"))
    return out.orderBy("mix_position", "doc_id", "mix_epoch")
