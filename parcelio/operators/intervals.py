"""Lookup of points in periods: which period is in force at a date or number.

Overlapping periods are first turned into disjoint segments by a sweep in the
order of their starts. A point's segment is then the last one that starts
before it: found by bisection of a sorted array while the segments are few, or
by a second sweep over points and segment starts when they are many. Neither
unfolds a period, so open ends and long periods cost as much as short ones.
Both sweeps run over ranges of the order that Spark cuts evenly, with what each
range hands on to the next; a key with very many rows is spread over ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelio.session import shared_folder

#: Segments that every task may hold as sorted arrays.
FEW_SEGMENTS = 100_000
#: Halvings that find a place among so many segments.
_HALVINGS = 17
_LEAST_RANGES = 32
_LIMITS = {"date": ("0001-01-01", "9999-12-31"), "bigint": (-(1 << 62), 1 << 62)}


def _kind(df: DataFrame, column: str) -> str:
    return "date" if isinstance(df.schema[column].dataType, T.DateType) else "bigint"


def _after(point: Column, kind: str) -> Column:
    return F.date_add(point, 1) if kind == "date" else point + 1


def _in_ranges(df: DataFrame, *order: str) -> DataFrame:
    """The rows with the number of the range they fall in; checkpointed, since the bounds are drawn by sample."""
    spark = df.sparkSession
    shared_folder(spark)
    ranges = max(_LEAST_RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartitionByRange(ranges, *order)
    return dealt.withColumn("__range", F.spark_partition_id()).checkpoint()


def _handed_on(dealt: DataFrame, by: Sequence[str], own: Column, onward: Column) -> DataFrame:
    """For each key and range, what the ranges before have of the key: `onward` over their `own`."""
    rows = dealt.groupBy(*by, "__range").agg(own.alias("__own"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(*by, "__range", onward.over(before).alias("__before"))


def disjoint(
    periods: DataFrame, start: str, end: str, values: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Segments without overlap: `by`, `seg_from`, `seg_to`, `seg` (a struct of `values`).

    Where periods of a key overlap, the one that starts first holds, then the
    one whose values come first. A null start or end is open; a period that ends
    before it starts is ignored, as is one with a null key. Both ends count.

    In the order of starts, all periods before have begun, so together they
    cover everything up to their latest end: a period keeps what lies after it.
    """
    kind = _kind(periods, start)
    low, high = (F.lit(v).cast(kind) for v in _LIMITS[kind])
    rows = periods.select(
        *by,
        F.coalesce(F.col(start).cast(kind), low).alias("seg_from"),
        F.coalesce(F.col(end).cast(kind), high).alias("seg_to"),
        F.struct(*values).alias("seg"),
    ).filter("seg_from <= seg_to")
    if by:
        rows = rows.na.drop(subset=list(by))
    dealt = _in_ranges(rows, *by, "seg_from", "seg")
    handed = _handed_on(dealt, by, F.max("seg_to"), F.max("__own"))
    inside = (
        Window.partitionBy(*by, "__range")
        .orderBy("seg_from", "seg")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    covered = F.greatest(F.max("seg_to").over(inside), F.col("__before"))
    begin = F.greatest(F.col("seg_from"), _after(covered, kind))
    cut = dealt.join(handed, [*by, "__range"]).select(
        *by, begin.alias("seg_from"), "seg_to", "seg"
    )
    return cut.filter("seg_from <= seg_to")


def lookup(
    points: DataFrame,
    point: str,
    periods: DataFrame,
    start: str,
    end: str,
    values: Sequence[str],
    by: Sequence[str] = (),
    few: int = FEW_SEGMENTS,
) -> DataFrame:
    """The points with the `values` of the period in force at each; null if there is none.

    `by` names columns of both tables that must be equal. Every row is kept,
    also with a null point or key. Columns of `points` must not be named like `values`.
    """
    segments = disjoint(periods, start, end, values, by).checkpoint()
    if segments.limit(few + 1).count() <= min(few, FEW_SEGMENTS):
        found = _by_bisection(points, point, segments, by)
    else:
        found = _by_sweep(points, point, segments, by)
    return found.select(*points.columns, *[F.col(f"__found.{v}").alias(v) for v in values])


def _by_bisection(points: DataFrame, point: str, segments: DataFrame, by: Sequence[str]) -> DataFrame:
    kind = _kind(points, point)
    listed = F.array_sort(F.collect_list(F.struct("seg_from", "seg_to", "seg")))
    if by:
        arrays = segments.groupBy(*by).agg(listed.alias("__all"))
        held = points.join(F.broadcast(arrays), list(by), "left")
    else:
        held = points.withColumn("__all", segments.agg(listed.alias("a")).scalar())
    at = F.col(point).cast(kind)

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        begun = F.get(F.col("__all"), middle)["seg_from"] <= at
        open_ = s["low"] < s["high"]
        return F.struct(
            F.when(open_ & begun, middle + 1).otherwise(s["low"]).alias("low"),
            F.when(open_ & ~begun, middle).otherwise(s["high"]).alias("high"),
        )

    ends = F.struct(F.lit(0).alias("low"), F.size("__all").alias("high"))
    place = F.aggregate(F.sequence(F.lit(1), F.lit(_HALVINGS)), ends, halve)["low"]
    last = F.get(F.col("__all"), place - 1)
    found = held.withColumn("__last", F.when(F.col("__all").isNotNull() & at.isNotNull(), last))
    return found.withColumn("__found", F.when(at <= F.col("__last.seg_to"), F.col("__last.seg")))


def _by_sweep(points: DataFrame, point: str, segments: DataFrame, by: Sequence[str]) -> DataFrame:
    kind = _kind(points, point)
    keyed = points.withColumn("__at", F.col(point).cast(kind))
    last = F.struct("seg_to", "seg")
    starts = segments.select(*by, F.col("seg_from").alias("__at"), last.alias("__seg"))
    wanted = keyed.select(*by, "__at").na.drop().distinct()
    both = starts.unionByName(wanted.withColumn("__seg", F.lit(None).cast(starts.schema["__seg"].dataType)))
    # At one place the segment that starts there comes first.
    both = both.withColumn("__is_point", F.col("__seg").isNull())
    dealt = _in_ranges(both, *by, "__at", "__is_point")
    own = F.max_by("__seg", F.when(~F.col("__is_point"), F.col("__at")))
    handed = _handed_on(dealt, by, own, F.last("__own", ignorenulls=True))
    inside = (
        Window.partitionBy(*by, "__range")
        .orderBy("__at", "__is_point")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    swept = dealt.join(handed, [*by, "__range"]).select(
        *by,
        "__at",
        "__is_point",
        F.coalesce(F.last("__seg", ignorenulls=True).over(inside), F.col("__before")).alias("__last"),
    )
    hits = swept.filter("__is_point AND __at <= __last.seg_to").select(
        *by, "__at", F.col("__last.seg").alias("__found")
    )
    return keyed.join(hits, [*by, "__at"], "left")
