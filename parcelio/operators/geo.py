"""Values by municipality or state joined to map regions, and hierarchies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelio.functions.nulls import left_join_null_safe
from parcelio.functions.numbers import cube
from parcelio.functions.text import dashed

# Limits of the colour scale of the value maps.
SCALE_LOW = 3300.0
SCALE_HIGH = 3750.0


def join_codes(values: DataFrame, codes: DataFrame) -> DataFrame:
    """Attach the municipality code by name.

    Names are not unique across states; `lifecycle.duplicate_keys` lists the
    names that would multiply rows.
    """
    named = codes.select("Nome_Municipio", "Codigo_IBGE")
    return left_join_null_safe(values, named, {"municipio": "Nome_Municipio"})


def filter_regions(polygons: DataFrame, regions: Sequence[int]) -> DataFrame:
    return polygons.filter(F.col("Region").isin(*regions))


def choropleth(
    regions: DataFrame, values: DataFrame, on: dict[str, str], measures: Sequence[str]
) -> DataFrame:
    """Every region with its value of each measure; without data the value is null.

    The measures become rows of their own after the join, so several maps need
    one join.
    """
    joined = left_join_null_safe(
        regions, values.select(*on.values(), *measures), on
    )
    kept = [F.col(c) for c in regions.columns]
    return joined.unpivot(kept, [F.col(m) for m in measures], "measure", "value")


def polygon_vertices(regions: DataFrame, geometry: str = "geometry") -> DataFrame:
    """One row per vertex, numbered from 1 along the outline."""
    others = [c for c in regions.columns if c != geometry]
    return regions.select(*others, F.posexplode(geometry).alias("__at", "__point")).select(
        *others,
        (F.col("__at") + 1).cast("bigint").alias("order"),
        F.col("__point.long").alias("long"),
        F.col("__point.lat").alias("lat"),
    )


def category_sizes(items: DataFrame, level1: str, level2: str) -> DataFrame:
    """Cubed number of items per category and subcategory."""
    return items.groupBy(
        dashed(F.col(level1)).alias("category"), dashed(F.col(level2)).alias("subcategory")
    ).agg(cube(F.count(F.lit(1))).alias("sales"))


def category_hierarchy(sizes: DataFrame, total: Column | None = None) -> DataFrame:
    """Totals per subcategory, per category and over all, with their level."""
    measure = F.col("sales") if total is None else total
    return sizes.rollup("category", "subcategory").agg(
        F.grouping_id().cast("bigint").alias("level"), F.sum(measure).alias("sales")
    )
