"""Cost surfaces: components of a grid joined under named weight presets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import is_finite

COMPONENTS = ["length", "terrain", "protected_land", "native_vegetation", "hydrography", "roads", "railways"]
#: Weights by component in the order above (fixed values).
PRESETS = {
    "shortest": [0.85, 0.05, 0.02, 0.02, 0.03, 0.015, 0.015],
    "balanced": [0.45, 0.15, 0.12, 0.12, 0.08, 0.04, 0.04],
    "environmental": [0.25, 0.10, 0.25, 0.25, 0.10, 0.025, 0.025],
}


def preset_table(spark: SparkSession, presets: dict[str, list[float]] = PRESETS) -> DataFrame:
    """preset and one weight column w_<component> each: a row for each preset."""
    return spark.createDataFrame([(p, *w) for p, w in presets.items()], "preset string, " + ", ".join(f"w_{c} double" for c in COMPONENTS))


def weight_violations(weights: DataFrame, expected: DataFrame) -> DataFrame:
    """preset, component, problem for weights(preset, component, weight) against expected(component).

    Every preset needs just the expected components, finite weights of at least 0, and a positive sum."""
    wanted = weights.select("preset").distinct().crossJoin(F.broadcast(expected.select("component").distinct()))  # presets x components, both short
    both = weights.join(wanted.withColumn("wanted", F.lit(True)), ["preset", "component"], "full_outer")
    bad = F.when(F.col("wanted").isNull(), "unexpected").when(F.col("weight").isNull(), "missing").when(~is_finite(F.col("weight")), "not finite").when(F.col("weight") < 0, "negative")
    rows = both.select("preset", "component", bad.alias("problem")).filter("problem is not null")
    sums = weights.groupBy("preset").agg(F.sum("weight").alias("s")).filter("not s > 0").select("preset", F.lit(None).cast("string").alias("component"), F.lit("no weight").alias("problem"))
    return rows.unionByName(sums)


def shape_violations(layers: DataFrame) -> DataFrame:
    """component, cells, rows, cols of layers(component, row, col) that are not full rectangles, or not as most are."""
    shape = layers.groupBy("component").agg(F.count("*").alias("cells"), (F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"), F.countDistinct("row", "col").alias("places"))
    usual = shape.groupBy("rows", "cols").count().orderBy(F.desc("count"), "rows", "cols").limit(1).select(F.col("rows").alias("usual_rows"), F.col("cols").alias("usual_cols"))
    off = (F.col("cells") != F.col("rows") * F.col("cols")) | (F.col("places") != F.col("cells")) | (F.col("rows") != F.col("usual_rows")) | (F.col("cols") != F.col("usual_cols"))
    return shape.crossJoin(F.broadcast(usual)).filter(off).select("component", "cells", "rows", "cols")


def wide(layers: DataFrame, components: list[str] = COMPONENTS) -> DataFrame:
    """layers(component, row, col, value) with one column for each component; one shuffle on the cell."""
    return layers.groupBy("row", "col").pivot("component", components).agg(F.first("value"))


def blocked(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (~is_finite(F.col(c)) for c in columns))


def combine(cells: DataFrame, presets: DataFrame, excluded: DataFrame | None = None, components: list[str] = COMPONENTS) -> DataFrame:
    """preset, row, col, cost of cells(row, col, <components>): the weighted sum in the order of the components.

    Excluded cells and cells with a component that is not finite cost infinity."""
    if excluded is not None:
        marks = excluded.select("row", "col").distinct().withColumn("excluded", F.lit(True))
        cells = cells.join(marks, ["row", "col"], "left")
    else:
        cells = cells.withColumn("excluded", F.lit(None).cast("boolean"))
    total = reduce(lambda a, b: a + b, (F.col(c) * F.col(f"w_{c}") for c in components))
    cost = F.when(F.col("excluded").isNotNull() | blocked(components), F.lit(float("inf"))).otherwise(total)
    return cells.crossJoin(F.broadcast(presets)).select("preset", "row", "col", cost.alias("cost"))  # a few presets
