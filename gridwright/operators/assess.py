"""Measures of routes: length, exposure, slope, direction, classes, comparison with a baseline."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def in_order():
    """A route's cells in their order."""
    return Window.partitionBy("preset").orderBy("step")


def along(route: DataFrame, cells: DataFrame) -> DataFrame:
    """The cells' columns for every step of route(preset, step, row, col)."""
    return route.join(cells, ["row", "col"])


def component_sums(route: DataFrame, layers: DataFrame) -> DataFrame:
    """preset, component, total, hits of layers(component, row, col, value); hits are cells above 0."""
    return along(route, layers).groupBy("preset", "component").agg(F.sum("value").alias("total"), F.count_if(F.col("value") > 0).alias("hits"))


def component_counts(route: DataFrame, layers: DataFrame) -> DataFrame:
    """Components, `length` aside, that a route meets, with the cells where it does."""
    return component_sums(route, layers).filter("component <> 'length' and hits > 0").select("preset", "component", "hits")


def weighted_exposure(sums: DataFrame, weights: DataFrame) -> DataFrame:
    """preset, component, exposure: sums x weights(preset, component, weight)."""
    return sums.join(weights, ["preset", "component"]).select("preset", "component", (F.col("total") * F.col("weight")).alias("exposure"))


def slope_stats(route: DataFrame, cells: DataFrame) -> DataFrame:
    """Mean and largest terrain and slope; without a slope grid, slope is terrain x 20."""
    slope = F.col("slope") if "slope" in cells.columns else F.col("terrain") * 20
    x = along(route, cells)
    return x.groupBy("preset").agg(F.avg("terrain").alias("mean_terrain"), F.max("terrain").alias("max_terrain"), F.avg(slope).alias("mean_slope"), F.max(slope).alias("max_slope"))


def steps(route: DataFrame) -> DataFrame:
    """route with dr, dc from the cell before (null on the first)."""
    return route.withColumns({"dr": F.col("row") - F.lag("row").over(in_order()), "dc": F.col("col") - F.lag("col").over(in_order())})


def route_length(route: DataFrame, cell_size: float = 100.0) -> DataFrame:
    """preset, length_m, steps, bad_steps: a step to no neighbour, or to the cell itself, is bad."""
    d = F.greatest(F.abs("dr"), F.abs("dc"))
    length = F.when(F.abs("dr") + F.abs("dc") == 2, cell_size * math.sqrt(2)).otherwise(F.lit(cell_size))
    return steps(route).groupBy("preset").agg(F.coalesce(F.sum(F.when(d == 1, length)), F.lit(0.0)).alias("length_m"), F.count("dr").alias("steps"), F.count_if(d != 1).alias("bad_steps"))


def route_boxes(route: DataFrame, west: float, north: float, cell: float) -> DataFrame:
    """preset, west, south, east, north of each route's cells on a grid with that corner."""
    by = route.groupBy("preset").agg(F.min("col").alias("c0"), F.max("col").alias("c1"), F.min("row").alias("r0"), F.max("row").alias("r1"))
    return by.select("preset", (west + F.col("c0") * cell).alias("west"), (north - (F.col("r1") + 1) * cell).alias("south"), (west + (F.col("c1") + 1) * cell).alias("east"), (north - F.col("r0") * cell).alias("north"))


def direction_quality(route: DataFrame, rows: int, cols: int) -> DataFrame:
    """Diagonal steps, turns and border cells of a route, as counts and as shares."""
    x = steps(route).withColumns({"pr": F.lag("dr").over(in_order()), "pc": F.lag("dc").over(in_order())})
    border = (F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == rows - 1) | (F.col("col") == cols - 1)
    out = x.groupBy("preset").agg(F.count("*").alias("cells"), F.count("dr").alias("steps"), F.count_if((F.col("dr") != 0) & (F.col("dc") != 0)).alias("diagonals"),
                                  F.count_if((F.col("pr") != F.col("dr")) | (F.col("pc") != F.col("dc"))).alias("turns"), F.count_if(border).alias("border"))
    return out.withColumns({"diagonal_share": F.when(F.col("steps") > 0, F.col("diagonals") / F.col("steps")).otherwise(0.0), "turn_share": F.col("turns") / F.greatest(F.lit(1), F.col("steps") - 1), "border_share": F.col("border") / F.col("cells")})


def class_counts(route: DataFrame, raster: DataFrame, classes: DataFrame, nodata: int = 65535) -> DataFrame:
    """preset, value, name, cells, native: how often a route meets each class of raster(row, col, value).

    Values without a class stay, with a null name. Native classes are above 0 and not nodata."""
    counts = along(route, raster).groupBy("preset", "value").agg(F.count("*").alias("cells"))
    return counts.join(classes, "value", "left").select("preset", "value", "name", "cells", ((F.col("value") > 0) & (F.col("value") != nodata)).alias("native"))


def top_classes(counts: DataFrame, most: int = 6) -> DataFrame:
    """The first classes above 0 of each route, by value."""
    rank = F.row_number().over(Window.partitionBy("preset").orderBy("value"))
    return counts.filter("value > 0").withColumn("place", rank).filter(F.col("place") <= most)


def baseline_deltas(exposure: DataFrame, baseline: str = "shortest") -> DataFrame:
    """preset, component, delta from the baseline's exposure; a component that one side lacks counts 0."""
    base = exposure.filter(F.col("preset") == baseline).select("component", F.col("exposure").alias("of_baseline"))
    keys = exposure.select("component").distinct()
    full = exposure.select("preset").distinct().crossJoin(F.broadcast(keys))  # presets x components, both short
    return (full.join(exposure, ["preset", "component"], "left").join(base, "component", "left")
        .select("preset", "component", (F.coalesce("exposure", F.lit(0.0)) - F.coalesce("of_baseline", F.lit(0.0))).alias("delta")))


def unavailable_hits(route: DataFrame, unavailable: DataFrame) -> DataFrame:
    """The steps of a route on unavailable cells."""
    return route.join(unavailable.select("row", "col").distinct(), ["row", "col"], "left_semi")


def inventory_totals(found: DataFrame) -> DataFrame:
    """preset, component, features, length_m, major_roads of found(preset, component, id, length_m, major).

    Lengths are rounded to millimetres before they are added and after."""
    return found.groupBy("preset", "component").agg(F.count("*").alias("features"), F.round(F.sum(F.round("length_m", 3)), 3).alias("length_m"), F.count_if("major").alias("major_roads"))
