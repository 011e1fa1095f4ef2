"""Rasters brought from one map system to another: target grids warped from source pixels, points sampled in another system.

Every target cell is taken to its place in the source by column expressions; cells and pixels then meet by
tiles of the source. A pixel at a tile's edge is sent to the tiles that need it as a neighbour, so a task holds
one tile of pixels and the cells that fall in it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import Datum, Geographic, LambertConic, TransverseMercator

System = Geographic | TransverseMercator | LambertConic


@dataclass(frozen=True)
class Frame:
    """A raster's place: its system, its north-west corner and the size of its cells; rows and cols where they are known."""

    system: System
    west: float
    north: float
    cell_x: float
    cell_y: float
    rows: int | None = None
    cols: int | None = None


def to_system(points: DataFrame, source: System, target: System, datum: Datum | None = None) -> DataFrame:
    """points(x, y) of one system with x and y of the other; datum: the step between their geodetic datums, forwards."""
    lon, lat = source.inverse_sql("x", "y")
    # degrees are columns of their own, so that no expression is repeated in the next one
    out = points.withColumns({"_lon": F.expr(lon), "_lat": F.expr(lat)})
    if datum is not None:
        out = datum.shift(out, "_lon", "_lat")
    x, y = target.forward_sql("_lon", "_lat")
    return out.withColumns({"x": F.expr(x), "y": F.expr(y)}).drop("_lon", "_lat")


def cell_centres(cells: DataFrame, frame: Frame) -> DataFrame:
    """cells(row, col) with x, y of their centres."""
    return cells.withColumns({"x": frame.west + (F.col("col") + 0.5) * frame.cell_x, "y": frame.north - (F.col("row") + 0.5) * frame.cell_y})


def in_pixels(points: DataFrame, frame: Frame) -> DataFrame:
    """points(x, y) with their place in a raster in pixels from its corner: py down, px to the right."""
    return points.withColumns({"py": (frame.north - F.col("y")) / frame.cell_y, "px": (F.col("x") - frame.west) / frame.cell_x}).drop("x", "y")


def nearest(pixels: np.ndarray, known: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The pixel that holds each place; NaN where it is unknown. Places are from the corner of `pixels`."""
    r, c = np.floor(y).astype(int), np.floor(x).astype(int)
    return np.where(known[r, c], pixels[r, c], np.nan)


def bilinear(pixels: np.ndarray, known: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The mean of the four pixels around each place by nearness; unknown ones are left out, NaN without any."""
    r, c = np.floor(y - 0.5).astype(int), np.floor(x - 0.5).astype(int)
    dy, dx = y - 0.5 - r, x - 0.5 - c
    total, weights = np.zeros(len(y)), np.zeros(len(y))
    for a, b in product((0, 1), (0, 1)):
        w = (dy if a else 1 - dy) * (dx if b else 1 - dx) * known[r + a, c + b]
        total += w * np.where(w > 0, pixels[r + a, c + b], 0.0)
        weights += w
    return np.where(weights > 0, total / np.where(weights > 0, weights, 1), np.nan)


METHODS = {"nearest": nearest, "bilinear": bilinear}


def take(pixels: DataFrame, places: DataFrame, method: str = "nearest", tile: int = 256) -> DataFrame:
    """row, col, value of places(row, col, py, px) in pixels(row, col, value); places that meet no known pixel give no row.

    One join on the source's tiles; a tile brings along the row and column of pixels around it."""
    resample = METHODS[method]
    wide = tile + 2
    floor = lambda c: F.floor(c / tile).cast("int")
    at = places.withColumns({"tr": floor(F.col("py")), "tc": floor(F.col("px"))})
    # a pixel belongs to its tile, and to those that it borders on
    near = lambda c: F.array_distinct(F.array(floor(F.col(c) - 1), floor(F.col(c)), floor(F.col(c) + 1)))
    known = pixels.filter(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))
    sent = known.select(F.explode(near("row")).alias("tr"), "row", "col", "value").select("tr", F.explode(near("col")).alias("tc"), "row", "col", F.col("value").cast("double").alias("value"))

    def each(key: tuple, cells: pa.Table, source: pa.Table) -> pa.Table:
        if not cells.num_rows or not source.num_rows:
            return pa.table({"row": pa.array([], pa.int32()), "col": pa.array([], pa.int32()), "value": pa.array([], pa.float64())})
        top, left = key[0].as_py() * tile - 1, key[1].as_py() * tile - 1
        grid, held = np.zeros((wide, wide)), np.zeros((wide, wide), bool)
        r, c = source.column("row").to_numpy() - top, source.column("col").to_numpy() - left
        grid[r, c], held[r, c] = source.column("value").to_numpy(), True
        value = resample(grid, held, cells.column("py").to_numpy() - top, cells.column("px").to_numpy() - left)
        found = pa.array(~np.isnan(value))
        return pa.table({"row": cells.column("row").filter(found), "col": cells.column("col").filter(found), "value": pa.array(value).filter(found)})

    cells = at.select("tr", "tc", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "py", "px")
    return cells.groupBy("tr", "tc").cogroup(sent.groupBy("tr", "tc")).applyInArrow(lambda key, a, b: each(key, a, b), "row int, col int, value double")


def warp(pixels: DataFrame, source: Frame, cells: DataFrame, target: Frame, method: str = "bilinear", datum: Datum | None = None, tile: int = 256) -> DataFrame:
    """row, col, value of the target's cells(row, col) taken from pixels of another system; cells beyond the known pixels give no row.

    datum: the step from the target's datum to the source's."""
    places = in_pixels(to_system(cell_centres(cells.select("row", "col"), target), target.system, source.system, datum), source)
    return take(pixels, places, method, tile)


def sample(points: DataFrame, system: System, raster: Frame, read: Callable[[tuple[int, int, int, int]], DataFrame], datum: Datum | None = None) -> DataFrame:
    """points(x, y, ...) of a system with the value of the pixel of a raster of another system that holds them.

    read gives row, col, value in a window (row, col, rows, cols): the points' box, so only its blocks are read. A point
    outside the raster is an error, as is a null place; a pixel without a value leaves it null."""
    placed = in_pixels(to_system(points, system, raster.system, datum), raster)
    keyed = placed.withColumns({"_row": F.floor("py").cast("int"), "_col": F.floor("px").cast("int")}).drop("py", "px")
    box = keyed.agg(F.min("_row").alias("a"), F.min("_col").alias("b"), F.max("_row").alias("c"), F.max("_col").alias("d"), F.count("*").alias("n"), F.count("_row").alias("m"), F.count("_col").alias("k")).first()
    if box.n != box.m or box.n != box.k:
        raise ValueError("points without a place")
    if box.n and (box.a < 0 or box.b < 0 or (raster.rows is not None and box.c >= raster.rows) or (raster.cols is not None and box.d >= raster.cols)):
        raise ValueError("points lie outside the raster")
    window = (box.a, box.b, box.c - box.a + 1, box.d - box.b + 1) if box.n else (0, 0, 1, 1)
    values = read(window).select(F.col("row").alias("_row"), F.col("col").alias("_col"), "value")
    return keyed.join(values, ["_row", "_col"], "left").drop("_row", "_col")


def native(value: Column, nodata: int) -> Column:
    """Classes above 0 that are not nodata."""
    return (value > 0) & (value != nodata)


def class_report(samples: DataFrame, classes: DataFrame, nodata: int = 65535, key: str = "preset") -> tuple[DataFrame, DataFrame]:
    """(key, value, name, cells; one row a key: cells, native, nodata, unclassified, classes) of samples(key, value).

    A sample without a value has met nodata. Values without a class stay, with a null name."""
    full = samples.withColumn("value", F.coalesce(F.col("value"), F.lit(nodata)).cast("int"))
    counts = full.groupBy(key, "value").agg(F.count("*").alias("cells")).join(classes, "value", "left").select(key, "value", "name", "cells")
    of = native(F.col("value"), nodata)
    totals = full.groupBy(key).agg(F.count("*").alias("cells"), F.count_if(of).alias("native"), F.count_if(F.col("value") == nodata).alias("nodata"), F.count_if(F.col("value") == 0).alias("unclassified"), F.count_distinct(F.when(of, F.col("value"))).alias("classes"))
    return counts, totals.withColumn("native_share", F.col("native") / F.col("cells"))
