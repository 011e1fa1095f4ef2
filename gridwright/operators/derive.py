"""A study area's grid derived from files: height tiles, a raster of classes and vector layers, each in its own map system.

The grid is laid over an envelope in degrees; heights are a mosaic of tiles warped by the four pixels around a
cell, classes are those under a cell's centre, and layers are burnt in. Of every raster only the blocks under
the grid are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import Datum, Geographic, LambertConic, TransverseMercator
from ..sources import tiff
from . import cost, grid, warp

#: Map systems by code, and whether they are of the older datum (fixed values).
SYSTEMS = {4326: (Geographic(), False), 7844: (Geographic(), False), 7856: (TransverseMercator(), False), 3308: (LambertConic(), True)}
TARGET_CRS = 7856
CLASS_NODATA = 65535


class OutsideGrid(ValueError):
    """A place that the grid does not cover, or where it has no values."""


@dataclass
class Derived:
    """cells: row, col, elevation, slope, value, closed and the components; frame: where they are."""

    frame: warp.Frame
    cells: DataFrame
    facts: dict

    def layers(self) -> DataFrame:
        """component, row, col, value."""
        each = F.array(*(F.struct(F.lit(c).alias("component"), F.col(c).cast("double").alias("value")) for c in cost.COMPONENTS))
        return self.cells.select("row", "col", F.explode(each).alias("k")).select("k.component", "row", "col", "k.value")


def study_frame(spark: SparkSession, envelope: tuple[float, float, float, float], cell: float) -> warp.Frame:
    """The grid of whole cells over an envelope (west, south, east, north) in degrees."""
    corners = spark.createDataFrame([tuple(map(float, envelope))], "west double, south double, east double, north double")
    f = grid.grid_frame(spark, corners, cell).first()
    return warp.Frame(SYSTEMS[TARGET_CRS][0], float(f.x1), float(f.y2), cell, cell, f.rows, f.cols)


def raster_frame(facts: dict) -> warp.Frame:
    if facts.get("crs_epsg") not in SYSTEMS or "west" not in facts:
        raise ValueError(f"raster without a known place: {facts.get('crs_epsg')}")
    return warp.Frame(SYSTEMS[facts["crs_epsg"]][0], facts["west"], facts["north"], facts["pixel_x"], facts["pixel_y"], facts["rows"], facts["cols"])


def places_in(cells: DataFrame, target: warp.Frame, raster: warp.Frame, older: bool) -> DataFrame:
    """row, col, py, px: where the centres of the target's cells lie in a raster."""
    moved = warp.to_system(warp.cell_centres(cells.select("row", "col"), target), target.system, raster.system, Datum().reversed() if older else None)
    return warp.in_pixels(moved, raster)


def window_under(places: DataFrame, rows: int, cols: int, around: int = 1) -> tuple[int, int, int, int] | None:
    """The window (row, col, rows, cols) of a raster under places, with some pixels around; None if they lie beside it."""
    box = places.agg(F.floor(F.min("py")).alias("a"), F.floor(F.min("px")).alias("b"), F.floor(F.max("py")).alias("c"), F.floor(F.max("px")).alias("d")).first()
    if box.a is None:
        return None
    r0, c0, r1, c1 = max(0, box.a - around), max(0, box.b - around), min(rows, box.c + around + 1), min(cols, box.d + around + 1)
    return (r0, c0, r1 - r0, c1 - c0) if r0 < r1 and c0 < c1 else None


def heights(spark: SparkSession, paths: list[str], cells: DataFrame, target: warp.Frame) -> DataFrame:
    """row, col, value: heights of the grid from tiles of one system and pixel size; where tiles overlap, the first by path counts."""
    facts = {p: tiff.describe(p) for p in sorted(paths)}
    if not facts:
        raise ValueError("no height tiles")
    frames = {p: raster_frame(f) for p, f in facts.items()}
    first = next(iter(frames.values()))
    if len({(f["crs_epsg"], round(f["pixel_x"], 12), round(f["pixel_y"], 12)) for f in facts.values()}) > 1:
        raise ValueError("height tiles differ in their system or resolution")
    older = SYSTEMS[next(iter(facts.values()))["crs_epsg"]][1]
    # rows and columns of the mosaic are counted from the corner of its first tile
    places = places_in(cells, target, first, older)
    tiles = None
    for path, f in frames.items():
        down, right = round((first.north - f.north) / f.cell_y), round((f.west - first.west) / f.cell_x)
        window = window_under(places.select((F.col("py") - down).alias("py"), (F.col("px") - right).alias("px")).filter(F.col("py").between(-1, f.rows + 1) & F.col("px").between(-1, f.cols + 1)), f.rows, f.cols)
        if window:
            part = tiff.read_pixels(spark, path, window).select(F.lit(path).alias("path"), (F.col("row") + down).alias("row"), (F.col("col") + right).alias("col"), "value")
            tiles = part if tiles is None else tiles.unionByName(part)
    if tiles is None:
        raise ValueError("no height tile lies under the grid")
    return warp.take(grid.mosaic(tiles), places, "bilinear")


def classes(spark: SparkSession, path: str, cells: DataFrame, target: warp.Frame) -> DataFrame:
    """row, col, value: classes of the grid, by the pixel under each cell's centre."""
    facts = tiff.describe(path)
    raster = raster_frame(facts)
    places = places_in(cells, target, raster, SYSTEMS[facts["crs_epsg"]][1])
    window = window_under(places, raster.rows, raster.cols)
    if window is None:
        raise ValueError("the raster of classes does not lie under the grid")
    return warp.take(tiff.read_pixels(spark, path, window), places, "nearest")


def endpoint_cells(spark: SparkSession, endpoints: dict[str, tuple[float, float]], frame: warp.Frame, closed: DataFrame | None = None) -> dict[str, tuple[int, int]]:
    """The cell of each named place (longitude, latitude); one outside the grid, or on a closed cell, is an error."""
    points = spark.createDataFrame([(k, float(lon), float(lat)) for k, (lon, lat) in endpoints.items()], "name string, x double, y double")
    row, col = grid.cell_of(F.col("x"), F.col("y"), frame.west, frame.north, frame.cell_x)
    found = warp.to_system(points, Geographic(), frame.system).select("name", row.alias("row"), col.alias("col"))
    if closed is not None:
        found = found.join(closed.select("row", "col").distinct().withColumn("off", F.lit(True)), ["row", "col"], "left")
    out = {}
    for r in found.collect():  # two places
        if not (0 <= r.row < frame.rows and 0 <= r.col < frame.cols):
            raise OutsideGrid(f"{r.name} is outside the grid")
        if closed is not None and r.off:
            raise OutsideGrid(f"{r.name} is on a cell without values")
        out[r.name] = (r.row, r.col)
    return out


def derive(spark: SparkSession, envelope: tuple[float, float, float, float], height_paths: list[str], class_path: str, lines: dict[str, DataFrame], areas: dict[str, DataFrame], endpoints: dict[str, tuple[float, float]] | None = None, cell: float = 100.0) -> Derived:
    """The grid of a study area with its seven components.

    lines and areas: segments (id, x1, y1, x2, y2) in the grid's system by layer: roads, railways and hydrography_line;
    protected_land and hydrography_area. A layer that is missing is an error; one without segments is all 0."""
    wanted = {"roads", "railways", "hydrography_line"}, {"protected_land", "hydrography_area"}
    if set(lines) != wanted[0] or set(areas) != wanted[1]:
        raise ValueError(f"layers differ: {sorted((set(lines) ^ wanted[0]) | (set(areas) ^ wanted[1]))}")
    frame = study_frame(spark, envelope, cell)
    cells = grid.all_cells(spark.createDataFrame([(frame.rows, frame.cols)], "rows int, cols int"))
    x = cells.join(heights(spark, height_paths, cells, frame).withColumnRenamed("value", "elevation"), ["row", "col"], "left")
    x = x.join(classes(spark, class_path, cells, frame).select("row", "col", F.col("value").cast("int").alias("value")), ["row", "col"], "left").withColumn("value", F.coalesce("value", F.lit(CLASS_NODATA)))
    box = (frame.west, frame.north, cell, frame.rows, frame.cols)
    for name, segments in {**lines, **areas}.items():
        burnt = grid.burn_areas(segments, *box) if name in areas else grid.burn(segments, *box)
        x = x.join(burnt.withColumn(name, F.lit(1.0)), ["row", "col"], "left").na.fill(0.0, [name])
    x = grid.slope(x, cell)
    x = x.withColumns({"length": F.lit(1.0), "terrain": grid.terrain(F.col("slope")), "native_vegetation": grid.vegetation_mask(F.col("value")), "hydrography": F.greatest("hydrography_line", "hydrography_area"), "closed": F.col("elevation").isNull() | (F.col("value") == CLASS_NODATA)})
    facts = {"rows": frame.rows, "cols": frame.cols, "west": frame.west, "north": frame.north, "cell_size_m": cell, "analysis_crs_epsg": TARGET_CRS, "height_tiles": sorted(height_paths), "class_raster": class_path}
    if endpoints:
        facts |= {f"{k}_cell": v for k, v in endpoint_cells(spark, endpoints, frame, x.filter("closed")).items()}
    return Derived(frame, x, facts)


def write_bundle(derived: Derived, path: str) -> dict:
    """The components as a bundle of grids under a path that must not exist, and their header with diagnostics when they are all there."""
    from ..sources import writers

    spark = derived.cells.sparkSession
    writers.require_absent(spark, path)
    writers.write_grid(derived.layers(), path + "/grids")
    found = grid.diagnostics(derived.cells.select("elevation", "slope", F.col("native_vegetation").alias("vegetation"), F.col("closed").alias("unavailable"))).first().asDict()
    header = {"format": "normalized-cost-grids", **derived.facts, "diagnostics": found}
    writers.write_document(spark, header, path + "/bundle.json")
    return header
