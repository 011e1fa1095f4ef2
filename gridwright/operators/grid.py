"""Grids: making them, neighbourhood stencils, masks, resampling, burning vectors in, diagnostics."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import TransverseMercator, columns, segment_meets_box
from ..functions.scalar import clamp_unit

MOST_CELLS = 2_000_000


def grid_frame(spark: SparkSession, envelope: DataFrame, cell: float, to: TransverseMercator = TransverseMercator()) -> DataFrame:
    """x1, y1, x2, y2, rows, cols of the smallest grid of whole cells over envelope(west, south, east, north) in degrees."""
    corners = envelope.select(F.explode(F.array(*(F.struct(F.col(a).alias("lon"), F.col(b).alias("lat")) for a in ("west", "east") for b in ("south", "north")))).alias("p")).select("p.lon", "p.lat")
    x, y = columns(to.forward_sql("lon", "lat"))
    out = corners.select(x.alias("x"), y.alias("y")).agg(
        (F.floor(F.min("x") / cell) * cell).alias("x1"), (F.floor(F.min("y") / cell) * cell).alias("y1"), (F.ceil(F.max("x") / cell) * cell).alias("x2"), (F.ceil(F.max("y") / cell) * cell).alias("y2"))
    size = out.withColumns({"rows": F.round((F.col("y2") - F.col("y1")) / cell).cast("int"), "cols": F.round((F.col("x2") - F.col("x1")) / cell).cast("int")})
    n = F.col("rows").cast("long") * F.col("cols")
    return size.withColumn("rows", F.when((n > 0) & (n <= MOST_CELLS), F.col("rows")).otherwise(F.raise_error(F.lit("grid is empty or too large")).cast("int")))


def all_cells(frame: DataFrame) -> DataFrame:
    """row, col of every cell of a one-row frame(rows, cols)."""
    return frame.select("cols", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row")).select("row", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"))


def cell_of(x: Column, y: Column, west: float, north: float, cell: float) -> tuple[Column, Column]:
    return F.floor((north - y) / cell).cast("int"), F.floor((x - west) / cell).cast("int")


def centre_of(row: Column, col: Column, west: float, north: float, cell: float) -> tuple[Column, Column]:
    return west + (col + 0.5) * cell, north - (row + 0.5) * cell


def _gradient(along: str, across: str, value: str, cell: float) -> Column:
    """Central differences, one-sided at the ends."""
    w = Window.partitionBy(across).orderBy(along)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    here = F.col(value)
    spans = F.when(before.isNull() | after.isNull(), 1.0).otherwise(2.0)
    return F.when(before.isNull() & after.isNull(), F.lit(0.0)).otherwise((F.coalesce(after, here) - F.coalesce(before, here)) / (spans * cell))


def slope(cells: DataFrame, cell: float = 100.0, elevation: str = "elevation") -> DataFrame:
    """cells with slope in degrees; unknown heights count as 0 in the differences."""
    filled = cells.withColumn("_z", F.coalesce(F.nanvl(F.col(elevation), F.lit(0.0)), F.lit(0.0)))
    filled = filled.withColumn("_gy", _gradient("row", "col", "_z", cell)).withColumn("_gx", _gradient("col", "row", "_z", cell))
    return filled.withColumn("slope", F.degrees(F.atan(F.hypot("_gx", "_gy")))).drop("_z", "_gx", "_gy")


def terrain(slope_degrees: Column, steepest: float = 20.0) -> Column:
    return clamp_unit(slope_degrees, 0.0, steepest)


def vegetation_mask(value: Column) -> Column:
    return F.when(value > 0, 1.0).otherwise(0.0)


def unavailable(cells: DataFrame, elevation: str = "elevation", value: str = "value", nodata: int = 65535) -> DataFrame:
    """Cells without a height or with the class nodata, in order."""
    off = F.col(elevation).isNull() | F.isnan(elevation) | F.coalesce(F.col(value) == nodata, F.lit(True))
    return cells.filter(off).select("row", "col").orderBy("row", "col")


def mosaic(tiles: DataFrame, nodata: float = -32767.0) -> DataFrame:
    """row, col, value of the first tile by path that has one there: tiles(path, row, col, value)."""
    return tiles.filter((F.col("value") != nodata) & ~F.isnan("value")).groupBy("row", "col").agg(F.min_by("value", "path").alias("value"))


def resample_nearest(source: DataFrame, targets: DataFrame) -> DataFrame:
    """targets(row, col, y, x) with the value of the source cell they fall in; y, x in source cells."""
    at = targets.withColumns({"sr": F.floor("y").cast("int"), "sc": F.floor("x").cast("int")})
    values = source.select(F.col("row").alias("sr"), F.col("col").alias("sc"), "value")
    return at.join(values, ["sr", "sc"], "left").select("row", "col", "value")


def resample_bilinear(source: DataFrame, targets: DataFrame) -> DataFrame:
    """targets(row, col, y, x) with the mean of the four source centres around, by nearness; unknown ones are left out."""
    fy, fx = F.col("y") - 0.5, F.col("x") - 0.5
    base = targets.withColumns({"r0": F.floor(fy), "c0": F.floor(fx)}).withColumns({"dy": fy - F.col("r0"), "dx": fx - F.col("c0")})
    corner = lambda a, b: F.struct((F.col("r0") + a).cast("int").alias("sr"), (F.col("c0") + b).cast("int").alias("sc"), ((F.col("dy") if a else 1 - F.col("dy")) * (F.col("dx") if b else 1 - F.col("dx"))).alias("w"))
    four = base.select("row", "col", F.explode(F.array(*(corner(a, b) for a in (0, 1) for b in (0, 1)))).alias("k")).select("row", "col", "k.sr", "k.sc", "k.w").filter("w > 0")
    values = source.filter(F.col("value").isNotNull() & ~F.isnan("value")).select(F.col("row").alias("sr"), F.col("col").alias("sc"), "value")
    return four.join(values, ["sr", "sc"]).groupBy("row", "col").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))


def window_nearest(raster: DataFrame, first_row: int, first_col: int, rows: int, cols: int, stride: int) -> DataFrame:
    """A window of raster(row, col, value) at every stride-th cell: the nearest source cell of each target cell."""
    inside = F.col("row").between(first_row, first_row + rows - 1) & F.col("col").between(first_col, first_col + cols - 1)
    middle = stride // 2
    r, c = F.col("row") - first_row, F.col("col") - first_col
    return raster.filter(inside & (r % stride == F.least(F.lit(middle), rows - 1 - (r - r % stride))) & (c % stride == F.least(F.lit(middle), cols - 1 - (c - c % stride)))).select(F.floor(r / stride).cast("int").alias("row"), F.floor(c / stride).cast("int").alias("col"), "value")


def burn(segments: DataFrame, west: float, north: float, cell: float, rows: int, cols: int) -> DataFrame:
    """row, col of every cell whose closed square a segment(x1, y1, x2, y2) touches.

    Candidates are the cells under each segment's bounding box, so long lines should come cut up."""
    lo_c, hi_c = F.ceil((F.least("x1", "x2") - west) / cell) - 1, F.floor((F.greatest("x1", "x2") - west) / cell)
    lo_r, hi_r = F.ceil((north - F.greatest("y1", "y2")) / cell) - 1, F.floor((north - F.least("y1", "y2")) / cell)
    clip = lambda c, most: F.greatest(F.lit(0), F.least(F.lit(most - 1), c.cast("int")))
    seen = segments.filter((hi_c >= 0) & (lo_c < cols) & (hi_r >= 0) & (lo_r < rows))
    boxes = seen.withColumn("row", F.explode(F.sequence(clip(lo_r, rows), clip(hi_r, rows)))).withColumn("col", F.explode(F.sequence(clip(lo_c, cols), clip(hi_c, cols))))
    box = (west + F.col("col") * cell, north - (F.col("row") + 1) * cell, west + (F.col("col") + 1) * cell, north - F.col("row") * cell)
    return boxes.filter(segment_meets_box(tuple(F.col(c) for c in ("x1", "y1", "x2", "y2")), box)).select("row", "col").distinct()


def diagnostics(cells: DataFrame) -> DataFrame:
    """One row: counts and slope range over cells(elevation, slope, vegetation, unavailable)."""
    free = ~F.col("unavailable")
    return cells.agg(F.count("*").alias("cells"), F.count_if(F.col("elevation").isNotNull() & ~F.isnan("elevation")).alias("heights"), F.count_if(F.col("unavailable")).alias("unavailable"), F.count_if(free & (F.col("vegetation") > 0)).alias("vegetation"), F.min(F.when(free, F.col("slope"))).alias("min_slope"), F.max(F.when(free, F.col("slope"))).alias("max_slope"))


def pixel_stats(raster: DataFrame, nodata: int = 65535) -> DataFrame:
    """One row: distinct values, nodata and valid pixels, valid share."""
    valid = F.col("value") != nodata
    return raster.agg(F.count_distinct("value").alias("classes"), F.count_if(~valid).alias("nodata"), F.count_if(valid).alias("valid"), (F.count_if(valid) / F.count("*")).alias("valid_share"))


def tile_envelopes(envelope: DataFrame, size: float) -> DataFrame:
    """tile, west, south, east, north: tiles of a one-row envelope by row from the south-west; the last ones are cut."""
    n = lambda a, b: F.greatest(F.lit(1), F.ceil((F.col(b) - F.col(a)) / size - 1e-9).cast("int"))
    at = envelope.withColumns({"nx": n("west", "east"), "ny": n("south", "north")})
    t = at.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("ny") - 1))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)))
    return t.select((F.col("j") * F.col("nx") + F.col("i")).alias("tile"), (F.col("west") + F.col("i") * size).alias("west"), (F.col("south") + F.col("j") * size).alias("south"), F.least(F.col("east"), F.col("west") + (F.col("i") + 1) * size).alias("east"), F.least(F.col("north"), F.col("south") + (F.col("j") + 1) * size).alias("north"))


def dem_tile_ids(envelope: DataFrame) -> DataFrame:
    """lat, lon, tile_id of the one-degree height tiles under an envelope."""
    t = envelope.select(F.explode(F.sequence(F.floor("south").cast("int"), F.ceil("north").cast("int") - 1)).alias("lat"), "west", "east").select("lat", F.explode(F.sequence(F.floor("west").cast("int"), F.ceil("east").cast("int") - 1)).alias("lon"))
    part = lambda c, plus, minus, digits: F.concat(F.when(F.col(c) >= 0, plus).otherwise(minus), F.lpad(F.abs(c).cast("string"), digits, "0"), F.lit("_00"))
    return t.select("lat", "lon", F.concat(F.lit("Copernicus_DSM_COG_10_"), part("lat", "N", "S", 2), F.lit("_"), part("lon", "E", "W", 3), F.lit("_DEM")).alias("tile_id"))


def benchmark_costs(size: int):
    """The published routing landscape: a wall, a band and a disc of penalties (fixed values)."""
    import numpy as np

    r, c = np.mgrid[0:size, 0:size]
    wall, band = np.abs(c - int(size * 0.34)) < max(2, size // 35), np.abs(r - int(size * 0.62)) < max(2, size // 40)
    disc = np.hypot(r - size * 0.60, c - size * 0.70) < size * 0.13
    return 1.0 + np.where(wall, np.where(r < int(size * 0.72), 7.0, 1.0), 0.0) + np.where(band, np.where(c > int(size * 0.18), 5.0, 1.0), 0.0) + np.where(disc, 4.0, 0.0)




def fill(rings: DataFrame, west: float, north: float, cell: float, rows: int, cols: int, key: str = "id") -> DataFrame:
    """key, row, col of every cell whose centre an area covers: ring segments (key, x1, y1, x2, y2), even-odd over all rings.

    Every edge gives its crossing with each row of centres it spans; sorted crossings pair up to runs of cells."""
    y = lambda r: north - (r + 0.5) * cell
    lo, hi = F.floor((north - F.greatest("y1", "y2")) / cell - 0.5) + 1, F.ceil((north - F.least("y1", "y2")) / cell - 0.5) - 1
    span = rings.filter(F.col("y1") != F.col("y2")).withColumns({"lo": F.greatest(F.lit(0), lo.cast("int") - 1), "hi": F.least(F.lit(rows - 1), hi.cast("int") + 1)}).filter("lo <= hi")
    hits = span.withColumn("row", F.explode(F.sequence("lo", "hi"))).filter((F.least("y1", "y2") <= y(F.col("row"))) & (y(F.col("row")) < F.greatest("y1", "y2")))
    at = hits.select(key, "row", (F.col("x1") + (y(F.col("row")) - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))).alias("x"))
    runs = at.groupBy(key, "row").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    pairs = runs.select(key, "row", F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.size("xs") / 2).cast("int") - 1), lambda i: F.struct(F.get("xs", i * 2).alias("a"), F.get("xs", i * 2 + 1).alias("b")))).alias("p"))
    first, last = F.ceil((F.col("p.a") - west) / cell - 0.5).cast("int"), (F.ceil((F.col("p.b") - west) / cell - 0.5) - 1).cast("int")
    inside = pairs.withColumns({"a": F.greatest(F.lit(0), first), "b": F.least(F.lit(cols - 1), last)}).filter("a <= b")
    return inside.select(key, "row", F.explode(F.sequence("a", "b")).alias("col")).distinct()


def burn_areas(rings: DataFrame, west: float, north: float, cell: float, rows: int, cols: int, key: str = "id") -> DataFrame:
    """row, col of every cell that an area touches: cells under its rings and cells with their centre inside."""
    return burn(rings, west, north, cell, rows, cols).unionByName(fill(rings, west, north, cell, rows, cols, key).select("row", "col")).distinct()
