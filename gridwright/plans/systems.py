"""Queries across map systems and raster files: datum step, warping, sampling, windows of TIFF files, whole derivation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import Datum, LambertConic, TransverseMercator
from ..operators import warp
from ..sources import tiff
from ..sources.workspace import new_path
from . import bindings as b
from . import sql_geo
from .registry import Registry
from .surfaces import PLACES, places

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql
TM, LCC, DATUM = TransverseMercator(), LambertConic(), Datum()
#: A raster of lineitem in the state-wide grid, and a target grid in zone 56 that it covers.
SOURCE = warp.Frame(LCC, 9_691_500.0, 4_553_200.0, 120.0, 120.0, 65, 80)
TARGET = warp.Frame(TM, 330_000.0, 6_380_000.0, 100.0, 100.0, 60, 60)
NODATA = 65535

_PIXELS = f"""pixels AS (SELECT row, col, q / n AS height, CASE WHEN q % 97 = 0 THEN {NODATA} ELSE (q % 12)::INT END AS class FROM (
  SELECT (l_orderkey % {SOURCE.rows})::INT AS row, (l_partkey % {SOURCE.cols})::INT AS col, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS q FROM lineitem GROUP BY ALL))"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, col, height, class of lineitem."""
    q = b.table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % SOURCE.rows).cast("int").alias("row"), (F.col("l_partkey") % SOURCE.cols).cast("int").alias("col")).agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("q"))
    return q.select("row", "col", (F.col("q") / F.col("n")).alias("height"), F.when(F.col("q") % 97 == 0, NODATA).otherwise((F.col("q") % 12).cast("int")).alias("class"))


def targets(spark: SparkSession) -> DataFrame:
    return spark.range(TARGET.rows * TARGET.cols).select(F.expr(f"cast(id div {TARGET.cols} as int)").alias("row"), (F.col("id") % TARGET.cols).cast("int").alias("col"))


# --- datum -------------------------------------------------------------------------------------------

_SHIFTED = f"""geo AS (SELECT id, 6378137.0 / sqrt(1 - power({sql_geo._E} * sin(radians(lat)), 2)) AS n, radians(lon) AS l, radians(lat) AS p FROM places),
old AS (SELECT id, n * cos(p) * cos(l) AS x, n * cos(p) * sin(l) AS y, n * (1 - power({sql_geo._E}, 2)) * sin(p) AS z FROM geo),
turned AS (SELECT *, radians(0.0394924 / 3600) AS a, radians(0.0327221 / 3600) AS b, radians(0.0328979 / 3600) AS c, 1 - 0.009994e-6 AS k FROM old),
new AS (SELECT id, 0.06155 + k * (x - c * y + b * z) AS x, -0.01087 + k * (c * x + y - a * z) AS y, -0.04019 + k * (-b * x + a * y + z) AS z FROM turned)"""
# latitude by repeated substitution of N sin(lat)
_LATITUDES = "s0 AS (SELECT *, atan2(z, sqrt(x * x + y * y)) AS lat0 FROM new)" + "".join(f", s{i} AS (SELECT *, atan2(z + power({sql_geo._E}, 2) * 6378137.0 * sin(lat{i - 1}) / sqrt(1 - power({sql_geo._E} * sin(lat{i - 1}), 2)), sqrt(x * x + y * y)) AS lat{i} FROM s{i - 1})" for i in range(1, 9))


@R.query(f"WITH places AS ({PLACES}), {_SHIFTED}, {_LATITUDES} SELECT id, round(degrees(atan2(y, x)), 9) AS lon, round(degrees(lat8), 9) AS lat FROM s8")
def datum_step(spark, sf_dir):
    """Places of the older national datum in the newer one."""
    moved = DATUM.shift(places(spark, sf_dir), "lon", "lat")
    return moved.select("id", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"))


# --- warping -----------------------------------------------------------------------------------------


def _placed_sql(cells: str, west: float, north: float) -> str:
    """CTEs up to placed(id, py, px): cells(id, row, col) of 100 m in zone 56 in pixels of the source, on one datum."""
    return f"""centres AS (SELECT id, {west} + (col + 0.5) * 100 AS x, {north} - (row + 0.5) * 100 AS y FROM {cells}), {sql_geo.inverse_transverse_mercator('centres')},
degrees AS (SELECT id, lon, lat FROM lonlat), {sql_geo.lambert_conic('degrees')},
placed AS (SELECT id, ({SOURCE.north} - y) / 120 AS py, (x - {SOURCE.west}) / 120 AS px FROM lcc)"""


_GRID = f"grid AS (SELECT i::INT AS id, (i // {TARGET.cols})::INT AS row, (i % {TARGET.cols})::INT AS col FROM range({TARGET.rows * TARGET.cols}) t(i))"
_WARPED = f"WITH {_PIXELS}, {_GRID}, {_placed_sql('grid', TARGET.west, TARGET.north)}"


@R.query(f"{_WARPED} SELECT g.row, g.col, p.class::DOUBLE AS value FROM placed JOIN grid g USING (id) JOIN pixels p ON p.row = floor(py) AND p.col = floor(px)")
def warp_nearest(spark, sf_dir):
    """Classes of the state-wide grid on a grid of zone 56, by the pixel under each cell's centre."""
    return warp.warp(pixels(spark, sf_dir).select("row", "col", F.col("class").alias("value")), SOURCE, targets(spark), TARGET, "nearest", tile=32)


@R.query(f"""{_WARPED}, four AS (SELECT id, floor(py - 0.5) + a AS r, floor(px - 0.5) + b AS c, abs(1 - a - (py - 0.5 - floor(py - 0.5))) * abs(1 - b - (px - 0.5 - floor(px - 0.5))) AS w FROM placed, (VALUES (0), (1)) s(a), (VALUES (0), (1)) t(b))
SELECT g.row, g.col, round(sum(w * height) / sum(w), 3) AS value FROM four JOIN grid g USING (id) JOIN pixels p ON p.row = r AND p.col = c WHERE w > 0 GROUP BY ALL""")
def warp_bilinear(spark, sf_dir):
    """Heights of the state-wide grid on a grid of zone 56, by the four pixels around each cell's centre."""
    return warp.warp(pixels(spark, sf_dir).select("row", "col", F.col("height").alias("value")), SOURCE, targets(spark), TARGET, "bilinear", tile=32).withColumn("value", F.round("value", 3))


_SAMPLED = f"WITH {_PIXELS}, {b.ROUTES}, stops AS (SELECT preset || ':' || step AS id, row, col FROM routes), {_placed_sql('stops', TARGET.west, TARGET.north)}, met AS (SELECT split_part(id, ':', 1) AS preset, coalesce(p.class, {NODATA}) AS value FROM placed LEFT JOIN pixels p ON p.row = floor(py) AND p.col = floor(px))"


def _classes_met(spark, sf_dir):
    """Route cells sampled in a TIFF of the state-wide grid, of which only the blocks under the routes are read."""
    path = new_path(spark, "classes") + ".tif"
    tiff.write_geotiff(pixels(spark, sf_dir).select("row", "col", F.col("class").alias("value")), path, SOURCE.rows, SOURCE.cols, SOURCE.west, SOURCE.north, 120.0, 3308, NODATA, block=16)
    stops = warp.cell_centres(b.routes(spark), TARGET).select("preset", "x", "y")
    samples = warp.sample(stops, TM, SOURCE, lambda window: tiff.read_pixels(spark, path, window))
    return warp.class_report(samples, b.table(spark, sf_dir, "nation").filter("n_nationkey < 9").select(F.col("n_nationkey").alias("value"), F.col("n_name").alias("name")), NODATA)


@R.query(f"{_SAMPLED}, k AS (SELECT preset, value, count(*) AS cells FROM met GROUP BY ALL) SELECT preset, value, n_name AS name, cells FROM k LEFT JOIN (FROM nation WHERE n_nationkey < 9) ON value = n_nationkey")
def sampled_classes(spark, sf_dir):
    """Classes under the routes, sampled in the second system."""
    return _classes_met(spark, sf_dir)[0]


@R.query(f"{_SAMPLED} SELECT preset, count(*) AS cells, count(*) FILTER (value > 0 AND value <> {NODATA}) AS native, count(*) FILTER (value = {NODATA}) AS nodata, count(*) FILTER (value = 0) AS unclassified, count(DISTINCT CASE WHEN value > 0 AND value <> {NODATA} THEN value END) AS classes, round(count(*) FILTER (value > 0 AND value <> {NODATA}) / count(*), 9) AS native_share FROM met GROUP BY preset")
def sampled_class_totals(spark, sf_dir):
    return _classes_met(spark, sf_dir)[1].withColumn("native_share", F.round("native_share", 9))


# --- windows of files --------------------------------------------------------------------------------


def _as_tiff(spark, sf_dir, column: str, kind: str, nodata: float) -> str:
    path = new_path(spark, f"pixels-{column}") + ".tif"
    tiff.write_geotiff(pixels(spark, sf_dir).select("row", "col", F.col(column).alias("value")), path, SOURCE.rows, SOURCE.cols, SOURCE.west, SOURCE.north, 120.0, 3308, nodata, kind, 16)
    return path


@R.query(f"WITH {_PIXELS} SELECT row, col, round(height, 6) AS value FROM pixels WHERE row BETWEEN 10 AND 39 AND col BETWEEN 21 AND 70")
def raster_tiff_window(spark, sf_dir):
    """Heights written as a TIFF of 64-bit floats and read back from the blocks of a window."""
    return tiff.read_pixels(spark, _as_tiff(spark, sf_dir, "height", "<f8", -32767), (10, 21, 30, 50)).withColumn("value", F.round("value", 6))


@R.query(f"WITH {_PIXELS}, cells AS (SELECT (i // 17)::INT AS row, (i % 17)::INT AS col FROM range(11 * 17) t(i)) SELECT c.row, c.col, p.class::DOUBLE AS value FROM cells c JOIN pixels p ON p.row = 5 + ((2 * c.row + 1) * 50) // 22 AND p.col = 8 + ((2 * c.col + 1) * 60) // 34 WHERE p.class <> {NODATA}")
def raster_tiff_nearest(spark, sf_dir):
    """A window of a TIFF of classes at a coarser size: the pixel under each cell's centre."""
    window = (5, 8, 50, 60)
    return tiff.downsample_nearest(tiff.read_pixels(spark, _as_tiff(spark, sf_dir, "class", "<u2", NODATA), window), window, 11, 17)
