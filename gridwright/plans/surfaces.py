"""Queries over grids and cost surfaces: making, combining, routing, resampling, burning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import LambertConic, TransverseMercator, columns
from ..functions.scalar import clamp_unit
from ..operators import cost, grid, routing
from ..operators.checks import outside_domain
from . import bindings as b
from . import sql_geo
from .registry import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql
TM, LCC = TransverseMercator(), LambertConic()
#: Places of the customers table in degrees, for projections.
PLACES = "SELECT c_custkey AS id, 150.82 + (c_custkey * 7919 % 10007) / 10007.0 * 0.8 AS lon, -33.15 + (c_custkey * 104729 % 10007) / 10007.0 * 0.88 AS lat FROM customer"


def envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box of the places, in degrees: one row."""
    p = places(spark, sf_dir)
    return p.agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return b.table(spark, sf_dir, "customer").select(k.alias("id"), (150.82 + (k * 7919 % 10007) / 10007.0 * 0.8).alias("lon"), (-33.15 + (k * 104729 % 10007) / 10007.0 * 0.88).alias("lat"))


@R.query("SELECT l_orderkey, l_linenumber, l_partkey, round(least(1.0, greatest(0.0, (l_quantity - 5.0) / 40.0)), 9) AS unit FROM lineitem")
def normalize_clamped(spark, sf_dir):
    return b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(clamp_unit(F.col("l_quantity"), 5.0, 45.0), 9).alias("unit"))


@R.query("""WITH w AS (SELECT o_orderpriority AS preset, 'p' || (o_orderkey % 7) AS component, sum((o_orderkey % 11)::BIGINT - 5)::DOUBLE AS weight FROM orders GROUP BY ALL),
expected AS (SELECT 'p' || i AS component FROM range(6) t(i)), wanted AS (SELECT preset, component FROM (SELECT DISTINCT preset FROM w), expected)
SELECT coalesce(w.preset, x.preset) AS preset, coalesce(w.component, x.component) AS component, CASE WHEN x.preset IS NULL THEN 'unexpected' WHEN w.weight IS NULL THEN 'missing' ELSE 'negative' END AS problem
FROM w FULL JOIN wanted x ON w.preset = x.preset AND w.component = x.component WHERE x.preset IS NULL OR w.weight IS NULL OR w.weight < 0
UNION ALL SELECT preset, NULL, 'no weight' FROM w GROUP BY preset HAVING NOT sum(weight) > 0""")
def validate_weights(spark, sf_dir):
    o = b.table(spark, sf_dir, "orders")
    w = o.groupBy(F.col("o_orderpriority").alias("preset"), F.concat(F.lit("p"), (F.col("o_orderkey") % 7).cast("string")).alias("component")).agg(F.sum((F.col("o_orderkey") % 11) - 5).cast("double").alias("weight"))
    return cost.weight_violations(w, spark.range(6).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("component")))


@R.query(f"WITH {b.SURFACE} SELECT preset, row, col, round(CASE WHEN isinf(cost) THEN -1.0 ELSE cost END, 6) AS cost FROM surface")
def cost_combine(spark, sf_dir):
    return b.surface(spark, sf_dir).withColumn("cost", F.round(F.when(F.col("cost") == float("inf"), -1.0).otherwise(F.col("cost")), 6))


@R.query("""WITH l AS (SELECT DISTINCT o_orderpriority AS component, (o_orderkey % 40)::INT AS row, (o_custkey % (CASE WHEN o_orderpriority LIKE '1%' THEN 9 ELSE 8 END))::INT AS col FROM orders WHERE o_orderpriority NOT LIKE '2%' OR o_orderkey % 40 <> 7 OR o_custkey % 8 <> 3),
s AS (SELECT component, count(*) AS cells, max(row) + 1 AS rows, max(col) + 1 AS cols FROM l GROUP BY component), u AS (SELECT rows, cols FROM s GROUP BY ALL ORDER BY count(*) DESC, rows, cols LIMIT 1)
SELECT component, cells, s.rows, s.cols FROM s, u WHERE cells <> s.rows * s.cols OR s.rows <> u.rows OR s.cols <> u.cols""")
def grid_shape_check(spark, sf_dir):
    o = b.table(spark, sf_dir, "orders").filter("o_orderpriority not like '2%' or o_orderkey % 40 <> 7 or o_custkey % 8 <> 3")
    wide = F.when(F.col("o_orderpriority").startswith("1"), 9).otherwise(8)
    return cost.shape_violations(o.select(F.col("o_orderpriority").alias("component"), (F.col("o_orderkey") % 40).cast("int").alias("row"), (F.col("o_custkey") % wide).cast("int").alias("col")).distinct())


@R.query(f"WITH {b.SURFACE}, {b.EDGES} SELECT row, col, to_row, to_col, round(weight, 6) AS weight FROM edges")
def edges_8n(spark, sf_dir):
    return routing.edges_8n(b.surface(spark, sf_dir, ["balanced"])).withColumn("weight", F.round("weight", 6))


@R.query(f"{b.DISTANCES} SELECT row, col, round(distance, 6) AS distance FROM dist")
def least_cost_distance(spark, sf_dir):
    return routing.tile_distances(b.surface(spark, sf_dir, ["balanced"]), b.START).withColumn("distance", F.round("distance", 6))


@R.query(f"{b.DISTANCES} SELECT 'balanced' AS preset, round(distance, 6) AS route_cost FROM dist WHERE row = {b.N - 1} AND col = {b.N - 1}")
def least_cost_path(spark, sf_dir):
    r = routing.route_groups(b.surface(spark, sf_dir, ["balanced"]), b.START, b.GOAL)
    return r.groupBy("preset").agg(F.round(F.max("route_cost"), 6).alias("route_cost"))


@R.query(f"{b.ALL_DISTANCES} SELECT preset, round(distance, 6) AS route_cost, 0 AS illegal_steps FROM dist WHERE row = {b.N - 1} AND col = {b.N - 1}")
def preset_route_costs(spark, sf_dir):
    """The cost of each preset's route, and its steps that the grid does not allow; cells depend on ties, these do not."""
    surface = b.surface(spark, sf_dir)
    found = routing.route_groups(surface, b.START, b.GOAL)
    costs = found.groupBy("preset").agg(F.round(F.max("route_cost"), 6).alias("route_cost"))
    return costs.join(routing.illegal_steps(found, surface), "preset")


@R.query(f"{b.ALL_DISTANCES} SELECT preset, round(distance, 6) AS route_cost, 0 AS illegal_steps FROM dist WHERE row = {b.N - 1} AND col = {b.N - 1}")
def tiled_route_costs(spark, sf_dir):
    """The routes of all presets found over tiles of eight cells: their costs, and steps that the grid does not allow."""
    surface = b.surface(spark, sf_dir)
    found = routing.tile_routes(surface, b.START, b.GOAL, 8)
    costs = found.groupBy("preset").agg(F.round(F.max("route_cost"), 6).alias("route_cost"))
    return costs.join(routing.illegal_steps(found, surface), "preset")


@R.query()
def preset_routes(spark, sf_dir):
    """Paths of all presets at once; ties are settled by search order, so there is no SQL for the cells."""
    return routing.route_groups(b.surface(spark, sf_dir), b.START, b.GOAL).withColumn("route_cost", F.round("route_cost", 6))


@R.query(f"WITH {b.WIDE} SELECT row, col, round(slope, 6) AS slope, round(terrain, 6) AS terrain FROM wide")
def slope_gradient(spark, sf_dir):
    return b.wide(spark, sf_dir).select("row", "col", F.round("slope", 6).alias("slope"), F.round("terrain", 6).alias("terrain"))


@R.query(f"WITH {b.WIDE} SELECT row, col, hydrography FROM wide")
def hydro_mask_max(spark, sf_dir):
    return b.cells(spark, sf_dir).select("row", "col", F.greatest("hydro_area", "hydro_line").alias("hydrography"))


@R.query(f"WITH {b.WIDE} SELECT row, col, native_vegetation FROM wide")
def vegetation_mask(spark, sf_dir):
    return b.cells(spark, sf_dir).select("row", "col", grid.vegetation_mask(F.col("value")).alias("native_vegetation"))


@R.query(f"WITH {b.WIDE} SELECT count(*) AS cells, count(elevation) AS heights, count(*) FILTER (closed) AS unavailable, count(*) FILTER (NOT closed AND native_vegetation > 0) AS vegetation, round(min(slope) FILTER (NOT closed), 6) AS min_slope, round(max(slope) FILTER (NOT closed), 6) AS max_slope FROM wide")
def grid_diagnostics(spark, sf_dir):
    x = b.wide(spark, sf_dir).withColumnsRenamed({"closed": "unavailable", "native_vegetation": "vegetation"})
    return grid.diagnostics(x).withColumns({c: F.round(c, 6) for c in ("min_slope", "max_slope")})


@R.query(f"WITH {b.CELLS} SELECT count(DISTINCT value) AS classes, count(*) FILTER (value = 65535) AS nodata, count(*) FILTER (value <> 65535) AS valid, round(count(*) FILTER (value <> 65535) / count(*), 9) AS valid_share FROM cells")
def raster_pixel_stats(spark, sf_dir):
    return grid.pixel_stats(b.cells(spark, sf_dir)).withColumn("valid_share", F.round("valid_share", 9))


@R.query(f"WITH {b.CELLS} SELECT DISTINCT value FROM cells WHERE value <> 65535 AND value NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 9)")
def class_domain_check(spark, sf_dir):
    return outside_domain(b.cells(spark, sf_dir), b.table(spark, sf_dir, "nation").filter("n_nationkey < 9").select(F.col("n_nationkey").alias("value")))


_BOX = f"box AS (SELECT min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM ({PLACES}))"
_CORNERS = f"{_BOX}, corners AS (SELECT 0 AS id, west AS lon, south AS lat FROM box UNION ALL SELECT 0, west, north FROM box UNION ALL SELECT 0, east, south FROM box UNION ALL SELECT 0, east, north FROM box)"


@R.query(f"""WITH {_CORNERS}, {sql_geo.transverse_mercator('corners')}, f AS (SELECT floor(min(x) / 100) AS w, floor(min(y) / 100) AS s, ceil(max(x) / 100) AS e, ceil(max(y) / 100) AS n FROM tm)
SELECT (n - s)::INT AS rows, (e - w)::INT AS cols, ((n - s) * (e - w))::INT AS cells, w * 100 AS west, n * 100 AS north FROM f""")
def grid_generate(spark, sf_dir):
    """The grid of 100 m cells over all places, and its cells counted one by one."""
    frame = grid.grid_frame(spark, envelope(spark, sf_dir), 100.0, TM)
    n = grid.all_cells(frame).agg(F.count("*").cast("int").alias("cells"))
    return frame.select("rows", "cols", F.col("x1").cast("double").alias("west"), F.col("y2").cast("double").alias("north")).crossJoin(n)  # one row each


_TX, _TY = TM.forward_sql("lon", "lat")
_LX, _LY = LCC.forward_sql("lon", "lat")


@R.query(f"WITH places AS ({PLACES}), {sql_geo.transverse_mercator('places')} SELECT id, round(x, 3) AS x, round(y, 3) AS y FROM tm")
def project_tm(spark, sf_dir):
    x, y = columns((_TX, _TY))
    return places(spark, sf_dir).select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@R.query(f"WITH places AS ({PLACES}), {sql_geo.lambert_conic('places')} SELECT id, round(x, 3) AS x, round(y, 3) AS y FROM lcc")
def project_lcc(spark, sf_dir):
    x, y = columns((_LX, _LY))
    return places(spark, sf_dir).select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


WEST, NORTH = 290_000.0, 6_430_000.0


@R.query(f"WITH places AS ({PLACES}), {sql_geo.transverse_mercator('places')} SELECT id, floor(({NORTH} - y) / 100)::INT AS row, floor((x - {WEST}) / 100)::INT AS col FROM tm")
def endpoint_cell(spark, sf_dir):
    x, y = columns((_TX, _TY))
    row, col = grid.cell_of(x, y, WEST, NORTH, 100.0)
    return places(spark, sf_dir).select("id", row.alias("row"), col.alias("col"))


@R.query(f"WITH places AS ({PLACES}), {sql_geo.transverse_mercator('places')} SELECT id, round(sqrt(power((x - {WEST}) - 100 * floor((x - {WEST}) / 100) - 50, 2) + power(({NORTH} - y) - 100 * floor(({NORTH} - y) / 100) - 50, 2)), 3) AS offset_m FROM tm")
def snap_offset(spark, sf_dir):
    x, y = columns((_TX, _TY))
    p = places(spark, sf_dir).select("id", x.alias("x"), y.alias("y"))
    cx, cy = grid.centre_of(*grid.cell_of(F.col("x"), F.col("y"), WEST, NORTH, 100.0), WEST, NORTH, 100.0)
    return p.select("id", F.round(F.hypot(F.col("x") - cx, F.col("y") - cy), 3).alias("offset_m"))


@R.query(f"WITH {b.WALKS} SELECT preset, step, ({WEST} + (col + 0.5) * 100)::DOUBLE AS x, ({NORTH} - (row + 0.5) * 100)::DOUBLE AS y FROM walks")
def cell_centre(spark, sf_dir):
    """Centres of the cells that the customers' routes pass."""
    x, y = grid.centre_of(F.col("row"), F.col("col"), WEST, NORTH, 100.0)
    return b.walks(spark, sf_dir).select("preset", "step", x.alias("x"), y.alias("y"))


_LON, _LAT = TM.inverse_sql("x", "y")


@R.query(f"WITH {b.WALKS}, c AS (SELECT preset, step, ({WEST} + (col + 0.5) * 100)::DOUBLE AS x, ({NORTH} - (row + 0.5) * 100)::DOUBLE AS y FROM walks), {sql_geo.inverse_transverse_mercator('c')} SELECT preset, step, round(lon, 7) AS lon, round(lat, 7) AS lat FROM lonlat")
def cell_lonlat(spark, sf_dir):
    lon, lat = columns((_LON, _LAT))
    return cell_centre(spark, sf_dir).select("preset", "step", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


@R.query("""WITH t AS (SELECT 'tile' || (l_suppkey % 5) AS path, (l_orderkey % 60)::INT AS row, (l_partkey % 60)::INT AS col, min(CASE WHEN l_quantity < 4 THEN -32767.0 ELSE l_extendedprice END) AS value FROM lineitem GROUP BY ALL)
SELECT row, col, arg_min(value, path) AS value FROM t WHERE value <> -32767 GROUP BY ALL""")
def mosaic_first_valid(spark, sf_dir):
    li = b.table(spark, sf_dir, "lineitem")
    t = li.groupBy(F.concat(F.lit("tile"), (F.col("l_suppkey") % 5).cast("string")).alias("path"), (F.col("l_orderkey") % 60).cast("int").alias("row"), (F.col("l_partkey") % 60).cast("int").alias("col")).agg(F.min(F.when(F.col("l_quantity") < 4, -32767.0).otherwise(F.col("l_extendedprice"))).alias("value"))
    return grid.mosaic(t)


_TARGETS = "targets AS (SELECT (r // 40)::INT AS row, (r % 40)::INT AS col, (r // 40) * 0.55 + 0.3 AS y, (r % 40) * 0.55 + 0.2 AS x FROM range(1600) t(r))"


def _targets(spark):
    i = F.col("id")
    r, c = F.floor(i / 40).cast("int"), (i % 40).cast("int")
    return spark.range(1600).select(r.alias("row"), c.alias("col"), (r * F.lit(0.55) + F.lit(0.3)).alias("y"), (c * F.lit(0.55) + F.lit(0.2)).alias("x"))


@R.query(f"WITH {b.CELLS}, {_TARGETS} SELECT t.row, t.col, c.value FROM targets t LEFT JOIN cells c ON c.row = floor(y) AND c.col = floor(x)")
def resample_nearest(spark, sf_dir):
    return grid.resample_nearest(b.cells(spark, sf_dir).select("row", "col", "value"), _targets(spark))


@R.query(f"""WITH {b.CELLS}, {_TARGETS}, f AS (SELECT row, col, floor(y - 0.5) + a AS sr, floor(x - 0.5) + b AS sc,
  (CASE a WHEN 1 THEN y - 0.5 - floor(y - 0.5) ELSE 1 - (y - 0.5 - floor(y - 0.5)) END) * (CASE b WHEN 1 THEN x - 0.5 - floor(x - 0.5) ELSE 1 - (x - 0.5 - floor(x - 0.5)) END) AS w
  FROM targets, (VALUES (0), (1)) p(a), (VALUES (0), (1)) q(b))
SELECT f.row, f.col, round((sum(w * elevation) / sum(w))::DOUBLE, 6) AS value FROM f JOIN cells c ON c.row = sr AND c.col = sc WHERE w > 0 GROUP BY ALL""")
def resample_bilinear(spark, sf_dir):
    return grid.resample_bilinear(b.cells(spark, sf_dir).select("row", "col", F.col("elevation").alias("value")), _targets(spark)).withColumn("value", F.round("value", 6))


@R.query(f"""WITH {b.CELLS}, w AS (SELECT row - 2 AS r, col - 3 AS c, value FROM cells WHERE row BETWEEN 2 AND 20 AND col BETWEEN 3 AND 22)
SELECT (r // 3)::INT AS row, (c // 3)::INT AS col, value FROM w WHERE r % 3 = least(1, 18 - (r - r % 3)) AND c % 3 = least(1, 19 - (c - c % 3))""")
def raster_window_nearest(spark, sf_dir):
    return grid.window_nearest(b.cells(spark, sf_dir), 2, 3, 19, 20, 3)


@R.query(f"""WITH {b.LINES}, boxes AS (SELECT x1, y1, x2, y2, r::INT AS row, c::INT AS col, c * 60.0 AS bx1, 1200 - (r + 1) * 60.0 AS by1, (c + 1) * 60.0 AS bx2, 1200 - r * 60.0 AS by2 FROM segments, range(20) a(r), range(20) k(c)
  WHERE greatest(x1, x2) >= c * 60 AND least(x1, x2) <= (c + 1) * 60 AND greatest(y1, y2) >= 1200 - (r + 1) * 60 AND least(y1, y2) <= 1200 - r * 60),
s AS (SELECT row, col, list_transform([[bx1, by1], [bx1, by2], [bx2, by1], [bx2, by2]], lambda p: (x2 - x1) * (p[2] - y1) - (y2 - y1) * (p[1] - x1)) AS k FROM boxes)
SELECT DISTINCT row, col FROM s WHERE list_min(k) <= 0 AND list_max(k) >= 0""")
def rasterize_all_touched(spark, sf_dir):
    return grid.burn(b.segments(spark, sf_dir), 0.0, 1200.0, 60.0, 20, 20)


@R.query(f"WITH {b.WIDE} SELECT row, col, closed, " + ", ".join(f"round({c}, 6) AS {c}" for c in cost.COMPONENTS) + " FROM wide")
def grid_bundle(spark, sf_dir):
    return b.wide(spark, sf_dir).select("row", "col", "closed", *(F.round(c, 6).alias(c) for c in cost.COMPONENTS))


@R.query(f"WITH {b.LAYERS} SELECT component, row, col, round(value, 6) AS value FROM layers")
def grid_explode(spark, sf_dir):
    """A bundle with one nested array for each component, opened into cells."""
    from ..sources.bundles import explode_grids

    x = b.layers(spark, sf_dir)
    rows = x.groupBy("component", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda k: k["value"]).alias("line"))
    bundle = rows.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda k: k["line"]).alias("grid"))
    return explode_grids(bundle).withColumn("value", F.round("value", 6))


@R.query(f"""WITH {_BOX}, n AS (SELECT *, ceil((east - west) / 0.25 - 1e-9)::INT AS nx, ceil((north - south) / 0.25 - 1e-9)::INT AS ny FROM box), t AS (SELECT *, unnest(range(nx * ny)) AS i FROM n)
SELECT i::INT AS tile, round(west + (i % nx) * 0.25, 9) AS west, round(south + (i // nx) * 0.25, 9) AS south, round(least(east, west + (i % nx + 1) * 0.25), 9) AS east, round(least(north, south + (i // nx + 1) * 0.25), 9) AS north FROM t""")
def tile_envelopes(spark, sf_dir):
    """Quarter-degree tiles of the box of all places."""
    return grid.tile_envelopes(envelope(spark, sf_dir), 0.25).withColumns({c: F.round(c, 9) for c in ("west", "south", "east", "north")})


@R.query(f"""WITH {_BOX} SELECT lat::INT AS lat, lon::INT AS lon, 'Copernicus_DSM_COG_10_' || CASE WHEN lat < 0 THEN 'S' ELSE 'N' END || lpad(abs(lat)::VARCHAR, 2, '0') || '_00_' || CASE WHEN lon < 0 THEN 'W' ELSE 'E' END || lpad(abs(lon)::VARCHAR, 3, '0') || '_00_DEM' AS tile_id
FROM box, range(-90, 90) a(lat), range(-180, 180) b(lon) WHERE lat < north AND lat + 1 > south AND lon < east AND lon + 1 > west""")
def dem_tile_ids(spark, sf_dir):
    """Height tiles under the box of all places."""
    return grid.dem_tile_ids(envelope(spark, sf_dir))
