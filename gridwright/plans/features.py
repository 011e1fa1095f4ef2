"""Queries over features: attributes, geometry, spatial joins, export contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import display_name as first_name
from ..functions.scalar import is_major_road
from ..operators import checks, grid, vector
from ..operators.assess import in_order
from ..sources.assets import asset_violations
from . import bindings as b
from .registry import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql


def _attributes(spark, sf_dir):
    """Features of the parts: attribute names differ in case, some lack an id or a name."""
    k = F.col("p_partkey")
    entries = F.array(
        F.struct(F.when(k % 2 == 0, "OBJECTID").otherwise("ObjectId").alias("key"), F.when(k % 13 == 0, "n/a").otherwise(k.cast("string")).alias("value")),
        F.struct(F.when(k % 3 == 0, "RoadNameBase").otherwise("NAME").alias("key"), F.when(k % 5 != 0, F.col("p_name")).alias("value")),
        F.struct(F.lit("FunctionHierarchy").alias("key"), (F.col("p_size") % 9).cast("string").alias("value")),
        F.struct(F.lit("Other").alias("key"), F.col("p_brand").alias("value")))
    return b.table(spark, sf_dir, "part").select(k.alias("id"), F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("attributes"))


@R.query("SELECT p_partkey AS id, CASE WHEN p_partkey % 13 <> 0 THEN p_partkey END AS object_id, CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 3 = 0 THEN p_name END AS name, (p_size % 9)::VARCHAR AS hierarchy FROM part")
def canonical_features(spark, sf_dir):
    x = vector.canonical_features(_attributes(spark, sf_dir), "roads")
    return x.select("id", "object_id", F.col("properties")["name"].alias("name"), F.col("properties")["hierarchy"].alias("hierarchy"))


@R.query("""SELECT p_partkey AS id, array_to_string(list_filter(['functionhierarchy=' || (p_size % 9), CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 3 = 0 THEN 'roadnamebase=' || p_name END], lambda x: x IS NOT NULL), '|') AS kept FROM part""")
def compact_attributes(spark, sf_dir):
    x = vector.compact_attributes(_attributes(spark, sf_dir), vector.COMPACT["roads"])
    return x.select("id", F.array_join(F.array_sort(F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|").alias("kept"))


@R.query("SELECT p_partkey AS id, p_size % 9 <= 4 AS major FROM part")
def major_road_flag(spark, sf_dir):
    return _attributes(spark, sf_dir).select("id", is_major_road(F.col("attributes")["FunctionHierarchy"]).alias("major"))


@R.query("SELECT p_partkey AS id, coalesce(nullif(trim(CASE WHEN p_partkey % 4 = 0 THEN '  ' WHEN p_partkey % 4 = 1 THEN ' ' || p_name END), ''), nullif(trim(CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE '' END), ''), p_partkey::VARCHAR) AS shown FROM part")
def display_name(spark, sf_dir):
    k = F.col("p_partkey")
    road = F.when(k % 4 == 0, "  ").when(k % 4 == 1, F.concat(F.lit(" "), "p_name"))
    return b.table(spark, sf_dir, "part").select(k.alias("id"), first_name(road, F.when(k % 3 == 0, F.col("p_brand")).otherwise(""), k.cast("string")).alias("shown"))


@R.query("""SELECT event_id, '{"event":' || event_id || ',"props":' || replace(replace(props, ' ', ''), '\n', '') || ',"deep":{"keep":[{"id":' || event_id || '}]}}' AS document FROM events""")
def strip_private_keys(spark, sf_dir):
    e = b.table(spark, sf_dir, "events")
    doc = F.concat(F.lit('{"event":'), F.col("event_id").cast("string"), F.lit(',"source":"s","props":'), F.col("props"), F.lit(',"deep":{"raster_path":"/x","keep":[{"id":'), F.col("event_id").cast("string"), F.lit(',"cache_path":1}]}}'))
    return e.select("event_id", vector.strip_private(doc).alias("document"))


@R.query("SELECT o_orderkey AS id, o_orderkey % 4 = 0 AND o_orderkey % 3 <> 0 OR o_orderkey % 4 = 1 AND o_orderkey % 5 <> 0 OR o_orderkey % 4 = 2 AND o_orderkey % 7 <> 0 AS complete FROM orders")
def geometry_member_check(spark, sf_dir):
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*(F.lit(x) for x in ("polyline", "polygon", "point", "curve"))), (k % 4 + 1).cast("int"))
    ring = F.array(F.array(F.array(F.lit(0.0), F.lit(0.0))))
    ok = checks.geometry_members(kind, F.when(k % 3 != 0, ring), F.when(k % 5 != 0, ring), F.lit(1.0), F.when(k % 7 != 0, F.lit(1.0)))
    return b.table(spark, sf_dir, "orders").select(k.alias("id"), ok.alias("complete"))


@R.query("SELECT c_custkey AS id, c_custkey % 7 <= 3 AND c_custkey % 5 <= 2 AND 10 + c_custkey % 11 >= 12 AND 10 + c_custkey % 13 >= 15 AS holds FROM customer")
def bbox_contains(spark, sf_dir):
    k = F.col("c_custkey")
    outer = ((k % 7).cast("double"), (k % 5).cast("double"), (10 + k % 11).cast("double"), (10 + k % 13).cast("double"))
    return b.table(spark, sf_dir, "customer").select(k.alias("id"), checks.box_contains(outer, (F.lit(3.0), F.lit(2.0), F.lit(12.0), F.lit(15.0))).alias("holds"))


@R.query("SELECT n_regionkey AS region, min(c_custkey % 90)::DOUBLE AS west, min(c_custkey % 45)::DOUBLE AS south, max(c_custkey % 90)::DOUBLE AS east, max(c_custkey % 45)::DOUBLE AS north FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def bbox_union(spark, sf_dir):
    x, y = (F.col("c_custkey") % 90).cast("double"), (F.col("c_custkey") % 45).cast("double")
    n = b.table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("region"))
    return b.table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("region").agg(F.min(x).alias("west"), F.min(y).alias("south"), F.max(x).alias("east"), F.max(y).alias("north"))


@R.query(f"WITH {b.LINES} SELECT id, seq, x1, y1, x2, y2 FROM segments")
def polyline_segments(spark, sf_dir):
    return b.segments(spark, sf_dir).select("id", F.col("seq").cast("long").alias("seq"), "x1", "y1", "x2", "y2")


def _route_segments(spark):
    r = b.routes(spark)
    x, y = grid.centre_of(F.col("row"), F.col("col"), 0.0, 1200.0, 50.0)
    return r.select("preset", "step", x.alias("x1"), y.alias("y1"), F.lead(x).over(in_order()).alias("x2"), F.lead(y).over(in_order()).alias("y2")).filter("x2 is not null")


@R.query(f"WITH {b.LINES}, {b.ROUTES}, rs AS (SELECT preset, (col + 0.5) * 50 AS px, 1200 - (row + 0.5) * 50 AS py, lead((col + 0.5) * 50) OVER w AS qx, lead(1200 - (row + 0.5) * 50) OVER w AS qy FROM routes WINDOW w AS (PARTITION BY preset ORDER BY step)) SELECT DISTINCT preset, id FROM (FROM rs WHERE qx IS NOT NULL) r, segments s WHERE {b.meet('px,py', 'qx,qy', 'x1,y1', 'x2,y2')}")
def route_feature_intersect(spark, sf_dir):
    return vector.intersecting(_route_segments(spark), b.segments(spark, sf_dir), 150.0)


@R.query(f"WITH {b.LINES}, p AS (SELECT DISTINCT s.id FROM segments s JOIN (SELECT id, seq, x1 AS u1, y1 AS v1, x2 AS u2, y2 AS v2 FROM segments) t ON s.id = t.id AND t.seq > s.seq + 1 WHERE {b.meet('x1,y1', 'x2,y2', 'u1,v1', 'u2,v2')}) SELECT DISTINCT id, id NOT IN (FROM p) AS simple FROM segments")
def line_is_simple(spark, sf_dir):
    s = b.segments(spark, sf_dir)
    crossed = vector.crossings_of_itself(s, "id", 150.0).select("id").distinct().withColumn("c", F.lit(True))
    return s.select("id").distinct().join(crossed, "id", "left").select("id", F.col("c").isNull().alias("simple"))


@R.query("SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN 'preset' WHEN c_custkey % 6 = 1 THEN 'coordinates' ELSE 'metric' END AS problem FROM customer WHERE c_custkey % 6 < 3")
def asset_contract(spark, sf_dir):
    k = F.col("c_custkey")
    line = F.array(F.array(F.lit(1.0), F.lit(2.0)), F.when(k % 6 == 1, F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0))))
    c = b.table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 6 == 0, "other").otherwise("balanced").alias("preset"), line.alias("coordinates"), F.when(k % 6 == 2, F.lit(float("nan"))).otherwise(F.lit(5.0)).alias("length_m"))
    return asset_violations(c)
