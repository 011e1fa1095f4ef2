"""Queries that report on routes from end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import is_major_road
from ..operators import repair, report, routing, vector
from . import bindings as b
from .assessment import _SUMS, _weights
from .registry import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql
_TOP, _CELL = 2400.0, 100.0

#: Features of the customers: a line of one to five cells east, south or diagonally from a cell's centre, every fourth between the centres' lines.
_FEATURES = f"""features AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'roads' ELSE 'railways' END AS component, c_custkey::VARCHAR AS id, c_custkey % 2 = 0 AND c_custkey % 9 <= 4 AS major, c_custkey % 3 AS way,
  ((c_custkey * 7 % {b.N}) + 0.5) * 100 + (CASE WHEN c_custkey % 4 = 0 THEN 50 ELSE 0 END) AS x1, {_TOP} - ((c_custkey * 11 % {b.N}) + 0.5) * 100 AS y1, (c_custkey % 5 + 1) * 100.0 AS run FROM customer),
lines AS (SELECT component, id, major, x1, y1, x1 + CASE WHEN way = 1 THEN 0 ELSE run END AS x2, y1 - CASE WHEN way = 0 THEN 0 ELSE run END AS y2 FROM features)"""
# routes' steps against single-segment features: a shared stretch on one line, else a point
_IMPACTS = f"""rs AS (SELECT preset, step, (col + 0.5) * 100 AS ax, {_TOP} - (row + 0.5) * 100 AS ay, lead((col + 0.5) * 100) OVER w AS cx, lead({_TOP} - (row + 0.5) * 100) OVER w AS cy FROM routes WINDOW w AS (PARTITION BY preset ORDER BY step)),
met AS (SELECT *, (cx - ax) * (y1 - ay) = (cy - ay) * (x1 - ax) AND (cx - ax) * (y2 - ay) = (cy - ay) * (x2 - ax) AS together FROM (FROM rs WHERE cx IS NOT NULL) r, lines l WHERE {b.meet('ax,ay', 'cx,cy', 'x1,y1', 'x2,y2')}),
found_lines AS (SELECT preset, component, id, any_value(major) AS major, round(sum(CASE WHEN together THEN sqrt(power(greatest(0, least(greatest(ax, cx), greatest(x1, x2)) - greatest(least(ax, cx), least(x1, x2))), 2) + power(greatest(0, least(greatest(ay, cy), greatest(y1, y2)) - greatest(least(ay, cy), least(y1, y2))), 2)) ELSE 0 END), 3) AS length_m FROM met GROUP BY preset, component, id)"""

#: Areas of the suppliers: rectangles and triangles between cell centres or half-way, every fifth with a square hole.
_AREAS = f"""shapes AS (SELECT s_suppkey AS k, ((s_suppkey * 5 % {b.N}) + 0.5) * 100 + (CASE WHEN s_suppkey % 4 = 0 THEN 50 ELSE 0 END) AS x, {_TOP} - ((s_suppkey * 13 % {b.N}) + 0.5) * 100 AS y, (s_suppkey % 4 + 1) * 100.0 AS w, (s_suppkey % 3 + 1) * 100.0 AS h FROM supplier),
corners AS (SELECT k, 0 AS ring, CASE WHEN k % 3 = 1 THEN [[x, y], [x + w, y], [x, y - h], [x, y]] ELSE [[x, y], [x + w, y], [x + w, y - h], [x, y - h], [x, y]] END AS p FROM shapes
  UNION ALL SELECT k, 1, [[x + 25, y - 25], [x + 75, y - 25], [x + 75, y - 75], [x + 25, y - 75], [x + 25, y - 25]] FROM shapes WHERE k % 5 = 0),
edges AS (SELECT CASE WHEN k % 2 = 0 THEN 'protected_land' ELSE 'hydrography_area' END AS component, k::VARCHAR AS id, p[i][1] AS x1, p[i][2] AS y1, p[i + 1][1] AS x2, p[i + 1][2] AS y2 FROM (SELECT *, unnest(range(1, len(p))) AS i FROM corners))"""
# a step is cut wherever it meets an edge; the middle of each cut lies inside, on an edge, or outside
_AREA_IMPACTS = f"""bounds AS (SELECT component, id, min(least(x1, x2)) AS bx1, max(greatest(x1, x2)) AS bx2, min(least(y1, y2)) AS by1, max(greatest(y1, y2)) AS by2 FROM edges GROUP BY ALL),
near AS (SELECT preset, step, ax, ay, cx, cy, component, id FROM (FROM rs WHERE cx IS NOT NULL) r, bounds WHERE greatest(ax, cx) >= bx1 AND least(ax, cx) <= bx2 AND greatest(ay, cy) >= by1 AND least(ay, cy) <= by2),
pieces AS (SELECT n.*, x1, y1, x2, y2, (cx - ax) * (y2 - y1) - (cy - ay) * (x2 - x1) AS den, {b.meet('ax,ay', 'cx,cy', 'x1,y1', 'x2,y2')} AS meets FROM near n JOIN edges USING (component, id)),
marks AS (SELECT preset, step, component, id, unnest(CASE WHEN NOT meets THEN [0, 1] WHEN den <> 0 THEN [0, 1, ((x1 - ax) * (y2 - y1) - (y1 - ay) * (x2 - x1)) / den]
  ELSE [0, 1, ((x1 - ax) * (cx - ax) + (y1 - ay) * (cy - ay)) / (power(cx - ax, 2) + power(cy - ay, 2)), ((x2 - ax) * (cx - ax) + (y2 - ay) * (cy - ay)) / (power(cx - ax, 2) + power(cy - ay, 2))] END) AS t FROM pieces),
cuts AS (SELECT preset, step, component, id, t, lead(t) OVER (PARTITION BY preset, step, component, id ORDER BY t) AS u FROM (SELECT DISTINCT preset, step, component, id, round(t, 12) AS t FROM marks WHERE t BETWEEN 0 AND 1)),
middles AS (SELECT n.*, t, u, ax + (t + u) / 2 * (cx - ax) AS px, ay + (t + u) / 2 * (cy - ay) AS py FROM cuts JOIN near n USING (preset, step, component, id) WHERE u > t),
held AS (SELECT preset, step, component, id, t, u, sqrt(power(cx - ax, 2) + power(cy - ay, 2)) AS size,
  count(*) FILTER ((y1 > py) <> (y2 > py) AND px < x1 + (py - y1) / (y2 - y1) * (x2 - x1)) % 2 = 1 OR bool_or(abs((x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)) < 1e-6 AND px BETWEEN least(x1, x2) - 1e-9 AND greatest(x1, x2) + 1e-9 AND py BETWEEN least(y1, y2) - 1e-9 AND greatest(y1, y2) + 1e-9) AS within
  FROM middles JOIN edges USING (component, id) GROUP BY ALL),
lengths AS (SELECT preset, component, id, sum((u - t) * size) AS length FROM held WHERE within GROUP BY ALL),
touched AS (SELECT DISTINCT preset, component, id FROM pieces WHERE meets),
found_areas AS (SELECT preset, component, id, NULL::BOOLEAN AS major, round(coalesce(length, 0), 3) AS length_m FROM touched FULL JOIN lengths USING (preset, component, id)),
found AS (FROM found_lines UNION ALL FROM found_areas)"""
_IMPACTS = f"{_IMPACTS}, {_AREAS}, {_AREA_IMPACTS}"


def _lines(spark, sf_dir):
    k = F.col("c_custkey")
    run = (k % 5 + 1) * 100.0
    x = ((k * 7 % b.N) + 0.5) * _CELL + F.when(k % 4 == 0, 50.0).otherwise(0.0)
    y = _TOP - ((k * 11 % b.N) + 0.5) * _CELL
    major = (k % 2 == 0) & is_major_road((k % 9).cast("string"))
    return b.table(spark, sf_dir, "customer").select(F.when(k % 2 == 0, "roads").otherwise("railways").alias("component"), k.cast("string").alias("id"), major.alias("major"), x.alias("x1"), y.alias("y1"),
                                                     (x + F.when(k % 3 == 1, 0.0).otherwise(run)).alias("x2"), (y - F.when(k % 3 == 0, 0.0).otherwise(run)).alias("y2"))


def _rings(spark, sf_dir):
    k = F.col("s_suppkey")
    x = ((k * 5 % b.N) + 0.5) * _CELL + F.when(k % 4 == 0, 50.0).otherwise(0.0)
    y = _TOP - ((k * 13 % b.N) + 0.5) * _CELL
    right, low = x + (k % 4 + 1) * 100.0, y - (k % 3 + 1) * 100.0
    path = lambda *points: F.array(*(F.array(px, py) for px, py in (*points, points[0])))
    outer = F.when(k % 3 == 1, path((x, y), (right, y), (x, low))).otherwise(path((x, y), (right, y), (right, low), (x, low)))
    hole = path((x + 25, y - 25), (x + 75, y - 25), (x + 75, y - 75), (x + 25, y - 75))
    shapes = b.table(spark, sf_dir, "supplier").select(k.alias("id"), F.when(k % 5 == 0, F.array(outer, hole)).otherwise(F.array(outer)).alias("paths"))
    component = F.when(F.col("id") % 2 == 0, "protected_land").otherwise("hydrography_area")
    return vector.polyline_segments(shapes).select(component.alias("component"), F.col("id").cast("string").alias("id"), F.lit(None).cast("boolean").alias("major"), "x1", "y1", "x2", "y2")


def _inventory(spark, sf_dir, route):
    return report.impact_inventory(report.route_segments(route, 0.0, _TOP, _CELL), _lines(spark, sf_dir), 300.0, _rings(spark, sf_dir))


@R.query(f"WITH {b.ROUTES}, {_FEATURES}, {_IMPACTS} SELECT preset, component, id, length_m, (length_m > 0)::INT AS dimension, major FROM found")
def route_impacts(spark, sf_dir):
    """Lines and areas that routes meet, with the shared length; in the order of their ids as text."""
    return _inventory(spark, sf_dir, b.routes(spark))


@R.query(f"WITH {b.ROUTES}, {_FEATURES}, {_IMPACTS} SELECT preset, component, count(*) AS features, round(sum(length_m), 3) AS length_m, count(*) FILTER (major) AS major_roads FROM found GROUP BY ALL")
def route_impact_totals(spark, sf_dir):
    return report.impact_totals(_inventory(spark, sf_dir, b.routes(spark)))


# five kinds of broken rings of the customers, by closed formulas: bow ties, spikes, holes, overlapping rectangles, flat rings
@R.query("""WITH k AS (SELECT c_custkey AS id, c_custkey % 5 AS kind, (c_custkey % 4 + 1) * 100.0 AS w, (c_custkey % 3 + 1) * 100.0 AS h FROM customer)
SELECT id, CASE WHEN kind IN (0, 3) THEN 2 WHEN kind = 4 THEN 0 ELSE 1 END AS parts, (kind = 2)::INT AS holes, CASE kind WHEN 0 THEN w * h / 2 WHEN 1 THEN w * h WHEN 2 THEN w * h - w * h / 16 WHEN 3 THEN 1.5 * w * h ELSE 0 END AS area, CASE WHEN kind = 4 THEN 'empty' END AS problem FROM k""")
def repair_areas(spark, sf_dir):
    """Broken rings repaired: their parts, holes and areas, and what cannot be repaired."""
    k = F.col("c_custkey")
    w, h = (k % 4 + 1) * 100.0, (k % 3 + 1) * 100.0
    x, y = 330_000.0 + k % 97 * 10.0, 6_380_000.0 + k % 89 * 10.0
    path = lambda *points: F.array(*(F.array(x + px * w, y + py * h) for px, py in (*points, points[0])))
    square = ((0, 0), (1, 0), (1, 1), (0, 1))
    rings = (F.when(k % 5 == 0, F.array(path((0, 0), (1, 1), (1, 0), (0, 1))))
        .when(k % 5 == 1, F.array(path((0, 0), (1, 0), (1, 0.5), (3, 0.5), (1, 0.5), (1, 1), (0, 1))))
        .when(k % 5 == 2, F.array(path(*square), path((0.25, 0.25), (0.5, 0.25), (0.5, 0.5), (0.25, 0.5))))
        .when(k % 5 == 3, F.array(path(*square), path(*((a + 0.5, c + 0.5) for a, c in square))))
        .otherwise(F.array(path((0, 0), (1, 0), (0.5, 0)))))
    segments = vector.polyline_segments(b.table(spark, sf_dir, "customer").select(k.alias("id"), rings.alias("paths")))
    found, problems = repair.repair(segments, 150.0)
    return repair.ring_totals(found).select("id", "parts", "holes", F.round("area", 2).alias("area"), F.lit(None).cast("string").alias("problem")).unionByName(problems.select("id", F.lit(0).cast("long").alias("parts"), F.lit(0).cast("long").alias("holes"), F.lit(0.0).alias("area"), "problem"))


def _flat(assessed):
    six = {c: F.round(c, 6) for c in ("length_m", "length_km", "mean_terrain", "max_terrain", "mean_slope", "max_slope", "exposure")}
    deltas = {c: F.round(c, 6) + F.lit(0.0) for c in ("delta_km", "delta_exposure")}
    x = assessed.withColumns(six | deltas | {"terrain_sum": F.round(F.col("component_sums")["terrain"], 6), "road_cells": F.col("component_cells")["roads"], "terrain_exposure": F.round(F.col("exposures")["terrain"], 6)})
    return x.select("preset", "cells", *six, "unavailable_cells", "available", "terrain_sum", "road_cells", "terrain_exposure", "impacts", "impact_length_m", "major_road_crossings", *deltas)


@R.query(_SUMS + f""", {_FEATURES}, {_IMPACTS}, st AS (SELECT *, row - lag(row) OVER w AS dr, col - lag(col) OVER w AS dc FROM routes WINDOW w AS (PARTITION BY preset ORDER BY step)),
len AS (SELECT preset, count(*) AS cells, sum(CASE WHEN abs(dr) + abs(dc) = 2 THEN 100 * sqrt(2.0) WHEN dr IS NOT NULL THEN 100 ELSE 0 END) AS length_m FROM st GROUP BY preset),
sl AS (SELECT preset, avg(terrain) AS mean_terrain, max(terrain) AS max_terrain, avg(slope) AS mean_slope, max(slope) AS max_slope, count(*) FILTER (closed) AS unavailable_cells FROM routes JOIN wide USING (row, col) GROUP BY preset),
ex AS (SELECT preset, sum(total * weight) AS exposure, sum(total) FILTER (component = 'terrain') AS terrain_sum, max(hits) FILTER (component = 'roads' AND hits > 0) AS road_cells, sum(total * weight) FILTER (component = 'terrain') AS terrain_exposure FROM sums LEFT JOIN weights USING (preset, component) GROUP BY preset),
im AS (SELECT preset, count(*) AS impacts, round(sum(length_m), 3) AS impact_length_m, count(*) FILTER (major) AS major_road_crossings FROM found GROUP BY preset),
al AS (SELECT *, length_m / 1000 AS length_km FROM len JOIN sl USING (preset) JOIN ex USING (preset) LEFT JOIN im USING (preset))
SELECT a.preset, a.cells, round(a.length_m, 6) AS length_m, round(a.length_km, 6) AS length_km, round(a.mean_terrain, 6) AS mean_terrain, round(a.max_terrain, 6) AS max_terrain, round(a.mean_slope, 6) AS mean_slope, round(a.max_slope, 6) AS max_slope, round(a.exposure, 6) AS exposure,
  a.unavailable_cells, a.unavailable_cells = 0 AS available, round(a.terrain_sum, 6) AS terrain_sum, a.road_cells, round(a.terrain_exposure, 6) AS terrain_exposure, coalesce(a.impacts, 0) AS impacts, coalesce(a.impact_length_m, 0) AS impact_length_m, coalesce(a.major_road_crossings, 0) AS major_road_crossings,
  round(a.length_km - z.length_km, 6) + 0.0 AS delta_km, round(a.exposure - z.exposure, 6) + 0.0 AS delta_exposure FROM al a LEFT JOIN al z ON z.preset = 'shortest'""")
def assess_routes(spark, sf_dir):
    """The whole assessment of given routes: measures, impacts, comparison with the shortest."""
    return _flat(_assessed(spark, sf_dir, b.routes(spark)))


def _assessed(spark, sf_dir, route):
    return report.assess_routes(route, b.wide(spark, sf_dir), b.layers(spark, sf_dir), _weights(spark), b.N, b.N, _CELL, _inventory(spark, sf_dir, route))


@R.query()
def assess_found_routes(spark, sf_dir):
    """The assessment of the routes that the search finds for every preset; their cells depend on ties, so there is no SQL."""
    found = routing.route_groups(b.surface(spark, sf_dir), b.START, b.GOAL).select("preset", "step", "row", "col")
    return _flat(_assessed(spark, sf_dir, found))


@R.query(f"WITH {b.ROUTES}, m AS (SELECT preset, count(*) AS cells FROM routes GROUP BY preset) SELECT preset, step, row, col, cells FROM routes JOIN m USING (preset)")
def attach_assessments(spark, sf_dir):
    return report.attach_assessments(_assessed(spark, sf_dir, b.routes(spark)).select("preset", "cells"), b.routes(spark))
