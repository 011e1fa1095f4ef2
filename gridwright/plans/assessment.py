"""Queries that measure routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assess, cost
from . import bindings as b
from .registry import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql

_WEIGHTS = "weights AS (" + " UNION ALL ".join(f"SELECT '{p}' AS preset, '{c}' AS component, {w!r}::DOUBLE AS weight" for p, ws in cost.PRESETS.items() for c, w in zip(cost.COMPONENTS, ws, strict=True)) + ")"
_SUMS = f"WITH {b.LAYERS}, {b.ROUTES}, {_WEIGHTS}, sums AS (SELECT preset, component, sum(value) AS total, count(*) FILTER (value > 0) AS hits FROM routes JOIN layers USING (row, col) GROUP BY ALL)"


def _weights(spark):
    return spark.createDataFrame([(p, c, w) for p, ws in cost.PRESETS.items() for c, w in zip(cost.COMPONENTS, ws, strict=True)], "preset string, component string, weight double")


def _sums(spark, sf_dir):
    return assess.component_sums(b.routes(spark), b.layers(spark, sf_dir))


@R.query(f"{_SUMS} SELECT preset, component, round(total, 6) AS total FROM sums")
def route_component_sums(spark, sf_dir):
    return _sums(spark, sf_dir).select("preset", "component", F.round("total", 6).alias("total"))


@R.query(f"{_SUMS} SELECT preset, component, hits FROM sums WHERE component <> 'length' AND hits > 0")
def route_component_counts(spark, sf_dir):
    return assess.component_counts(b.routes(spark), b.layers(spark, sf_dir))


@R.query(f"{_SUMS} SELECT preset, component, round(total * weight, 6) AS exposure FROM sums JOIN weights USING (preset, component)")
def weighted_exposure(spark, sf_dir):
    return assess.weighted_exposure(_sums(spark, sf_dir), _weights(spark)).withColumn("exposure", F.round("exposure", 6))


@R.query(f"WITH {b.WIDE}, {b.ROUTES} SELECT preset, round(avg(terrain), 6) AS mean_terrain, round(max(terrain), 6) AS max_terrain, round(avg(slope), 6) AS mean_slope, round(max(slope), 6) AS max_slope FROM routes JOIN wide USING (row, col) GROUP BY preset")
def route_slope_stats(spark, sf_dir):
    out = assess.slope_stats(b.routes(spark), b.wide(spark, sf_dir))
    return out.select("preset", *(F.round(c, 6).alias(c) for c in out.columns if c != "preset"))


_STEPS = f"WITH {b.WALKS}, s AS (SELECT *, row - lag(row) OVER w AS dr, col - lag(col) OVER w AS dc FROM walks WINDOW w AS (PARTITION BY preset ORDER BY step))"


@R.query(f"{_STEPS} SELECT preset, round(coalesce(sum(CASE WHEN abs(dr) + abs(dc) = 2 THEN 100 * sqrt(2.0) ELSE 100 END) FILTER (greatest(abs(dr), abs(dc)) = 1), 0), 3) AS length_m, count(dr) AS steps, count(*) FILTER (greatest(abs(dr), abs(dc)) <> 1) AS bad_steps FROM s GROUP BY preset")
def route_length(spark, sf_dir):
    return assess.route_length(b.walks(spark, sf_dir)).withColumn("length_m", F.round("length_m", 3))


@R.query(f"""{_STEPS}, t AS (SELECT *, lag(dr) OVER w AS pr, lag(dc) OVER w AS pc FROM s WINDOW w AS (PARTITION BY preset ORDER BY step)),
c AS (SELECT preset, count(*) AS cells, count(dr) AS steps, count(*) FILTER (dr <> 0 AND dc <> 0) AS diagonals, count(*) FILTER (pr <> dr OR pc <> dc) AS turns, count(*) FILTER (row IN (0, {b.N - 1}) OR col IN (0, {b.N - 1})) AS border FROM t GROUP BY preset)
SELECT *, round(CASE WHEN steps > 0 THEN diagonals / steps ELSE 0 END, 9) AS diagonal_share, round(turns / greatest(1, steps - 1), 9) AS turn_share, round(border / cells, 9) AS border_share FROM c""")
def direction_quality(spark, sf_dir):
    out = assess.direction_quality(b.walks(spark, sf_dir), b.N, b.N)
    return out.withColumns({c: F.round(c, 9) for c in ("diagonal_share", "turn_share", "border_share")})


@R.query(f"WITH {b.WALKS} SELECT preset, min(col) * 100.0 AS west, {b.N * 100} - (max(row) + 1) * 100.0 AS south, (max(col) + 1) * 100.0 AS east, {b.N * 100} - min(row) * 100.0 AS north FROM walks GROUP BY preset")
def route_boxes(spark, sf_dir):
    """The box of each route, from its cells' outer edges."""
    return assess.route_boxes(b.walks(spark, sf_dir), 0.0, b.N * 100.0, 100.0)


_CLASSES = f"WITH {b.CELLS}, {b.ROUTES}, k AS (SELECT preset, value, count(*) AS cells FROM routes JOIN cells USING (row, col) GROUP BY ALL)"


def _class_counts(spark, sf_dir):
    names = b.table(spark, sf_dir, "nation").filter("n_nationkey < 9").select(F.col("n_nationkey").alias("value"), F.col("n_name").alias("name"))
    return assess.class_counts(b.routes(spark), b.cells(spark, sf_dir), names)


@R.query(f"{_CLASSES} SELECT preset, value, n_name AS name, cells, value > 0 AND value <> 65535 AS native FROM k LEFT JOIN (FROM nation WHERE n_nationkey < 9) ON value = n_nationkey")
def route_class_counts(spark, sf_dir):
    return _class_counts(spark, sf_dir)


@R.query(f"{_CLASSES} SELECT preset, value, cells, row_number() OVER (PARTITION BY preset ORDER BY value)::INT AS place FROM k WHERE value > 0 QUALIFY row_number() OVER (PARTITION BY preset ORDER BY value) <= 6")
def top6_classes(spark, sf_dir):
    return assess.top_classes(_class_counts(spark, sf_dir)).select("preset", "value", "cells", "place")


@R.query(f"{_SUMS}, e AS (SELECT preset, component, total * weight AS exposure FROM sums JOIN weights USING (preset, component)) SELECT a.preset, a.component, round(a.exposure - z.exposure, 6) + 0.0 AS delta FROM e a JOIN e z ON z.preset = 'shortest' AND a.component = z.component")
def baseline_deltas(spark, sf_dir):
    exposure = assess.weighted_exposure(_sums(spark, sf_dir), _weights(spark))
    return assess.baseline_deltas(exposure).withColumn("delta", F.round("delta", 6) + 0.0)


@R.query(f"WITH {b.CELLS}, {b.ROUTES} SELECT preset, step, row, col FROM routes JOIN (FROM cells WHERE closed OR value = 65535) USING (row, col)")
def unavailable_hits(spark, sf_dir):
    x = b.cells(spark, sf_dir)
    return assess.unavailable_hits(b.routes(spark), x.filter("closed or value = 65535")).select("preset", "step", "row", "col")


@R.query("""SELECT o_orderstatus AS preset, o_orderpriority AS component, count(*) AS features, round(sum(round(o_totalprice::DECIMAL(18, 4), 1)), 1)::DOUBLE AS length_m, count(*) FILTER (o_custkey % 9 <= 4) AS major_roads FROM orders GROUP BY ALL""")
def inventory_totals(spark, sf_dir):
    from ..functions.scalar import is_major_road

    o = b.table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("preset"), F.col("o_orderpriority").alias("component"), F.round(F.col("o_totalprice").cast("decimal(18,4)"), 1).alias("length_m"), is_major_road((F.col("o_custkey") % 9).cast("string")).alias("major"))
    return assess.inventory_totals(o).withColumn("length_m", F.round("length_m", 1).cast("double"))
