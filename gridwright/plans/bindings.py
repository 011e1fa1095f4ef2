"""Grids, layers, routes and features derived from the star-schema tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import cost, grid

N = 24
START, GOAL = (0, 0), (N - 1, N - 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, col and per-cell measures of lineitem: one shuffle on the cell, whole-number sums."""
    li = table(spark, sf_dir, "lineitem")
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("long"))
    a = li.groupBy((F.col("l_orderkey") % N).cast("int").alias("row"), (F.col("l_partkey") % N).cast("int").alias("col")).agg(
        F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("q"), cents("l_discount").alias("d"), cents("l_tax").alias("t"),
        F.count_if(F.col("l_returnflag") == "R").alias("rf"), F.count_if(F.col("l_linestatus") == "O").alias("lo"))
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    return a.select("row", "col", "n", (F.col("q") * 20.0 / F.col("n")).alias("elevation"),
                    F.when(F.col("q") % 97 == 0, 65535).otherwise((F.col("q") % 12).cast("int")).alias("value"),
                    one(F.col("d") > 5 * F.col("n")).alias("protected_land"), one(F.col("t") > 4 * F.col("n")).alias("hydro_area"), one(F.col("rf") * 3 > F.col("n")).alias("hydro_line"),
                    one(F.col("lo") * 2 > F.col("n")).alias("roads"), one(F.col("q") % 5 == 0).alias("railways"),
                    ((F.col("row") * 31 + F.col("col") * 17) % 23 == 5).alias("closed"))


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with slope and the seven components."""
    x = grid.slope(cells(spark, sf_dir))
    return x.withColumns({"length": F.lit(1.0), "terrain": grid.terrain(F.col("slope")), "native_vegetation": grid.vegetation_mask(F.col("value")), "hydrography": F.greatest("hydro_area", "hydro_line")})


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """component, row, col, value."""
    x = wide(spark, sf_dir)
    return x.select("row", "col", F.explode(F.array(*(F.struct(F.lit(c).alias("component"), F.col(c).alias("value")) for c in cost.COMPONENTS))).alias("k")).select("k.component", "row", "col", "k.value")


def surface(spark: SparkSession, sf_dir: str, presets: list[str] | None = None) -> DataFrame:
    """preset, row, col, cost; closed cells are blocked."""
    x = wide(spark, sf_dir)
    chosen = {k: v for k, v in cost.PRESETS.items() if not presets or k in presets}
    return cost.combine(x, cost.preset_table(spark, chosen), x.filter("closed"))


def routes(spark: SparkSession) -> DataFrame:
    """Three fixed routes: the diagonal and the two staircases beside it."""
    s = spark.range(2 * N - 1).select(F.col("id").cast("int").alias("step"))
    a = s.filter(F.col("step") < N).select(F.lit("shortest").alias("preset"), "step", F.col("step").alias("row"), F.col("step").alias("col"))
    half, up = F.floor(F.col("step") / 2).cast("int"), F.floor((F.col("step") + 1) / 2).cast("int")
    b = s.select(F.lit("balanced").alias("preset"), "step", half.alias("row"), up.alias("col"))
    c = s.select(F.lit("environmental").alias("preset"), "step", up.alias("row"), half.alias("col"))
    return a.unionByName(b).unionByName(c)


def walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """preset, step, row, col: a route for each customer, one step an order, to a neighbour or on the spot."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("preset"), "o_orderkey", (F.expr("o_orderkey div 3") % 3 - 1).cast("int").alias("dr"), (F.col("o_orderkey") % 3 - 1).cast("int").alias("dc"))
    w = Window.partitionBy("preset").orderBy("o_orderkey")
    place = lambda c: (N // 2 + F.sum(c).over(w)).cast("int")
    return o.select("preset", (F.row_number().over(w) - 1).alias("step"), place("dr").alias("row"), place("dc").alias("col"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, seq, x1, y1, x2, y2: all events of each user as one line, x from value, y from the order."""
    e = table(spark, sf_dir, "events").filter("value is not null").select("user_id", "event_id", F.round(F.col("value") * 100).cast("long").alias("v"))
    w = Window.partitionBy("user_id").orderBy("event_id", "v")
    ranked = e.withColumn("i", F.row_number().over(w) - 1)
    points = ranked.select(F.col("user_id").alias("id"), "i", (F.col("v") % 1200).cast("double").alias("x"), ((F.col("i").cast("long") * 97 + F.col("user_id") * 13) % 1200).cast("double").alias("y"))
    on = Window.partitionBy("id").orderBy("i")
    return points.select("id", F.col("i").alias("seq"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(on).alias("x2"), F.lead("y").over(on).alias("y2")).filter("x2 is not null")


CELLS = f"""agg AS (
  SELECT (l_orderkey % {N})::INT AS row, (l_partkey % {N})::INT AS col, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS q,
    sum(round(l_discount * 100)::BIGINT)::BIGINT AS d, sum(round(l_tax * 100)::BIGINT)::BIGINT AS t,
    count(*) FILTER (l_returnflag = 'R') AS rf, count(*) FILTER (l_linestatus = 'O') AS lo
  FROM lineitem GROUP BY ALL
), cells AS (
  SELECT row, col, n, q * 20.0::DOUBLE / n AS elevation, CASE WHEN q % 97 = 0 THEN 65535 ELSE (q % 12)::INT END AS value,
    (d > 5 * n)::INT::DOUBLE AS protected_land, (t > 4 * n)::INT::DOUBLE AS hydro_area, (rf * 3 > n)::INT::DOUBLE AS hydro_line,
    (lo * 2 > n)::INT::DOUBLE AS roads, (q % 5 = 0)::INT::DOUBLE AS railways, (row * 31 + col * 17) % 23 = 5 AS closed
  FROM agg
)"""
WIDE = (
    CELLS
    + """, grad AS (
  SELECT *, (coalesce(lead(elevation) OVER r, elevation) - coalesce(lag(elevation) OVER r, elevation)) / (100.0 * CASE WHEN lead(elevation) OVER r IS NULL OR lag(elevation) OVER r IS NULL THEN 1 ELSE 2 END) AS gy,
    (coalesce(lead(elevation) OVER c, elevation) - coalesce(lag(elevation) OVER c, elevation)) / (100.0 * CASE WHEN lead(elevation) OVER c IS NULL OR lag(elevation) OVER c IS NULL THEN 1 ELSE 2 END) AS gx
  FROM cells WINDOW r AS (PARTITION BY col ORDER BY row), c AS (PARTITION BY row ORDER BY col)
), wide AS (
  SELECT *, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope, 1.0::DOUBLE AS length, least(1.0, greatest(0.0, degrees(atan(sqrt(gx * gx + gy * gy))) / 20.0)) AS terrain,
    (value > 0)::INT::DOUBLE AS native_vegetation, greatest(hydro_area, hydro_line) AS hydrography
  FROM grad
)"""
)
LAYERS = WIDE + ", layers AS (" + " UNION ALL ".join(f"SELECT '{c}' AS component, row, col, {c} AS value FROM wide" for c in cost.COMPONENTS) + ")"
PRESET_ROWS = "presets(preset, " + ", ".join(f"w_{c}" for c in cost.COMPONENTS) + ") AS (VALUES " + ", ".join(f"('{p}', {', '.join(f'{x!r}::DOUBLE' for x in w)})" for p, w in cost.PRESETS.items()) + ")"
SURFACE = WIDE + f", {PRESET_ROWS}, surface AS (SELECT preset, row, col, CASE WHEN closed THEN 'inf'::DOUBLE ELSE " + " + ".join(f"{c} * w_{c}" for c in cost.COMPONENTS) + " END AS cost FROM wide, presets)"
ROUTES = f"""routes AS (
  SELECT 'shortest' AS preset, s::INT AS step, s::INT AS row, s::INT AS col FROM range({N}) t(s)
  UNION ALL SELECT 'balanced', s::INT, (s // 2)::INT, ((s + 1) // 2)::INT FROM range({2 * N - 1}) t(s)
  UNION ALL SELECT 'environmental', s::INT, ((s + 1) // 2)::INT, (s // 2)::INT FROM range({2 * N - 1}) t(s)
)"""
WALKS = f"""walks AS (
  SELECT o_custkey AS preset, row_number() OVER w - 1 AS step, ({N // 2} + sum(o_orderkey // 3 % 3 - 1) OVER w)::INT AS row, ({N // 2} + sum(o_orderkey % 3 - 1) OVER w)::INT AS col
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)
)"""
EDGES = """steps AS (SELECT dr, dc FROM (VALUES (-1), (0), (1)) a(dr), (VALUES (-1), (0), (1)) b(dc) WHERE dr <> 0 OR dc <> 0
), free AS (SELECT row, col, cost FROM surface WHERE preset = 'balanced' AND NOT isinf(cost)
), edges AS (
  SELECT f.row, f.col, t.row AS to_row, t.col AS to_col, (f.cost + t.cost) / 2 * CASE WHEN dr <> 0 AND dc <> 0 THEN sqrt(2.0) ELSE 1.0 END AS weight
  FROM free f, steps JOIN free t ON t.row = f.row + dr AND t.col = f.col + dc
  WHERE dr = 0 OR dc = 0 OR (EXISTS (FROM free x WHERE x.row = f.row AND x.col = f.col + dc) AND EXISTS (FROM free y WHERE y.row = f.row + dr AND y.col = f.col))
)"""
DISTANCES = f"""WITH RECURSIVE {SURFACE}, {EDGES}, dist(row, col, distance) USING KEY (row, col) AS (
  SELECT 0, 0, 0.0::DOUBLE
  UNION
  SELECT e.to_row, e.to_col, min(d.distance + e.weight) FROM dist d JOIN edges e ON e.row = d.row AND e.col = d.col
    LEFT JOIN recurring.dist k ON k.row = e.to_row AND k.col = e.to_col
  WHERE k.distance IS NULL OR d.distance + e.weight < k.distance GROUP BY ALL
)"""
# the same for every preset: edges and distances carry it
ALL_DISTANCES = f"""WITH RECURSIVE {SURFACE}, steps AS (SELECT dr, dc FROM (VALUES (-1), (0), (1)) a(dr), (VALUES (-1), (0), (1)) b(dc) WHERE dr <> 0 OR dc <> 0
), free AS (SELECT preset, row, col, cost FROM surface WHERE NOT isinf(cost)
), edges AS (
  SELECT f.preset, f.row, f.col, t.row AS to_row, t.col AS to_col, (f.cost + t.cost) / 2 * CASE WHEN dr <> 0 AND dc <> 0 THEN sqrt(2.0) ELSE 1.0 END AS weight
  FROM free f, steps JOIN free t ON t.preset = f.preset AND t.row = f.row + dr AND t.col = f.col + dc
  WHERE dr = 0 OR dc = 0 OR (EXISTS (FROM free x WHERE x.preset = f.preset AND x.row = f.row AND x.col = f.col + dc) AND EXISTS (FROM free y WHERE y.preset = f.preset AND y.row = f.row + dr AND y.col = f.col))
), dist(preset, row, col, distance) USING KEY (preset, row, col) AS (
  SELECT DISTINCT preset, 0, 0, 0.0::DOUBLE FROM presets
  UNION
  SELECT e.preset, e.to_row, e.to_col, min(d.distance + e.weight) FROM dist d JOIN edges e ON e.preset = d.preset AND e.row = d.row AND e.col = d.col
    LEFT JOIN recurring.dist k ON k.preset = e.preset AND k.row = e.to_row AND k.col = e.to_col
  WHERE k.distance IS NULL OR d.distance + e.weight < k.distance GROUP BY ALL
)"""
LINES = """ordered AS (
  SELECT user_id, event_id, round(value * 100)::BIGINT AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id, round(value * 100)::BIGINT) - 1 AS i FROM events WHERE value IS NOT NULL
), points AS (
  SELECT user_id AS id, i, (v % 1200)::DOUBLE AS x, ((i * 97 + user_id * 13) % 1200)::DOUBLE AS y FROM ordered
), segments AS (
  SELECT id, i AS seq, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM points WINDOW w AS (PARTITION BY id ORDER BY i) QUALIFY lead(x) OVER w IS NOT NULL
)"""


def turn(a: str, b: str, c: str) -> str:
    """SQL: on which side of a to b is c? Points are given as 'x,y'."""
    (ax, ay), (bx, by), (cx, cy) = (p.split(",") for p in (a, b, c))
    return f"sign(({bx} - {ax}) * ({cy} - {ay}) - ({by} - {ay}) * ({cx} - {ax}))"


def meet(a: str, b: str, c: str, d: str) -> str:
    """SQL: do the closed segments ab and cd share a point?"""
    inside = lambda p, q, r: " AND ".join(f"{r.split(',')[i]} BETWEEN least({p.split(',')[i]}, {q.split(',')[i]}) AND greatest({p.split(',')[i]}, {q.split(',')[i]})" for i in (0, 1))
    t1, t2, t3, t4 = turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)
    return f"(({t1} * {t2} < 0 AND {t3} * {t4} < 0) OR ({t1} = 0 AND {inside(a, b, c)}) OR ({t2} = 0 AND {inside(a, b, d)}) OR ({t3} = 0 AND {inside(c, d, a)}) OR ({t4} = 0 AND {inside(c, d, b)}))"
