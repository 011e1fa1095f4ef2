"""Reports on routes from end to end: impacts on features, one row of measures a route, comparison, provenance.

Routes are few but may be long; every measure is a grouped aggregate over steps, and features meet
routes by grid buckets, so neither a route nor a layer is gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import segments_meet
from . import assess
from .grid import centre_of
from .vector import bucketed


def route_segments(route: DataFrame, west: float, north: float, cell: float) -> DataFrame:
    """preset, step, x1, y1, x2, y2 between the centres of a route's cells."""
    x, y = centre_of(F.col("row"), F.col("col"), west, north, cell)
    w = assess.in_order()
    return route.select("preset", "step", x.alias("x1"), y.alias("y1"), F.lead(x).over(w).alias("x2"), F.lead(y).over(w).alias("y2")).filter("x2 is not null")


#: Two places are on one line if they are no farther from it than this share of a step's length.
ON_LINE = 1e-9


def _step(prefix: str = "r"):
    """Start, direction, squared size, and for a place its distance from the step's line (times the size, 0 if it is on it) and its share of the step."""
    ax, ay, bx, by = (F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy

    def side(x: Column, y: Column) -> Column:
        k = dx * (y - ay) - dy * (x - ax)
        return F.when(F.abs(k) <= ON_LINE * size, F.lit(0.0)).otherwise(k)

    return size, side, lambda x, y: ((x - ax) * dx + (y - ay) * dy) / size


def _held(t: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))


def _covered(parts: Column) -> Column:
    """Length of the union of stretches(a, b), sorted by a."""
    start = F.struct(F.lit(0.0).alias("end"), F.lit(0.0).alias("sum"))
    grow = lambda s, p: F.struct(F.greatest(s["end"], p["b"]).alias("end"), (s["sum"] + F.greatest(F.lit(0.0), p["b"] - F.greatest(s["end"], p["a"]))).alias("sum"))
    return F.aggregate(parts, start, grow, lambda s: s["sum"])


def _measured(parts: DataFrame) -> DataFrame:
    """preset, id, length_m, dimension of parts(preset, id, step, size, parts): 1 with a length in millimetres, else 0 (points only)."""
    out = parts.select("preset", "id", (_covered(F.col("parts")) * F.col("size")).alias("length")).groupBy("preset", "id").agg(F.round(F.sum("length"), 3).alias("length_m"))
    return out.withColumn("dimension", F.when(F.col("length_m") > 0, 1).otherwise(0))


def crossings(segments: DataFrame, features: DataFrame, size: float) -> DataFrame:
    """preset, id, length_m, dimension of route segments(preset, step, ...) and feature segments(id, x1, y1, x2, y2) that meet.

    Where segments lie on one line, the stretch that they share counts, and stretches of a step that overlap
    count once; dimension is 1 with such a length, else 0 (points only)."""
    r = bucketed(segments, size).select("preset", "step", "bx", "by", *(F.col(c).alias(f"r{c}") for c in ("x1", "y1", "x2", "y2")))
    f = bucketed(features, size).select("id", "bx", "by", "x1", "y1", "x2", "y2")
    ours, theirs = (tuple(F.col(f"{p}{c}") for c in ("x1", "y1", "x2", "y2")) for p in ("r", ""))
    squared, side, at = _step()
    t1, t2 = at(theirs[0], theirs[1]), at(theirs[2], theirs[3])
    on_line = (side(theirs[0], theirs[1]) == 0) & (side(theirs[2], theirs[3]) == 0)
    beside = on_line & (F.least(t1, t2) <= 1) & (F.greatest(t1, t2) >= 0)
    met = r.join(f, ["bx", "by"]).filter(segments_meet(ours, theirs) | beside)
    shared = F.when(on_line, F.struct(_held(F.least(t1, t2)).alias("a"), _held(F.greatest(t1, t2)).alias("b")))
    parts = met.select("preset", "id", "step", F.sqrt(squared).alias("size"), shared.alias("part")).groupBy("preset", "id", "step").agg(F.first("size").alias("size"), F.array_sort(F.collect_set("part")).alias("parts"))
    return _measured(parts)


def area_crossings(segments: DataFrame, areas: DataFrame, size: float) -> DataFrame:
    """preset, id, length_m, dimension of route segments(preset, step, ...) that meet closed areas of ring segments(id, x1, y1, x2, y2).

    What is inside follows from the crossings of a step's line with all rings of an area (even-odd, a line along a
    ring counted on one side); stretches along a ring are added, so an area's edge belongs to it. Steps that only
    touch an area have dimension 0."""
    box = {"x1": F.min(F.least("x1", "x2")), "y1": F.min(F.least("y1", "y2")), "x2": F.max(F.greatest("x1", "x2")), "y2": F.max(F.greatest("y1", "y2"))}
    boxes = areas.groupBy("id").agg(*(v.alias(k) for k, v in box.items()))
    r = bucketed(segments, size).select("preset", "step", "bx", "by", *(F.col(c).alias(f"r{c}") for c in ("x1", "y1", "x2", "y2")))
    near = (F.greatest("rx1", "rx2") >= F.col("x1")) & (F.least("rx1", "rx2") <= F.col("x2")) & (F.greatest("ry1", "ry2") >= F.col("y1")) & (F.least("ry1", "ry2") <= F.col("y2"))
    pairs = r.join(bucketed(boxes, size), ["bx", "by"]).filter(near).select("preset", "step", "id", "rx1", "ry1", "rx2", "ry2").distinct()
    squared, side, at = _step()
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    edges = pairs.join(areas, "id").withColumns({"a": side(x1, y1), "b": side(x2, y2), "t1": at(x1, y1), "t2": at(x2, y2)})
    k = F.try_divide(F.col("a"), F.col("a") - F.col("b"))
    crossing = F.when((F.col("a") < 0) != (F.col("b") < 0), F.col("t1") + k * (F.col("t2") - F.col("t1")))
    along = (F.col("a") == 0) & (F.col("b") == 0)
    stretch = F.when(along & (F.least("t1", "t2") <= 1) & (F.greatest("t1", "t2") >= 0), F.struct(_held(F.least("t1", "t2")).alias("a"), _held(F.greatest("t1", "t2")).alias("b")))
    # where an edge's line meets the step: crossed, or touched at an end
    touch = stretch.isNotNull() | (~along & (F.col("a") * F.col("b") <= 0) & (F.col("t1") + k * (F.col("t2") - F.col("t1"))).between(0, 1))
    by_step = edges.select("preset", "id", "step", F.sqrt(squared).alias("size"), crossing.alias("t"), stretch.alias("part"), touch.alias("touch")).groupBy("preset", "id", "step").agg(
        F.first("size").alias("size"), F.array_sort(F.collect_list("t")).alias("ts"), F.collect_list("part").alias("along"), F.bool_or(F.coalesce("touch", F.lit(False))).alias("touch"))
    inside = F.when(F.size("ts") > 1, F.transform(F.sequence(F.lit(0), F.floor(F.size("ts") / 2).cast("int") - 1), lambda i: F.struct(_held(F.get("ts", i * 2)).alias("a"), _held(F.get("ts", i * 2 + 1)).alias("b")))).otherwise(F.array().cast("array<struct<a:double,b:double>>"))
    parts = by_step.withColumn("parts", F.array_sort(F.concat(inside, "along"))).filter(F.col("touch") | (_covered(F.col("parts")) > 0))
    return _measured(parts)


def impact_inventory(segments: DataFrame, features: DataFrame, size: float, areas: DataFrame | None = None) -> DataFrame:
    """preset, component, id, length_m, dimension, major for line features(component, id, major, x1, y1, x2, y2) and
    areas of the same columns (their ring segments), ids as text in their order.

    An id is one feature of one component."""

    def keyed(rows: DataFrame) -> DataFrame:
        return rows.select(F.struct("component", F.col("id").cast("string").alias("id"), "major").alias("id"), "x1", "y1", "x2", "y2")

    found = crossings(segments, keyed(features), size)
    if areas is not None:
        found = found.unionByName(area_crossings(segments, keyed(areas), size))
    return found.select("preset", "id.component", "id.id", "length_m", "dimension", "id.major").orderBy("preset", "component", "id")


def impact_totals(inventory: DataFrame) -> DataFrame:
    """preset, component, features, length_m, major_roads of an inventory."""
    return assess.inventory_totals(inventory)


def assess_routes(route: DataFrame, wide: DataFrame, layers: DataFrame, weights: DataFrame, rows: int, cols: int, cell: float = 100.0, inventory: DataFrame | None = None, baseline: str = "shortest") -> DataFrame:
    """One row a preset of route(preset, step, row, col): size, slopes, availability, directions, sums and exposures by
    component, impacts, and differences from the baseline's route. A step to no neighbour, or a cell without values, fails.

    wide: row, col, terrain, slope, closed; layers: component, row, col, value; weights: preset, component, weight;
    inventory: impact_inventory's rows. Where no route is the baseline, the differences are null."""
    length = assess.route_length(route, cell)
    checked = length.withColumn("length_m", F.when(F.col("bad_steps") == 0, F.col("length_m")).otherwise(F.raise_error(F.lit("route has a step to no neighbour")).cast("double")))
    cells = route.join(wide.select("row", "col", "terrain", F.col("closed")), ["row", "col"], "left").groupBy("preset").agg(
        F.count("*").alias("cells"), F.count_if("closed").alias("unavailable_cells"), F.count_if(F.col("terrain").isNull()).alias("off_grid"))
    cells = cells.withColumn("cells", F.when(F.col("off_grid") == 0, F.col("cells")).otherwise(F.raise_error(F.lit("route leaves the grid")).cast("long"))).drop("off_grid")
    sums = assess.component_sums(route, layers).join(weights, ["preset", "component"], "left")
    by_component = sums.groupBy("preset").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("component", "total")))).alias("component_sums"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when((F.col("component") != "length") & (F.col("hits") > 0), F.struct("component", "hits"))))).alias("component_cells"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("weight").isNotNull(), F.struct("component", (F.col("total") * F.col("weight")).alias("exposure")))))).alias("exposures"),
        F.sum(F.col("total") * F.col("weight")).alias("exposure"))
    out = (checked.select("preset", "length_m", (F.col("length_m") / 1000).alias("length_km"), "steps")
        .join(cells, "preset").join(assess.slope_stats(route, wide), "preset")
        .join(assess.direction_quality(route, rows, cols).select("preset", "diagonal_share", "turn_share", "border_share"), "preset").join(by_component, "preset")
        .withColumn("available", F.col("unavailable_cells") == 0))
    if inventory is not None:
        kinds = impact_totals(inventory).groupBy("preset").agg(F.sum("features").alias("impacts"), F.round(F.sum("length_m"), 3).alias("impact_length_m"), F.sum("major_roads").alias("major_road_crossings"))
        out = out.join(kinds, "preset", "left").fillna(0, ["impacts", "impact_length_m", "major_road_crossings"])
    base = out.filter(F.col("preset") == baseline).select(F.col("length_km").alias("base_km"), F.col("exposure").alias("base_exposure")).limit(1)
    # the baseline is one row
    joined = out.join(F.broadcast(base.withColumn("one", F.lit(1))), F.lit(1) == F.col("one"), "left").drop("one")
    return joined.withColumns({"delta_km": F.col("length_km") - F.col("base_km"), "delta_exposure": F.col("exposure") - F.col("base_exposure")}).drop("base_km", "base_exposure")


def attach_assessments(assessments: DataFrame, route: DataFrame) -> DataFrame:
    """The routes' steps with the measures of their preset; a route that nobody assessed fails the join's check."""
    found = assessments.withColumn("_there", F.lit(True))
    out = route.join(found, "preset", "left")
    return out.withColumn("preset", F.when(F.col("_there"), F.col("preset")).otherwise(F.raise_error(F.lit("route without an assessment")).cast("string"))).drop("_there")


def provenance(spark: SparkSession, path: str, features: Column | None = None) -> DataFrame:
    """artifact_path, artifact_bytes, artifact_sha256 of every file under a path, hashed where it is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    more = [] if features is None else [features.cast("long").alias("source_feature_count")]
    return files.select(F.col("path").alias("artifact_path"), F.col("length").alias("artifact_bytes"), F.sha2("content", 256).alias("artifact_sha256"), *more)


def folder_bytes(spark: SparkSession, path: str) -> DataFrame:
    """bytes, files under a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("length")
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count("*").alias("files"))
