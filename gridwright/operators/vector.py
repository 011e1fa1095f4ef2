"""Features: geometry in arrays, segments, intersections, paged capture."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import segments_meet
from ..functions.scalar import fold_keys, integer_id, near

# Canonical property and the service's attribute, in lower case, for each component.
_WATER = {"name": "hydroname", "name_type": "hydronametype", "perenniality": "perenniality", "hierarchy": "hierarchy", "hydro_type": "hydrotype", "relevance": "relevance"}
ALIASES = {
    "protected_land": {"name": "name", "land_type": "type", "iucn_category": "iucn", "gazetted_area": "gaz_area", "gis_area": "gis_area", "reserve_number": "res_no", "gazetted_date": "gaz_date"},
    "hydrography_line": _WATER,
    "named_watercourse_ss": _WATER,
    "named_watercourse_ls": _WATER,
    "hydrography_area": {k: v for k, v in _WATER.items() if k != "hierarchy"},
    "roads": {"name": "roadnamebase", "name_type": "roadnametype", "hierarchy": "functionhierarchy", "operational_type": "roadontype", "surface": "surface", "lane_count": "lanecount", "operational_status": "operationalstatus", "relevance": "relevance"},
    "railways": {"name": "railwayname", "gauge": "gauge", "operational_type": "railontype", "operational_status": "operationalstatus", "relevance": "relevance"},
}
# Attributes that an inventory keeps.
COMPACT = {
    "protected_land": ["NAME", "NAME_SHORT", "TYPE", "IUCN", "RES_NO"],
    "hydrography_line": ["hydroname", "hydronametype", "perenniality", "hierarchy", "hydrotype", "relevance"],
    "hydrography_area": ["hydroname", "hydronametype", "perenniality", "hydrotype", "relevance"],
    "roads": ["roadnamebase", "roadnametype", "functionhierarchy", "roadontype", "surface", "lanecount", "operationalstatus", "relevance"],
    "railways": ["railwayname", "gauge", "railontype", "operationalstatus", "relevance"],
}
# Attributes that may hold the id, in the order of preference.
ID_NAMES = ["objectid", "object_id", "fid", "id"]
PRIVATE_KEYS = ["source", "artifact_path", "raster_path", "cache_path", "manifest_path"]


def _present(folded, names: dict[str, str]):
    """A map of the named keys of a folded map that are there, nulls included."""
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.element_at(folded, v).alias("value"), F.map_contains_key(folded, v).alias("there")) for k, v in names.items()))
    return F.map_from_entries(F.transform(F.filter(pairs, lambda p: p["there"]), lambda p: F.struct(p["key"], p["value"])))


def canonical_features(features: DataFrame, component: str) -> DataFrame:
    """object_id and the canonical properties of features(attributes map); absent ones are left out of the map.

    The first id attribute that is there decides: object_id is null where it holds no whole number, and
    such rows break the contract."""
    x = features.withColumn("_a", fold_keys(F.col("attributes")))
    found = F.coalesce(*(F.when(F.map_contains_key("_a", n), F.coalesce(F.element_at("_a", F.lit(n)), F.lit(""))) for n in ID_NAMES))
    return x.select(*features.columns, integer_id(found).alias("object_id"), _present(F.col("_a"), ALIASES[component]).alias("properties"))


def compact_attributes(features: DataFrame, names: list[str]) -> DataFrame:
    """features with only the named attributes, compared in lower case, under the names of the list."""
    return features.withColumn("attributes", _present(fold_keys(F.col("attributes")), {n: n.lower() for n in names}))


def polyline_segments(lines: DataFrame, key: str = "id") -> DataFrame:
    """key, path, seq, x1, y1, x2, y2 of lines(key, paths); paths of fewer than two points are dropped."""
    points = lines.select(key, F.posexplode("paths").alias("path", "points")).filter(F.size("points") >= 2)
    pairs = F.transform(F.sequence(F.lit(0), F.size("points") - 2), lambda i: F.struct(i.alias("seq"), *(F.get(F.get("points", i + a), F.lit(b)).alias(f"{'xy'[b]}{a + 1}") for a in (0, 1) for b in (0, 1))))
    return points.select(key, "path", F.explode(pairs).alias("s")).select(key, "path", "s.seq", *(F.col(f"s.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")))


def bucketed(segments: DataFrame, size: float) -> DataFrame:
    """segments with the grid buckets under their bounding box: the equi-key of a spatial join."""
    b = lambda f, a, c: F.floor(f(a, c) / size).cast("int")
    return (segments.withColumn("bx", F.explode(F.sequence(b(F.least, "x1", "x2"), b(F.greatest, "x1", "x2"))))
        .withColumn("by", F.explode(F.sequence(b(F.least, "y1", "y2"), b(F.greatest, "y1", "y2")))))


def intersecting(routes: DataFrame, features: DataFrame, size: float) -> DataFrame:
    """preset, id of routes' and features' segments that meet, each pair once."""
    r = bucketed(routes, size).select("preset", "bx", "by", *(F.col(c).alias(f"r{c}") for c in ("x1", "y1", "x2", "y2")))
    f = bucketed(features, size).select("id", "bx", "by", "x1", "y1", "x2", "y2")
    meet = segments_meet(tuple(F.col(f"r{c}") for c in ("x1", "y1", "x2", "y2")), tuple(F.col(c) for c in ("x1", "y1", "x2", "y2")))
    return r.join(f, ["bx", "by"]).filter(meet).select("preset", "id").distinct()


def crossings_of_itself(segments: DataFrame, key: str, size: float) -> DataFrame:
    """key, a, b of segments (in order seq) of one line that meet though they are not neighbours: none for a simple line."""
    s = bucketed(segments, size)
    a = s.select(key, "bx", "by", F.col("seq").alias("a"), *(F.col(c).alias(f"a{c}") for c in ("x1", "y1", "x2", "y2")))
    b = s.select(key, "bx", "by", F.col("seq").alias("b"), *(F.col(c).alias(f"b{c}") for c in ("x1", "y1", "x2", "y2")))
    meet = segments_meet(tuple(F.col(f"a{c}") for c in ("x1", "y1", "x2", "y2")), tuple(F.col(f"b{c}") for c in ("x1", "y1", "x2", "y2")))
    return a.join(b, [key, "bx", "by"]).filter((F.col("b") > F.col("a") + 1) & meet).select(key, "a", "b").distinct()


def pages(ids: DataFrame, size: int, group: str = "tile", key: str = "id") -> DataFrame:
    """The page of each id: its rank among the group's ids over the page size."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(key)) - 1
    return ids.withColumn("page", F.floor(rank / size).cast("int"))


def first_capture(rows: DataFrame, key: str = "id", value: str = "value", tolerance: float = 1e-6) -> DataFrame:
    """One row an id: the first by (tile, page), how often it came, and whether later ones differ."""
    return rows.groupBy(key).agg(F.min_by("tile", F.struct("tile", "page")).alias("tile"), F.min_by(value, F.struct("tile", "page")).alias(value), F.count("*").alias("times"), (~near(F.max(value), F.min(value), tolerance)).alias("conflict"))


def tile_inventory(ids: DataFrame, page_size: int) -> DataFrame:
    """One row over ids(tile, id): tiles, ids with repeats, distinct ids, expected pages."""
    by = ids.groupBy("tile").agg(F.count("*").alias("n"))
    return by.agg(F.count("*").alias("tiles"), F.sum("n").alias("ids"), F.sum(F.ceil(F.col("n") / page_size)).alias("pages")).crossJoin(ids.agg(F.count_distinct("id").alias("unique_ids")))  # one row each


def strip_private(document, private: list[str] = PRIVATE_KEYS):
    """A JSON document (string column) without private keys at any depth, by a vectorised function; null for text that is no JSON."""
    gone = set(private)

    def clean(x):
        if isinstance(x, dict):
            return {k: clean(v) for k, v in x.items() if k not in gone}
        return [clean(v) for v in x] if isinstance(x, list) else x

    def one(text: str) -> str | None:
        try:
            return json.dumps(clean(json.loads(text)), separators=(",", ":"))
        except ValueError:
            return None

    @F.pandas_udf("string")
    def strip(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action="ignore")

    return strip(document)


def length_inside(routes: DataFrame, areas: DataFrame, size: float) -> DataFrame:
    """preset, id, length of routes' segments (preset, step, x1, y1, x2, y2) inside areas' ring segments (id, x1, y1, x2, y2).

    The crossings of a segment's line with all rings of an area, sorted, pair up to the stretches
    inside (even-odd); these are cut to the segment. Segments meet areas by the grid buckets of `size`
    under their boxes."""
    boxes = areas.groupBy("id").agg(F.min(F.least("x1", "x2")).alias("x1"), F.min(F.least("y1", "y2")).alias("y1"), F.max(F.greatest("x1", "x2")).alias("x2"), F.max(F.greatest("y1", "y2")).alias("y2"))
    r = bucketed(routes, size).select("preset", "step", "bx", "by", *(F.col(c).alias(f"r{c}") for c in ("x1", "y1", "x2", "y2")))
    pairs = r.join(bucketed(boxes, size).select("id", "bx", "by"), ["bx", "by"]).drop("bx", "by").distinct()
    dx, dy = F.col("rx2") - F.col("rx1"), F.col("ry2") - F.col("ry1")
    side = lambda x, y: dx * (y - F.col("ry1")) - dy * (x - F.col("rx1"))
    edges = pairs.join(areas, "id").withColumns({"a": side(F.col("x1"), F.col("y1")), "b": side(F.col("x2"), F.col("y2"))}).filter((F.col("a") < 0) != (F.col("b") < 0))
    k = F.col("a") / (F.col("a") - F.col("b"))
    px, py = F.col("x1") + k * (F.col("x2") - F.col("x1")), F.col("y1") + k * (F.col("y2") - F.col("y1"))
    t = ((px - F.col("rx1")) * dx + (py - F.col("ry1")) * dy) / (dx * dx + dy * dy)
    cuts = edges.select("preset", "step", "id", F.hypot(dx, dy).alias("size"), t.alias("t")).groupBy("preset", "step", "id").agg(F.array_sort(F.collect_list("t")).alias("ts"), F.first("size").alias("size"))
    hold = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    inside = F.aggregate(F.transform(F.sequence(F.lit(0), F.floor(F.size("ts") / 2).cast("int") - 1), lambda i: hold(F.get("ts", i * 2 + 1)) - hold(F.get("ts", i * 2))), F.lit(0.0), lambda x, y: x + y)
    return cuts.select("preset", "id", (inside * F.col("size")).alias("length")).groupBy("preset", "id").agg(F.sum("length").alias("length")).filter("length > 0")
