"""The published asset: routes with metrics as compact JSON, checked against its contract, GeoJSON and CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import csv_field, is_finite
from ..operators import nested
from ..operators.cost import PRESETS

# the format of the published asset (fixed values): components of the inventory, metrics that every route has, and metrics that are published
INVENTORY = ("protected_land", "hydrography_line", "hydrography_area", "roads", "railways", "native_vegetation")
REQUIRED_METRICS = ("path_cell_count", "route_length_km", "terrain_normalized_mean", "terrain_normalized_max", "slope_mean_degrees", "slope_max_degrees")
PUBLISHED_METRICS = (*REQUIRED_METRICS, "component_intersected_cell_counts", "component_route_cell_sums", "weighted_cell_exposure", "endpoint_cells", "diagnostics")
COUNTS = ("intersected_feature_count", "interaction_feature_count", "crossing_feature_count", "native_vegetation_cell_count")
CRS = 7844


def contract() -> tuple[list, list, list]:
    """(rules, sizes, distinct) of the published asset, for `nested.contract_violations`."""
    names = sorted(PRESETS)
    need = lambda parent, kind, *children: [(parent, c, kind, None, True) for c in children]
    may = lambda parent, kind, *children: [(parent, c, kind, None, False) for c in children]
    rules = [("$", "schema_version", "number", [1], True), ("$", "format", "text", ["ico-static-route-assets"], True), ("$", "scenario", "text", ["S1"], True), *need("$", "number", "display_crs_epsg"), *need("$", "object", "endpoints", "comparison", "provenance"), *need("$", "array", "routes"), *need("$", "text", "disclaimer")]
    end, route, geometry = "$.endpoints.features[]", "$.routes[]", "$.routes[].geometry"
    rules += [("$.endpoints", "type", "text", ["FeatureCollection"], True), *need("$.endpoints", "array", "features"), (end, "type", "text", ["Feature"], True), *need(end, "object", "properties", "geometry"), (f"{end}.properties", "role", "text", ["destination", "origin"], True), *need(f"{end}.properties", "text", "name"), (f"{end}.geometry", "type", "text", ["Point"], True), *need(f"{end}.geometry", "array", "coordinates")]
    rules += [(route, "preset", "text", names, True), *need(route, "text", "description"), *need(route, "object", "geometry", "metrics", "impact_inventory"), (geometry, "type", "text", ["Feature"], True), *need(geometry, "object", "properties", "geometry"), (f"{geometry}.properties", "preset", "text", names, True), (f"{geometry}.geometry", "type", "text", ["LineString"], True), *need(f"{geometry}.geometry", "array", "coordinates")]
    rules += [*need(f"{route}.metrics", "number", *REQUIRED_METRICS), *need(f"{route}.metrics", "object", "diagnostics", "endpoint_cells"), *need(f"{route}.metrics.diagnostics", "number", "route_is_available", "continuity_validated"), *need(f"{route}.metrics.endpoint_cells", "array", "origin", "destination")]
    for component in INVENTORY:
        at = f"{route}.impact_inventory.{component}"
        rules += [*need(f"{route}.impact_inventory", "object", component), *need(at, "text", "component"), *need(at, "array", "classes" if component == "native_vegetation" else "features"), *may(at, "number", *COUNTS)]
        rules += [*need(f"{at}.features[]", "number", "source_object_id"), *need(f"{at}.features[]", "object", "properties"), *may(f"{at}.features[]", "number", "intersection_length_m", "intersection_dimension", "major_road"), *need(f"{at}.classes[]", "number", "value", "route_cell_count"), *may(f"{at}.classes[]", "text", "PCTName")]
    rules += [("$.comparison", "baseline", "text", names, True), *need("$.comparison", "array", "routes"), ("$.comparison.routes[]", "preset", "text", names, True), *need("$.comparison.routes[]", "number", "route_length_km", "slope_mean_degrees")]
    sizes = [("$.endpoints.features", 2), ("$.routes", len(names)), ("$.comparison.routes", len(names)), (f"{end}.geometry.coordinates", 2), (f"{route}.metrics.endpoint_cells.origin", 2), (f"{route}.metrics.endpoint_cells.destination", 2), (f"{geometry}.geometry.coordinates[]", 2)]
    return rules, sizes, ["$.endpoints.features[].properties.role", "$.routes[].preset", "$.comparison.routes[].preset"]


def contract_violations(documents: DataFrame) -> DataFrame:
    """id, path, problem of published assets(id, document) against the whole contract; a route's line has two places at least."""
    values = nested.leaves(documents, ["id"])
    line = nested.generic(F.col("path")) == "$.routes[].geometry.geometry.coordinates"
    short = values.filter(line & (F.col("kind") == "array") & (F.col("size") < 2)).select("id", "path", F.lit("length").alias("problem"))
    points = values.filter(nested.generic(F.col("path")).isin("$.routes[].geometry.geometry.coordinates[][]", "$.endpoints.features[].geometry.coordinates[]", "$.routes[].metrics.endpoint_cells.origin[]", "$.routes[].metrics.endpoint_cells.destination[]") & (F.col("kind") != "number")).select("id", "path", F.lit("not number").alias("problem"))
    # a route's own name is that of its geometry
    names = values.filter(nested.generic(F.col("path")).isin("$.routes[].preset", "$.routes[].geometry.properties.preset")).withColumn("route", F.regexp_extract("path", r"^(\$\.routes\[\d+\])", 1))
    unlike = names.groupBy("id", "route").agg(F.count_distinct("text").alias("n")).filter("n > 1").select("id", F.col("route").alias("path"), F.lit("presets differ").alias("problem"))
    return nested.contract_violations(values, *contract()).unionByName(short).unionByName(points).unionByName(unlike)


def build_asset(assessments: list[dict], descriptions: dict[str, str], endpoints: dict[str, dict], scenario: str, comparison: dict, source: str) -> dict:
    """The published asset of assessed routes: published metrics alone, the inventory without private keys, both endpoints as points.

    A route's assessment holds preset, geometry and impact_inventory beside its metrics; there is one for each preset."""
    from ..operators.vector import PRIVATE_KEYS

    def public(x):
        if isinstance(x, dict):
            return {k: public(v) for k, v in x.items() if k not in PRIVATE_KEYS}
        return [public(v) for v in x] if isinstance(x, list) else x

    routes = [{"preset": a["preset"], "description": descriptions.get(a["preset"], ""), "geometry": {"type": "Feature", "properties": {"preset": a["preset"]}, "geometry": a["geometry"]}, "metrics": {k: a[k] for k in PUBLISHED_METRICS if k in a}, "impact_inventory": public(a.get("impact_inventory", {}))} for a in assessments]
    ends = [{"type": "Feature", "properties": {"role": role, "name": e["name"]}, "geometry": {"type": "Point", "coordinates": [e["longitude"], e["latitude"]]}} for role, e in endpoints.items()]
    return {"schema_version": 1, "format": "ico-static-route-assets", "scenario": scenario, "display_crs_epsg": CRS, "endpoints": {"type": "FeatureCollection", "features": ends}, "routes": routes, "comparison": comparison, "disclaimer": "Screening of corridors only; every route needs review.", "provenance": {"assessment_source": source, "source_inventory_geometry_retained": False}}


def asset_violations(routes: DataFrame) -> DataFrame:
    """id, problem of routes(id, preset, coordinates, length_m): known preset, pairs of numbers, finite metric."""
    pairs = F.forall("coordinates", lambda p: (F.size(p) >= 2) & F.forall(p, is_finite))
    bad = F.when(~F.col("preset").isin(*PRESETS), "preset").when(~pairs | (F.size("coordinates") < 2), "coordinates").when(~is_finite(F.col("length_m")), "metric")
    return routes.select("id", bad.alias("problem")).filter("problem is not null")


def geojson_lines(route: DataFrame) -> DataFrame:
    """preset, feature: each route(preset, step, lon, lat) as one GeoJSON LineString."""
    points = F.transform(F.array_sort(F.collect_list(F.struct("step", "lon", "lat"))), lambda p: F.array(p["lon"], p["lat"]))
    out = route.groupBy("preset").agg(points.alias("coordinates"))
    return out.select("preset", F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("preset").alias("properties"), F.struct(F.lit("LineString").alias("type"), "coordinates").alias("geometry"))).alias("feature"))


def csv_lines(rows: DataFrame) -> DataFrame:
    """line: every row as comma-separated text, nulls empty."""
    return rows.select(F.concat_ws(",", *(F.coalesce(csv_field(F.col(c).cast("string")), F.lit("")) for c in rows.columns)).alias("line"))


def publish(routes: DataFrame, path: str) -> None:
    """One folder a preset under a path that must not exist yet; Spark's committer makes it appear whole."""
    routes.write.mode("errorifexists").partitionBy("preset").json(path)
