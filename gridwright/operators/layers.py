"""Acquiring layers whole: their addresses, cached pages and staleness, first captures, headers, completeness.

Pages, ids and features are tables; a page is some hundred ids, so its arrays are short. Checks return
the rows that break a rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import near
from . import vector

#: What a cached page must have in common with the request, in the order in which it is looked at.
PAGE_KEYS = ("ids", "cache_key", "out_fields", "crs")
#: Keys that an artifact's header shares with its entry in the manifest (fixed values of the format).
HEADER_KEYS = ("source_id", "source_url", "component", "layer_id", "geometry_type", "source_crs", "output_crs", "envelope", "query")


def layer_url(url: Column, layer_id: Column) -> Column:
    """A service's address with the layer's id, unless the last part of it is a number already."""
    trimmed = F.regexp_replace(url, "/+$", "")
    return F.when(trimmed.rlike("/[0-9]+$"), trimmed).otherwise(F.concat(trimmed, F.lit("/"), layer_id.cast("string")))


def tile_degrees(of_source: Column, of_all: Column) -> Column:
    """A source's tile size, else the general one; null means untiled. No number above 0 is an error."""
    size = F.coalesce(of_source, of_all).cast("double")
    return F.when(size.isNull() | ((size > 0) & (size < float("inf"))), size).otherwise(F.raise_error(F.lit("tile size must be a number above 0")).cast("double"))


def artifact_name(source_id: Column, component: Column) -> Column:
    return F.concat(source_id, F.lit("--"), component, F.lit(".json"))


def required_kind(layers: DataFrame, kind: str) -> DataFrame:
    """source_id, observed of sources whose layers(source_id, kind) hold none of that kind."""
    seen = layers.groupBy("source_id").agg(F.count_if(F.col("kind") == kind).alias("n"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("observed"))
    return seen.filter("n = 0").select("source_id", "observed")


def resolve_layers(configured: DataFrame, listed: DataFrame, details: DataFrame) -> DataFrame:
    """source_id, layer_id, kind, geometry_type, problem of configured(source_id, layer_id, geometry_type).

    The service's list of layers(source_id, layer_id, kind, geometry_type) decides; where it lacks a kind or a
    geometry type, the layer's own details do, whole."""
    keys = ["source_id", "layer_id"]
    short = listed.select(*keys, F.col("kind").alias("k"), F.col("geometry_type").alias("g"), F.lit(True).alias("listed"))
    full = details.select(*keys, F.col("kind").alias("dk"), F.col("geometry_type").alias("dg"), F.lit(True).alias("known"))
    x = configured.join(short, keys, "left").join(full, keys, "left")
    sparse = F.col("listed") & (F.col("k").isNull() | F.col("g").isNull())
    x = x.withColumns({"kind": F.when(sparse, F.col("dk")).otherwise(F.col("k")), "found": F.when(sparse, F.col("dg")).otherwise(F.col("g"))})
    bad = (F.when(F.col("listed").isNull(), "unavailable").when(sparse & F.col("known").isNull(), "no detail")
        .when(~F.col("kind").eqNullSafe(F.lit("Feature Layer")), "not queryable").when(~F.col("found").eqNullSafe(F.col("geometry_type")), "geometry"))
    return x.select(*keys, "kind", F.col("found").alias("geometry_type"), bad.alias("problem"))


def wanted_pages(ids: DataFrame, size: int, **request: Column) -> DataFrame:
    """tile, page, ids (in order) and the request's columns for ids(tile, id)."""
    paged = vector.pages(ids, size).groupBy("tile", "page").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return paged.select("*", *(c.alias(k) for k, c in request.items()))


def page_states(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """wanted's columns and state: reuse, fetch (nothing cached) or the first of PAGE_KEYS that is stale."""
    there = cached.select("tile", "page", *(F.col(k).alias(f"c_{k}") for k in PAGE_KEYS), F.lit(True).alias("there"))
    state = F.when(F.col("there").isNull(), "fetch")
    for k in PAGE_KEYS:
        state = state.when(~F.col(k).eqNullSafe(F.col(f"c_{k}")), k)
    return wanted.join(there, ["tile", "page"], "left").select(*wanted.columns, state.otherwise("reuse").alias("state"))


def first_features(rows: DataFrame, key: str = "id", tolerance: float = 1e-6) -> DataFrame:
    """One row an id of rows(tile, page, id, texts, numbers): the first by (tile, page), times, conflict.

    Features are whole: texts and numbers are arrays of all of a feature's values; later captures must hold equal
    texts, and as many numbers, each within the tolerance."""
    order = Window.partitionBy(key).orderBy("tile", "page")
    x = rows.withColumns({"t0": F.first("texts").over(order), "n0": F.first("numbers").over(order)})
    close = F.forall(F.zip_with("numbers", "n0", lambda a, b: near(a, b, tolerance)), lambda ok: F.coalesce(ok, F.lit(False)))
    same = F.col("texts").eqNullSafe(F.col("t0")) & (F.size("numbers") == F.size("n0")) & close
    return x.groupBy(key).agg(F.min_by(F.struct("tile", "page", "texts", "numbers"), F.struct("tile", "page")).alias("f"), F.count("*").alias("times"), F.max(~same).alias("conflict")).select(key, "f.*", "times", "conflict")


def complete_layer(ids: DataFrame, captured: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(features, violations) of a layer: ids(tile, id) is its inventory, captured(tile, page, id, texts, numbers) its pages.

    violations: id, problem of ids that no page brought, that no tile asked for, or that differ between tiles."""
    features = first_features(captured)
    asked = ids.select("id").distinct().withColumn("asked", F.lit(True))
    sides = asked.join(features.select("id", "conflict", F.lit(True).alias("got")), "id", "full_outer")
    bad = F.when(F.col("got").isNull(), "missing").when(F.col("asked").isNull(), "unexpected").when(F.col("conflict"), "conflict")
    return features, sides.select("id", bad.alias("problem")).filter("problem is not null")


def acquire(ids: DataFrame, cached: DataFrame, cached_features: DataFrame, fetch, size: int, **request: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(page states, features, violations) of a layer: cached pages that are not stale are reused, the others fetched.

    fetch: a function of a table of pages (tile, page, ids) that gives captured rows; it runs on the executors."""
    states = page_states(wanted_pages(ids, size, **request), cached)
    kept = cached_features.join(states.filter("state = 'reuse'").select("tile", "page"), ["tile", "page"], "left_semi")
    captured = kept.unionByName(fetch(states.filter("state <> 'reuse'").select("tile", "page", "ids")))
    return (states, *complete_layer(ids, captured))


def header_violations(manifest: DataFrame, artifacts: DataFrame, keys: tuple[str, ...] = HEADER_KEYS) -> DataFrame:
    """layer, problem of manifest's layers against the artifacts' headers: each key equal, nulls included; none on one side only."""
    a = artifacts.select("layer", *(F.col(k).alias(f"a_{k}") for k in keys), F.lit(True).alias("there"))
    m = manifest.select("layer", *keys, F.lit(True).alias("listed"))
    problems = F.filter(F.array(*(F.when(~F.col(k).eqNullSafe(F.col(f"a_{k}")), F.lit(k)) for k in keys)), lambda p: p.isNotNull())
    both = F.when(F.col("there").isNull(), F.array(F.lit("no artifact"))).when(F.col("listed").isNull(), F.array(F.lit("no manifest"))).otherwise(problems)
    return m.join(a, "layer", "full_outer").select("layer", F.explode(both).alias("problem"))


def tile_page_violations(tiles: DataFrame, totals: DataFrame, size: int) -> DataFrame:
    """layer, problem: each of tiles(layer, tile, ids, pages) has ceil(ids / size) pages, and a layer's tiles hold its
    unique ids of totals(layer, unique_ids) at least once."""
    pages = tiles.filter(F.col("pages") != F.ceil(F.col("ids") / size)).select("layer", F.concat(F.lit("pages of tile "), F.col("tile").cast("string")).alias("problem"))
    sums = tiles.groupBy("layer").agg(F.sum("ids").alias("n"))
    few = totals.join(sums, "layer").filter("n < unique_ids").select("layer", F.lit("fewer ids than unique ones").alias("problem"))
    return pages.unionByName(few)


def manifest_totals(manifest: DataFrame) -> DataFrame:
    """sources, layers, features of manifest(source_id, layer, features)."""
    return manifest.agg(F.count_distinct("source_id").alias("sources"), F.count("*").alias("layers"), F.sum("features").alias("features"))
