"""Queries that acquire layers: addresses, page cache, completeness, manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layers as la
from . import bindings as b
from .acquisition import _TILES, _ids
from .registry import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql
PAGE = 100

#: Pages of the orders' ids; by (tile * 31 + page) % 8 a cached page is lost (0), short of an id (1), or stale in key, fields or system (2, 3, 4).
_PAGES = f"{_TILES}, paged AS (SELECT tile, id, value, ((row_number() OVER (PARTITION BY tile ORDER BY id) - 1) // {PAGE})::INT AS page FROM ids), pages AS (SELECT tile, page, (tile * 31 + page) % 8 AS k, count(*) AS n FROM paged GROUP BY ALL)"
_STATE = "CASE k WHEN 0 THEN 'fetch' WHEN 1 THEN 'ids' WHEN 2 THEN 'cache_key' WHEN 3 THEN 'out_fields' WHEN 4 THEN 'crs' ELSE 'reuse' END"


def _request():
    return {"cache_key": F.lit("k1"), "out_fields": F.array(F.lit("id"), F.lit("value")), "crs": F.lit(4326)}


def _cached(wanted):
    k = (F.col("tile") * 31 + F.col("page")) % 8
    x = wanted.filter(k != 0)
    return x.withColumns({"ids": F.when(k == 1, F.slice("ids", 2, PAGE)).otherwise(F.col("ids")), "cache_key": F.when(k == 2, "k0").otherwise("k1"),
                          "out_fields": F.when(k == 3, F.array(F.lit("id"))).otherwise(F.col("out_fields")), "crs": F.when(k == 4, 7844).otherwise(4326)})


@R.query(f"WITH {_PAGES} SELECT tile, page, n, {_STATE} AS state FROM pages")
def page_cache_states(spark, sf_dir):
    wanted = la.wanted_pages(_ids(spark, sf_dir).select("tile", "id"), PAGE, **_request())
    return la.page_states(wanted, _cached(wanted)).select("tile", "page", F.size("ids").cast("long").alias("n"), "state")


def _features(rows):
    """Captured rows of ids: two texts and two numbers a feature; every 35th id differs between tiles."""
    odd = F.when(F.col("id") % 35 == 0, F.col("tile")).otherwise(0)
    return rows.select("tile", "page", "id", F.array(F.lit("order"), (F.col("id") % 7).cast("string")).alias("texts"), F.array(F.col("id").cast("double"), F.col("id") / 8.0 + odd).alias("numbers"))


@R.query(f"""WITH {_PAGES}, f AS (SELECT id, count(*) AS times, min(tile) AS tile FROM ids GROUP BY id)
SELECT (SELECT count(*) FROM pages WHERE k > 4) AS reused, (SELECT count(*) FROM pages WHERE k <= 4) AS fetched, count(*) AS features, count(*) FILTER (times > 1) AS again,
  count(*) FILTER (times > 1 AND id % 35 = 0) AS conflicts, sum(tile)::BIGINT AS tiles, round(sum(id / 8.0 + CASE WHEN id % 35 = 0 THEN tile ELSE 0 END), 3) AS total FROM f""")
def acquire_layer(spark, sf_dir):
    """A layer from end to end: pages of its inventory, stale ones fetched, first captures kept, conflicts found."""
    ids = _ids(spark, sf_dir).select("tile", "id")
    wanted = la.wanted_pages(ids, PAGE, **_request())
    # what a stale page holds is wrong: reusing one would show in the sums
    stale = la.page_states(wanted, _cached(wanted)).select("tile", "page", F.when(F.col("state") == "reuse", 0.0).otherwise(1000.0).alias("wrong"))
    held = _features(wanted.select("tile", "page", F.explode("ids").alias("id"))).join(stale, ["tile", "page"]).withColumn("numbers", F.transform("numbers", lambda x: x + F.col("wrong"))).drop("wrong")
    fetch = lambda pages: _features(pages.select("tile", "page", F.explode("ids").alias("id")))
    states, features, violations = la.acquire(ids, _cached(wanted), held, fetch, PAGE, **_request())
    pages = states.agg(F.count_if(F.col("state") == "reuse").alias("reused"), F.count_if(F.col("state") != "reuse").alias("fetched"))
    found = features.agg(F.count("*").alias("features"), F.count_if(F.col("times") > 1).alias("again"), F.sum(F.col("tile").cast("long")).alias("tiles"), F.round(F.sum(F.col("numbers")[1]), 3).alias("total"))
    return pages.crossJoin(found).crossJoin(violations.agg(F.count_if(F.col("problem") == "conflict").alias("conflicts")))  # one row each


@R.query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'https://maps.example.org/svc/FeatureServer/' || (s_suppkey % 9) ELSE 'https://maps.example.org/svc/FeatureServer/' || s_nationkey END AS url,
CASE WHEN s_suppkey % 4 = 0 THEN s_nationkey / 4.0 + 0.25 WHEN s_suppkey % 4 < 3 THEN 0.5 END::DOUBLE AS tile, s_name || '--' || s_nationkey || '.json' AS artifact FROM supplier""")
def layer_addresses(spark, sf_dir):
    k = F.col("s_suppkey")
    base = F.lit("https://maps.example.org/svc/FeatureServer")
    url = F.when(k % 3 == 0, F.concat(base, F.lit("/"), (k % 9).cast("string"))).when(k % 3 == 1, F.concat(base, F.lit("//"))).otherwise(base)
    size = la.tile_degrees(F.when(k % 4 == 0, F.col("s_nationkey") / 4.0 + 0.25), F.when(k % 4 < 3, 0.5))
    return b.table(spark, sf_dir, "supplier").select(k.alias("id"), la.layer_url(url, F.col("s_nationkey")).alias("url"), size.alias("tile"), la.artifact_name(F.col("s_name"), F.col("s_nationkey").cast("string")).alias("artifact"))


@R.query("""WITH k AS (SELECT c_nationkey AS source_id, CASE WHEN c_nationkey % 3 = 0 AND c_mktsegment = 'BUILDING' THEN 'OTHER' ELSE c_mktsegment END AS kind FROM customer WHERE c_custkey % 40 < 25)
SELECT source_id, string_agg(DISTINCT kind, ',' ORDER BY kind) AS observed FROM k GROUP BY source_id HAVING NOT bool_or(kind = 'BUILDING')""")
def required_layer_kind(spark, sf_dir):
    """Sources without a layer of the kind that they must have; a third of them have it under another name."""
    c = b.table(spark, sf_dir, "customer").filter("c_custkey % 40 < 25")
    kind = F.when((F.col("c_nationkey") % 3 == 0) & (F.col("c_mktsegment") == "BUILDING"), "OTHER").otherwise(F.col("c_mktsegment"))
    return la.required_kind(c.select(F.col("c_nationkey").alias("source_id"), kind.alias("kind")), "BUILDING")


@R.query("""SELECT p_partkey AS source_id, (p_size % 10)::INT AS layer_id, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 5 = 1 AND p_partkey % 4 = 3 THEN NULL WHEN p_partkey % 6 = 2 THEN 'Table' ELSE 'Feature Layer' END AS kind,
CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 5 = 1 AND p_partkey % 4 = 3 THEN NULL WHEN p_partkey % 9 = 4 THEN 'point' ELSE 'polyline' END AS geometry_type,
CASE WHEN p_partkey % 7 = 0 THEN 'unavailable' WHEN p_partkey % 5 = 1 AND p_partkey % 4 = 3 THEN 'no detail' WHEN p_partkey % 6 = 2 THEN 'not queryable' WHEN p_partkey % 9 = 4 THEN 'geometry' END AS problem FROM part""")
def layer_resolve(spark, sf_dir):
    """Configured layers against a service's list; every fifth entry is sparse and filled from details, of which some lack."""
    k = F.col("p_partkey")
    p = b.table(spark, sf_dir, "part").select(k, k.alias("source_id"), (F.col("p_size") % 10).cast("int").alias("layer_id"))
    kind, geometry = F.when(k % 6 == 2, "Table").otherwise("Feature Layer"), F.when(k % 9 == 4, "point").otherwise("polyline")
    full = p.select("source_id", "layer_id", kind.alias("kind"), geometry.alias("geometry_type"), k)
    listed = full.filter(k % 7 != 0).withColumn("kind", F.when(k % 5 != 1, F.col("kind")))
    return la.resolve_layers(p.select("source_id", "layer_id", F.lit("polyline").alias("geometry_type")), listed.drop("p_partkey"), full.filter(k % 4 != 3).drop("p_partkey"))


@R.query("""WITH m AS (SELECT o_orderkey AS layer FROM orders) SELECT layer, problem FROM (
SELECT layer, unnest(CASE WHEN layer % 19 = 0 THEN ['no artifact'] ELSE list_filter([CASE WHEN layer % 11 = 1 THEN 'source_url' END, CASE WHEN layer % 13 = 2 THEN 'layer_id' END, CASE WHEN layer % 6 = 3 THEN 'output_crs' END, CASE WHEN layer % 17 = 4 THEN 'query' END], lambda x: x IS NOT NULL) END) AS problem FROM m)
UNION ALL SELECT layer + 100000000, 'no manifest' FROM m WHERE layer % 100 = 7""")
def manifest_headers(spark, sf_dir):
    """Headers of artifacts against their manifest, nine keys each; a null system equals a null one."""
    k = F.col("layer")
    o = b.table(spark, sf_dir, "orders")
    m = o.select(F.col("o_orderkey").alias("layer"), F.col("o_orderpriority").alias("source_id"), F.col("o_clerk" if "o_clerk" in o.columns else "o_orderstatus").alias("source_url"), F.col("o_orderstatus").alias("component"), (F.col("o_orderkey") % 50).alias("layer_id"), F.lit("polyline").alias("geometry_type"), F.lit(None).cast("int").alias("source_crs"), F.when(F.col("o_orderkey") % 6 != 3, 7856).alias("output_crs"), F.lit("150.82,-33.15,151.62,-32.27").alias("envelope"), F.struct(F.lit("1=1").alias("where")).alias("query"))
    a = m.filter(k % 19 != 0).withColumns({"source_url": F.when(k % 11 == 1, F.concat("source_url", F.lit("/"))).otherwise(F.col("source_url")), "layer_id": F.when(k % 13 == 2, -1).otherwise(F.col("layer_id")), "output_crs": F.lit(7856), "query": F.when(k % 17 == 4, F.struct(F.lit("2=2").alias("where"))).otherwise(F.col("query"))})
    extra = m.filter(k % 100 == 7).withColumn("layer", k + 100_000_000)
    return la.header_violations(m, a.unionByName(extra))


@R.query("""WITH t AS (SELECT l_orderkey AS layer, l_linenumber AS tile, l_quantity::BIGINT AS ids, CASE WHEN l_partkey % 10 = 0 THEN 1 ELSE ceil(l_quantity / 20) END AS pages, l_partkey FROM lineitem),
d AS (SELECT DISTINCT layer, tile, ids, pages FROM t) SELECT layer, 'pages of tile ' || tile AS problem FROM d WHERE pages <> ceil(ids / 20)
UNION ALL SELECT layer, 'fewer ids than unique ones' FROM d GROUP BY layer HAVING sum(ids) < 30""")
def manifest_tile_pages(spark, sf_dir):
    li = b.table(spark, sf_dir, "lineitem")
    ids = F.col("l_quantity").cast("long")
    t = li.select(F.col("l_orderkey").alias("layer"), F.col("l_linenumber").alias("tile"), ids.alias("ids"), F.when(F.col("l_partkey") % 10 == 0, 1).otherwise(F.ceil(ids / 20)).cast("long").alias("pages")).distinct()
    return la.tile_page_violations(t, t.select("layer").distinct().withColumn("unique_ids", F.lit(30)), 20)


@R.query("SELECT count(DISTINCT o_orderpriority) AS sources, count(*) AS layers, sum(o_orderkey % 7)::BIGINT AS features FROM orders")
def manifest_totals(spark, sf_dir):
    o = b.table(spark, sf_dir, "orders")
    return la.manifest_totals(o.select(F.col("o_orderpriority").alias("source_id"), F.col("o_orderkey").alias("layer"), (F.col("o_orderkey") % 7).alias("features")))
