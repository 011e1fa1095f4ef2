"""Queries over captured pages, manifests, identities and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import arrays_near
from ..operators import checks, nested, vector
from . import bindings as b
from .registry import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql

#: Orders as captured ids: each is in the tile of its month, and every fifth also in the next tile.
_TILES = "ids AS (SELECT (month(o_orderdate) + k)::INT AS tile, o_orderkey AS id, o_totalprice AS value FROM orders, (VALUES (0), (1)) t(k) WHERE k = 0 OR o_orderkey % 5 = 0)"


def _ids(spark, sf_dir):
    o = b.table(spark, sf_dir, "orders")
    tiles = F.when(F.col("o_orderkey") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return o.select("o_orderdate", F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"), F.explode(tiles).alias("k")).select((F.month("o_orderdate") + F.col("k")).cast("int").alias("tile"), "id", "value")


@R.query(f"WITH {_TILES} SELECT tile, id, ((row_number() OVER (PARTITION BY tile ORDER BY id) - 1) // 100)::INT AS page FROM ids")
def tile_paging(spark, sf_dir):
    return vector.pages(_ids(spark, sf_dir).select("tile", "id"), 100)


@R.query(f"WITH {_TILES}, v AS (SELECT tile, id, round(value + CASE WHEN id % 35 = 0 THEN tile ELSE 0 END, 2) AS value FROM ids) SELECT id, arg_min(tile, tile) AS tile, arg_min(value, tile) AS value, count(*) AS times, max(value) - min(value) > 1e-6 AS conflict FROM v GROUP BY id")
def tile_dedup(spark, sf_dir):
    v = vector.pages(_ids(spark, sf_dir), 100).withColumn("value", F.round(F.col("value") + F.when(F.col("id") % 35 == 0, F.col("tile")).otherwise(0), 2))
    return vector.first_capture(v)


@R.query(f"WITH {_TILES}, n AS (SELECT tile, count(*) AS n FROM ids GROUP BY tile) SELECT count(*) AS tiles, sum(n)::BIGINT AS ids, sum(ceil(n / 100))::BIGINT AS pages, (SELECT count(DISTINCT id) FROM ids) AS unique_ids FROM n")
def tile_inventory(spark, sf_dir):
    return vector.tile_inventory(_ids(spark, sf_dir), 100)


@R.query("SELECT o_orderkey AS id, 'missing' AS problem FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 10) UNION ALL SELECT DISTINCT l_orderkey + 10000000, 'unexpected' FROM lineitem WHERE l_quantity > 49")
def capture_completeness(spark, sf_dir):
    expected = b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    li = b.table(spark, sf_dir, "lineitem")
    seen = li.filter("l_quantity > 10").select(F.col("l_orderkey").alias("id")).union(li.filter("l_quantity > 49").select(F.col("l_orderkey") + 10_000_000))
    return checks.missing_and_unexpected(expected, seen, "id")


@R.query("""WITH seen AS (SELECT l_orderkey AS id FROM lineitem WHERE l_linenumber = 1) SELECT o_orderkey AS id, 'missing' AS problem FROM orders WHERE o_orderkey NOT IN (FROM seen)
UNION ALL SELECT DISTINCT id, 'unexpected' FROM seen WHERE id NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT id, 'duplicate' FROM seen GROUP BY id HAVING count(*) > 1""")
def id_set_equality(spark, sf_dir):
    seen = b.table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("id"))
    return checks.id_set_equality(b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), seen, "id")


@R.query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return checks.duplicates(b.table(spark, sf_dir, "lineitem"), "l_orderkey")


@R.query("""SELECT e.n_nationkey AS id, CASE WHEN a.id IS NULL THEN 'missing' WHEN a.name <> e.n_name THEN 'name' ELSE 'kind' END AS problem FROM nation e
LEFT JOIN (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 = 1 THEN lower(n_name) ELSE n_name END AS name, CASE WHEN n_nationkey % 5 = 2 THEN 'point' ELSE 'line' END AS kind FROM nation WHERE n_nationkey % 5 <> 0) a ON a.id = e.n_nationkey
WHERE a.id IS NULL OR a.name <> e.n_name OR (e.n_nationkey % 2 = 0 AND a.kind <> 'line')""")
def expected_layers(spark, sf_dir):
    n = b.table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    wanted = n.select(k.alias("id"), F.col("n_name").alias("name"), F.when(k % 2 == 0, "line").alias("kind"))
    there = n.filter(k % 5 != 0).select(k.alias("id"), F.when(k % 5 == 1, F.lower("n_name")).otherwise(F.col("n_name")).alias("name"), F.when(k % 5 == 2, "point").otherwise("line").alias("kind"))
    return checks.expected_layers(wanted, there)


@R.query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN 'missing' WHEN c_custkey % 10 IN (1, 2) THEN 'identity' ELSE 'place' END AS problem FROM customer WHERE c_custkey % 10 < 4
UNION ALL SELECT c_custkey, 'duplicate' FROM customer WHERE c_custkey % 50 = 7""")
def endpoint_validation(spark, sf_dir):
    k = F.col("c_custkey")
    c = b.table(spark, sf_dir, "customer").select(k, k.alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("state"), (k % 90).cast("double").alias("lat"), (k % 180).cast("double").alias("lon"))
    f = c.filter(k % 10 != 0).select("id", F.when(k % 10 == 1, F.concat("name", F.lit("x"))).otherwise(F.col("name")).alias("name"), F.when(k % 10 == 2, F.lit("?")).otherwise(F.col("state")).alias("state"), (F.col("lat") + F.when(k % 10 == 3, 2e-5).otherwise(5e-6)).alias("lat"), "lon")
    return checks.endpoint_violations(c.drop("c_custkey"), f.union(f.filter("id % 50 = 7")))


@R.query("""WITH a AS (SELECT l_orderkey AS layer, count(*) AS features, count(DISTINCT l_partkey) AS ids FROM lineitem GROUP BY ALL), m AS (SELECT o_orderkey AS layer, o_orderkey % 7 AS declared, o_orderkey % 6 AS unique_ids FROM orders)
SELECT coalesce(m.layer, a.layer) AS layer, CASE WHEN a.layer IS NULL THEN 'no artifact' WHEN m.layer IS NULL THEN 'no manifest' WHEN declared <> features THEN 'count' ELSE 'ids' END AS problem FROM m FULL JOIN a ON m.layer = a.layer
WHERE a.layer IS NULL OR m.layer IS NULL OR declared <> features OR unique_ids <> ids""")
def manifest_reconcile(spark, sf_dir):
    a = b.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("layer")).agg(F.count("*").alias("features"), F.count_distinct("l_partkey").alias("ids"))
    m = b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("layer"), (F.col("o_orderkey") % 7).alias("declared"), (F.col("o_orderkey") % 6).alias("unique_ids"))
    return checks.manifest_violations(m, a)


@R.query("""SELECT l_orderkey, l_partkey, l_linenumber, q, (sum(q) OVER w)::BIGINT AS running, sum(q) OVER w > 60 AS over_cap FROM (SELECT l_orderkey, l_partkey, l_linenumber, sum(l_quantity::BIGINT)::BIGINT AS q FROM lineitem GROUP BY ALL)
WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_partkey * 10 + l_linenumber ROWS UNBOUNDED PRECEDING)""")
def running_bytes_cap(spark, sf_dir):
    x = b.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey", "l_linenumber").agg(F.sum(F.col("l_quantity").cast("long")).alias("q")).withColumn("k", F.col("l_partkey") * 10 + F.col("l_linenumber"))
    return checks.running_total(x, "k", "q", "l_orderkey", 60).drop("k")


@R.query("SELECT name, value, most FROM (SELECT 'features' AS name, count(*) AS value, 1000 AS most FROM lineitem UNION ALL SELECT 'bytes', sum(l_quantity::BIGINT)::BIGINT, 1000000000 FROM lineitem) WHERE value > most")
def limit_guards(spark, sf_dir):
    s = b.table(spark, sf_dir, "lineitem").agg(F.count("*").alias("features"), F.sum(F.col("l_quantity").cast("long")).alias("bytes"))
    return checks.over_limits(s, {"features": 1000, "bytes": 1_000_000_000})


@R.query("SELECT vec_id, list_bool_and(list_transform(list_zip(a, d), lambda p: abs(p[1] - p[2]) <= 1e-6)) AS equal FROM (SELECT vec_id, embedding::DOUBLE[] AS a, list_transform(embedding::DOUBLE[], lambda x: x + CASE WHEN vec_id % 3 = 0 THEN 2e-6 ELSE 5e-7 END) AS d FROM embeddings)")
def tolerant_equality(spark, sf_dir):
    e = b.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    off = F.when(F.col("vec_id") % 3 == 0, 2e-6).otherwise(5e-7)
    return e.select("vec_id", arrays_near(F.col("a"), F.transform("a", lambda x: x + off)).alias("equal"))


@R.query("SELECT o_custkey AS layer, coalesce(list_sort(list(o_orderkey) FILTER (o_orderstatus = 'F')), []) AS ids, count(*) FILTER (o_orderstatus = 'F') AS n FROM orders GROUP BY ALL")
def src_null_list_empty(spark, sf_dir):
    o = b.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("layer")).agg(F.collect_list(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("found"))
    ids = F.coalesce(F.when(F.size("found") > 0, F.array_sort("found")), F.array().cast("array<bigint>"))  # a null list is an empty one
    return o.select("layer", ids.alias("ids"), F.size(ids).cast("long").alias("n"))


@R.query("SELECT DISTINCT (o_orderkey // 100)::BIGINT AS page FROM orders WHERE (o_orderkey // 100) NOT IN (SELECT l_orderkey // 100 FROM lineitem WHERE l_linenumber = 7 AND l_returnflag = 'R')")
def cache_reuse_antijoin(spark, sf_dir):
    """Pages of orders that are not cached."""
    wanted = b.table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 100).alias("page")).distinct()
    cached = b.table(spark, sf_dir, "lineitem").filter("l_linenumber = 7 and l_returnflag = 'R'").select(F.floor(F.col("l_orderkey") / 100).alias("page"))
    return wanted.join(cached, "page", "left_anti")


@R.query("""SELECT p_partkey, name, CASE WHEN regexp_matches(lower(name), '\\.(shp|gpkg|geojson)$') THEN 'vector' WHEN regexp_matches(lower(name), '\\.tif\\.vat\\.dbf$') THEN 'classes' WHEN regexp_matches(lower(name), '\\.tif$') THEN 'raster' ELSE 'other' END AS kind, contains(name, '..') OR starts_with(name, '/') AS unsafe
FROM (SELECT p_partkey, CASE WHEN p_size % 11 = 0 THEN '../' ELSE '' END || replace(p_type, ' ', '/') || CASE p_size % 5 WHEN 0 THEN '.SHP' WHEN 1 THEN '.gpkg' WHEN 2 THEN '.tif' WHEN 3 THEN '.tif.vat.dbf' ELSE '.txt' END AS name FROM part)""")
def zip_member_classify(spark, sf_dir):
    from ..sources.archives import member_kind, member_unsafe

    end = F.element_at(F.array(*(F.lit(x) for x in (".SHP", ".gpkg", ".tif", ".tif.vat.dbf", ".txt"))), (F.col("p_size") % 5 + 1).cast("int"))
    name = F.concat(F.when(F.col("p_size") % 11 == 0, "../").otherwise(""), F.translate("p_type", " ", "/"), end)
    return b.table(spark, sf_dir, "part").select("p_partkey", name.alias("name")).select("p_partkey", "name", member_kind(F.col("name")).alias("kind"), member_unsafe(F.col("name")).alias("unsafe"))


@R.query("WITH m AS (SELECT o_orderpriority AS component, min(o_orderkey) AS at FROM orders GROUP BY ALL) SELECT component, o.o_custkey AS artifact FROM m JOIN orders o ON o.o_orderkey = m.at")
def manifest_layer_lookup(spark, sf_dir):
    """The first layer of each component in the order of the manifest."""
    from ..sources.manifest import first_layers

    entries = b.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("component"), F.col("o_custkey").alias("artifact"), F.col("o_orderkey").alias("seq"))
    return first_layers(entries)


@R.query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256, md5(coalesce(text, '')) AS md5 FROM documents")
def content_sha256(spark, sf_dir):
    t = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    return b.table(spark, sf_dir, "documents").select("doc_id", F.sha2(t, 256).alias("sha256"), F.md5(t).alias("md5"))


@R.query("""SELECT o_custkey AS grp, CASE WHEN min(o_orderkey) FILTER (o_orderkey % 3 = 0) IS NULL THEN NULL ELSE arg_min(o_orderstatus, o_orderkey) FILTER (o_orderkey % 3 = 0) END AS source,
count(*) FILTER (o_orderkey <= coalesce(m, 9223372036854775807)) AS attempts FROM (SELECT *, min(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END) OVER (PARTITION BY o_custkey) AS m FROM orders) GROUP BY o_custkey""")
def terrain_select(spark, sf_dir):
    o = b.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("priority"), F.col("o_orderstatus").alias("source"), (F.col("o_orderkey") % 3 == 0).alias("valid"))
    return checks.choose_first_valid(o, "grp")


# what the eight kinds of changes of the documents come to: the number of values that differ
@R.query("""SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 4 THEN 4 WHEN 5 THEN 2 WHEN 0 THEN 0 WHEN 1 THEN 0 ELSE 1 END AS differences FROM orders""")
def nested_equality(spark, sf_dir):
    """Features as nested documents against copies of which some are changed, numbers within the tolerance aside."""
    k = F.col("o_orderkey")
    o = b.table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_orderstatus").alias("status"), (k % 1000 / 8.0).alias("y"), (k % 8).alias("kind"))
    left = o.select("id", F.format_string('{"id": %d, "geometry": {"paths": [[[1.5, %s], [2.5, 3]]]}, "attributes": {"name": "%s", "n": null}}', "id", F.col("y").cast("string"), "status").alias("document"))
    moved = F.when(F.col("kind") == 1, 5e-7).when(F.col("kind") == 2, 2e-6).otherwise(0.0)
    number = F.when(F.col("kind") == 7, F.concat(F.lit('"'), F.col("id").cast("string"), F.lit('"'))).otherwise(F.col("id").cast("string"))
    more = F.when(F.col("kind") == 4, ", [7, 8]").otherwise("")
    name = F.when(F.col("kind") == 3, F.concat("status", F.lit("!"))).otherwise(F.col("status"))
    n = F.when(F.col("kind") == 5, "").when(F.col("kind") == 6, ', "n": 0').otherwise(', "n": null')
    right = o.select("id", F.format_string('{"attributes": {"name": "%s"%s}, "id": %s, "geometry": {"paths": [[[1.5, %s], [2.5, 3.0]%s]]}}', name, n, number, (F.col("y") + moved).cast("string"), more).alias("document"))
    bad = nested.differences(left, right, ["id"]).groupBy("id").agg(F.count("*").alias("differences"))
    return o.select("id").join(bad, "id", "left").na.fill(0, ["differences"])
