"""URL filters by association rules.

Each url becomes a set of typed tokens (host labels, path segments, query keys; digits as ``#``).
FP-growth over the labelled pages finds token sets that go with the label ``block``; tokens that stand on the
same pages are mined as one, so a long url on many pages gives no sets of its own tokens. Rules below a
support or confidence, rules that chance explains (given the number of sets looked at), and rules that one with a token
less and as much confidence makes needless are pruned. Pages meet rules by an inverted index on each rule's rarest token. A short list of written
rules (host and path prefix) decides first.

Defined results: a null url, or one without ``://``, has an empty host and path, no token and the
verdict ``allow``; equal urls have equal verdicts; of written rules that fit, the longest wins; of mined
rules, the surest, then the last in token order; repeated page_ids are judged each; long urls whole; other
columns, of any name, are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table, salted_join

LABEL = "=block"
#: A rule needs this share of the labelled pages, and so many pages (all of them where there are fewer).
MIN_SUPPORT, MIN_PAGES = 0.002, 10
MIN_CONFIDENCE = 0.5
#: Rules that chance alone would give are expected in this share of cases at most, over all sets looked at.
CHANCE = 0.05
#: Mined rules are broadcast up to so many, else joined by a shuffle.
BROADCAST_RULES = 100_000
#: (action, rule), a rule being host and path prefix.
WRITTEN_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", group), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(_part(url, 1), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return _part(url, 2)


def url_tokens(url: Column) -> Column:
    """Distinct typed tokens of a url."""
    masked = lambda c: F.regexp_replace(c, "[0-9]+", "#")
    typed = lambda kind, c: F.transform(F.filter(c, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    query = F.coalesce(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.lit(""))
    keys = F.transform(F.split(query, "&"), lambda x: F.split(x, "=")[0])
    return F.array_distinct(F.concat(typed("h:", F.split(masked(host_of(url)), r"\.")), typed("p:", F.split(masked(path_of(url)), "/")), typed("q:", keys)))


def written_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(size, rule, action) of the longest written rule that fits; null if none does."""
    found = []
    for action, rule in rules:
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        found.append(F.when(fits, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(action).alias("action"))))
    return F.array_max(F.array(*found)) if found else F.lit(None).cast("struct<size:int,rule:string,action:string>")


def merge_equal_tokens(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items with one token for all that stand in the same rows; token, rep of every token): items(row, items).

    Rows are compared by their number and two 64-bit sums of hashes."""
    tokens = items.select("row", F.explode("items").alias("token"))
    rows = tokens.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("a"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("b"))
    first = rows.groupBy("n", "a", "b").agg(F.min("token").alias("rep"))
    reps = materialise(rows.join(first, ["n", "a", "b"]).select("token", "rep"), "url-tokens")
    short = salted_join(tokens, reps, "token").groupBy("row").agg(F.collect_set("rep").alias("items"))
    return short, reps


def beyond_chance(rules: DataFrame, n: int, base: float, candidates: int, chance: float = CHANCE) -> DataFrame:
    """Rules whose hits a binomial of the base rate reaches with less than chance / candidates, by Chernoff's bound; all with an infinite chance."""
    if math.isinf(chance):
        return rules
    hits, share = F.col("support") * n, F.col("confidence")
    part = lambda x, y: F.when(x > 0, x * F.log(x / F.lit(y))).otherwise(0.0)
    divergence = part(share, max(base, 1e-300)) + part(1 - share, max(1 - base, 1e-300))
    return rules.filter((share > base) & (hits / share * divergence >= math.log(max(candidates, 1) / chance)))


def mine_rules(pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, chance: float = CHANCE) -> DataFrame:
    """antecedent, confidence, support, lift of token sets that go with low quality or toxicity.

    pages: id and url; labels: the same id and a boolean `block`. Labelled rows count, equal urls included."""
    spark = pages.sparkSession
    labelled = pages.join(labels, "id").select(url_tokens(F.col("url")).alias("items"), "block").filter(F.size("items") > 0)
    labelled = materialise(labelled.withColumn("row", F.monotonically_increasing_id()), "url-items")
    n, blocked = labelled.agg(F.count("*"), F.count_if("block")).first()
    if not n or not blocked:
        return spark.createDataFrame([], "antecedent array<string>, confidence double, support double, lift double")
    merged, reps = merge_equal_tokens(labelled.select("row", "items"))
    items = salted_join(labelled.select("row", "block"), merged, "row", salts=1).select(F.concat("items", F.when(F.col("block"), F.array(F.lit(LABEL))).otherwise(F.array().cast("array<string>"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, MIN_PAGES / n)), minConfidence=min_confidence, numPartitions=int(spark.conf.get("spark.sql.shuffle.partitions"))).fit(items)
    candidates = model.freqItemsets.filter(~F.array_contains("items", LABEL)).count()
    rules = model.associationRules.filter(F.array_contains("consequent", LABEL)).select("antecedent", "confidence", "support", "lift")
    rules = materialise(beyond_chance(rules, n, blocked / n, candidates, chance).withColumn("rule", F.monotonically_increasing_id()), "url-rules")
    # a rule of merged tokens holds for each of them: all choices of one token for each place
    kinds = rules.select("rule", F.posexplode("antecedent").alias("place", "rep")).join(reps, "rep").groupBy("rule", "place").agg(F.collect_set("token").alias("tokens")).groupBy("rule").agg(F.collect_list("tokens").alias("choices"))
    sets = F.aggregate("choices", F.array(F.array().cast("array<string>")), lambda sets, tokens: F.flatten(F.transform(sets, lambda x: F.transform(tokens, lambda t: F.array_append(x, t)))))
    rules = rules.drop("antecedent").join(kinds, "rule").select(F.explode(sets).alias("antecedent"), "confidence", "support", "lift").withColumn("antecedent", F.array_sort("antecedent"))
    rules = materialise(rules, "url-rules")
    shorter = rules.select(F.col("antecedent").alias("part"), F.col("confidence").alias("as_sure"))
    # a rule is needless if dropping a token leaves a rule at least as sure; parts are looked up, not compared pairwise
    parts = rules.select("antecedent", "confidence", F.explode(F.transform("antecedent", lambda x: F.array_except(F.col("antecedent"), F.array(x)))).alias("part"))
    needless = parts.join(shorter, "part").filter("as_sure >= confidence").select("antecedent").distinct()
    return rules.join(needless, "antecedent", "left_anti")


def index_rules(rules: DataFrame) -> DataFrame:
    """The inverted index: each rule under its token that the fewest rules share."""
    tokens = rules.select("antecedent", "confidence", F.explode("antecedent").alias("token"))
    common = tokens.groupBy("token").agg(F.count("*").alias("n"))
    return tokens.join(common, "token").groupBy("antecedent").agg(F.min_by("token", F.struct("n", "token")).alias("token"), F.first("confidence").alias("confidence"))


def judge(pages: DataFrame, mined: DataFrame, written: list[tuple[str, str]] = WRITTEN_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule, confidence for pages(page_id, url)."""
    index = materialise(index_rules(mined), "url-index")
    if index.count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    urls = pages.select("url").filter("url is not null").distinct()
    hits = (urls.select("url", url_tokens(F.col("url")).alias("tokens")).withColumn("token", F.explode("tokens"))
        .join(index, "token").filter(F.size(F.array_except("antecedent", "tokens")) == 0)
        .groupBy("url").agg(F.max(F.struct("confidence", "antecedent")).alias("best")))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    # null urls and a popular url have many rows
    return (salted_join(pages.select("page_id", "url"), hits, "url", "left")
        .select("page_id", "best", host.alias("host"), path.alias("path"))
        .withColumn("w", written_rule(F.col("host"), F.col("path"), written))
        .select("page_id", "host", "path", F.col("w.rule").alias("rule"),
                F.coalesce(F.col("w.action"), F.when(F.col("best").isNotNull(), "block").otherwise("allow")).alias("verdict"),
                F.array_join("best.antecedent", " ").alias("mined_rule"), F.col("best.confidence").alias("confidence")))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", F.col("url").cast("string").alias("url"))
    labels = (read_table(spark, sf_dir, "labels").filter("doc_id is not null").groupBy(F.col("doc_id").alias("id"))
        .agg(F.coalesce(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)), F.lit(False)).alias("block")))
    return judge(pages, mine_rules(pages.withColumnRenamed("page_id", "id"), labels))
