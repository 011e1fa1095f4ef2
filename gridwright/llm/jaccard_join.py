"""N-gram Jaccard join over size-banded tiles with hashed bitmap signatures.

Documents with equal shingle sets form one class; classes are what is joined. Each class sends its first
shingles in one order of all shingles (common ones last, else by hash), so many that linked sets have
``need`` of them in common. A class with fewer of them that any other class holds links with nothing.
Of what is left, only the rarest shingles are keys: one more than may be missing from `need`. Classes that
share a key, through others too, are a group; a group is compared in tiles, whole where it is small, else
by blocks of (size band, part). Inside a tile, the bits in which two hashed bitmaps differ bound the
overlap from above; sets that pass are intersected as sorted arrays. Links already implied by earlier ones
of the tile are not looked at again.

Links are those with 100 * intersection >= percent * union. Defined results: fewer words than a
shingle make one shingle of the whole sequence; null, empty and blank texts have an empty set, link
with nothing and are their own component; repeated doc_ids are one document to a component, with the links
of all their texts; other columns, of any name, play no part; a null doc_id links with nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_SPACE, bounded, lower_bytes, map_batches, materialise, read_table, release, shingle_hashes, word_hashes
from .components import connected_components

#: A tile is one block or a pair of them; a block's classes, times the size of the largest, make so many at most.
BLOCK = 1 << 21
#: Share of a set, as 1 / KEEP, by which the shingles that it sends exceed what a linked set may lack.
KEEP = 8
#: A shingle that a share of the sampled classes holds is common: it comes last in the order, which loses no link.
SAMPLE_CLASSES, COMMON_SHARE = 20_000, 0.005


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(lower_bytes(text), NOT_SPACE), words))


def set_name(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=12).digest()


def least_common(n, percent: int):
    """Shingles that a set of n shares with any set that it links with."""
    return -(-percent * n // 100)


def kept(n: int) -> int:
    return max(1, n // KEEP)


def need(n: int, percent: int) -> int:
    """Sent shingles that a set of n has in common with those of any set that it links with.

    Of two linked sets the first kept(smaller) common shingles are among those that both send."""
    return kept(least_common(n, percent))


def sent(shingles: np.ndarray, percent: int, common: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set, common ones last."""
    n = len(shingles)
    if not n:
        return shingles
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        last = common[at] == shingles
        shingles = np.concatenate((shingles[~last], shingles[last]))
    return shingles[: n - least_common(n, percent) + kept(n)]


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, set_id (null for an empty set)."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(t, words) for t in batch.column("text").to_pylist()]
            ids = [set_name(s) if len(s) else None for s in sets]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, sets), pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_shingles", "set_id"])

        return each

    return map_batches(docs.select("doc_id", "text"), "doc_id long, n_shingles long, set_id binary", make)


def common_shingles(heads: DataFrame, n_classes: int, words: int) -> np.ndarray:
    """Shingles that COMMON_SHARE of about SAMPLE_CLASSES classes hold, at most len / COMMON_SHARE of them.

    They only order the shingles: every order gives the same links, this one keeps their keys short."""
    share = min(1.0, SAMPLE_CLASSES / max(n_classes, 1))
    picked = heads.filter(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20)))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(t, words) for t in batch.column("text").to_pylist()]
            kinds, n = np.unique(np.concatenate(sets), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(n, pa.int64())], ["key", "n"])

        return each

    found = map_batches(picked.select("text"), "key long, n long", make).groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(64, COMMON_SHARE * share * n_classes))
    return np.sort(np.array([r.key for r in found.select("key").collect()], np.int64).view(np.uint64))


def sent_keys(heads: DataFrame, percent: int, words: int, common: np.ndarray) -> DataFrame:
    """node, key for heads(node, tag, text)."""
    send = heads.sparkSession.sparkContext.broadcast(common)  # a bounded list, see common_shingles

    def make():
        common = send.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [sent(s, percent, common) for s in own_sets(batch, words)]
            nodes = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), [len(k) for k in found])
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(np.concatenate(found).view(np.int64))], ["node", "key"])

        return each

    return map_batches(heads.select("node", "tag", "text"), "node long, key long", make)


def rare_keys(keyed: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """node, key: the keys by which linked classes meet; classes that can link with nothing have none."""
    # dealt out by key once, for the keys' counts and for the join with them: the filter that the join
    # implies is written out, so that both share the exchange
    keyed = keyed.filter("node is not null and key is not null").repartition("key")
    shared = keyed.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count("*").alias("n")).filter("first < last").select("key", "n")
    both = keyed.join(shared.hint("merge"), "key")
    found = both.groupBy("node").agg(F.collect_set(F.struct("n", "key")).alias("keys")).filter(F.col("node").isNotNull())
    least = F.expr(f"greatest(1, ceil({percent} * n_shingles / 100) div {KEEP})").cast("int")
    sized = found.join(classes.select("node", least.alias("need")), "node").filter(F.size("keys") >= F.col("need"))
    return sized.select("node", F.explode(F.slice(F.array_sort("keys"), F.lit(1), F.size("keys") - F.col("need") + 1)).alias("k")).select("node", "k.key")


def tile_links(ids: np.ndarray, sets: list[np.ndarray], percent: int, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of a tile that join its classes into components: all links' components, fewest rows.

    With `left`, only pairs of one class inside it and one outside are compared."""
    n = len(ids)
    order = np.argsort([len(s) for s in sets], kind="stable")
    ids, sets = ids[order], [sets[i] for i in order]
    side = left[order] if left is not None else None
    size = np.array([len(s) for s in sets])
    width = max(64, 1 << int(np.ceil(np.log2(4 * size[-1])))) if n else 64
    maps = np.zeros((n, width // 64), np.uint64)
    for i, s in enumerate(sets):
        bit = s & np.uint64(width - 1)
        np.bitwise_or.at(maps[i], (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    root = np.arange(n)
    out = []
    for i in range(n - 1):
        end = int(np.searchsorted(size, 100 * size[i] // percent, side="right"))
        at = np.arange(i + 1, end)
        if side is not None:
            at = at[side[at] != side[i]]
        at = at[root[at] != root[i]]
        if not len(at):
            continue
        # the overlap is at most half of what is left of both sizes after the bits that differ
        differ = np.bitwise_count(maps[at] ^ maps[i]).sum(1, dtype=np.int64)
        both = size[at] + size[i]
        upper = (both - differ) // 2
        for j in at[100 * upper >= percent * (both - upper)]:
            if root[j] == root[i]:
                continue
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * common >= percent * (size[i] + size[j] - common):
                out.append((int(ids[i]), int(ids[j])))
                root[root == root[j]] = root[i]
    return out


def assign_tiles(members: DataFrame, percent: int) -> DataFrame:
    """node, tile, left: the tiles that each class of members(node, component, n_shingles) belongs to.

    A component of one block is one tile. Larger ones are dealt into (size band, block); a tile is a
    pair of blocks of the same or neighbouring bands, `left` tells the two apart."""
    sizes = members.groupBy("component").agg((F.count("*") * F.max("n_shingles")).alias("weight"))
    known = members.join(sizes, "component")
    one = known.filter(F.col("weight") <= BLOCK).select("node", F.concat_ws(":", F.lit("c"), "component").alias("tile"), F.lit(None).cast("boolean").alias("left"))
    # bands as wide as the sizes that can link, so that partners are in the same or the next band
    banded = known.filter(F.col("weight") > BLOCK).withColumn("band", F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int"))
    blocks = banded.groupBy("component", "band").agg(F.ceil(F.count("*") * F.max("n_shingles") / BLOCK).cast("int").alias("blocks"))
    nearby = blocks.select("component", "blocks", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.col("band").alias("other"))
    dealt = banded.join(blocks, ["component", "band"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("blocks")
    pairs = (dealt.join(nearby, ["component", "band"])
        .withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("mine", F.struct("band", "block")).withColumn("theirs", F.struct(F.col("other").alias("band"), F.col("partner").alias("block"))))
    key = lambda s: F.concat_ws(".", F.col(f"{s}.band"), F.col(f"{s}.block"))
    first = F.col("mine") <= F.col("theirs")
    many = pairs.select("node", F.concat_ws(":", F.lit("b"), "component", F.when(first, key("mine")).otherwise(key("theirs")), F.when(first, key("theirs")).otherwise(key("mine"))).alias("tile"), F.when(F.col("mine") == F.col("theirs"), F.lit(None)).otherwise(first).alias("left"))
    return one.union(many)


def classes_of(sig: DataFrame) -> DataFrame:
    """set_id, n_shingles, doc_id (the smallest), node, tag of each class of equal sets.

    node is doc_id, but for a doc_id that heads several classes (rows that repeat it with other texts):
    there all classes but one get a negative hash, so that a node is one class."""
    heads = sig.filter("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"))
    again = heads.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("set_id").alias("least"))
    node = F.when((F.col("n") == 1) | (F.col("set_id") == F.col("least")), F.col("doc_id")).otherwise(-F.abs(F.xxhash64("set_id", "doc_id")))
    tag = F.conv(F.hex(F.substring("set_id", 1, 7)), 16, 10).cast("long")
    return heads.join(again, "doc_id").select("set_id", "n_shingles", "doc_id", node.alias("node"), tag.alias("tag"))


def own_sets(batch: pa.RecordBatch, words: int) -> list[np.ndarray]:
    """The shingle sets of rows (tag, text); empty where a row of the same doc_id is of another class."""
    out, last, made = [], None, None
    for tag, text in zip(batch.column("tag").to_pylist(), batch.column("text").to_pylist(), strict=True):
        if made is None or text != last:
            last, made = text, shingle_set(text, words)
            own = int.from_bytes(set_name(made)[:7], "big") if len(made) else None
        out.append(made if tag == own else made[:0])
    return out


def jaccard_components(docs: DataFrame, percent: int = 90, words: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id for docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = materialise(signatures(docs, words), "signatures")
    classes = materialise(classes_of(sig), "classes")
    heads = docs.join(bounded(classes.select("doc_id", "node", "tag")), "doc_id")
    common = common_shingles(heads, classes.count(), words)
    keys = materialise(rare_keys(sent_keys(heads, percent, words, common), classes, percent), "keys")
    shared = keys.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first < last").select("key", "first")
    links = keys.join(shared, "key").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = connected_components(links, "near")
    members = materialise(near.join(classes.select("node", "n_shingles", "doc_id", "tag"), "node"), "members")
    tiles = materialise(assign_tiles(members, percent).join(members.select("node", "doc_id", "tag"), "node"), "tiles")
    release(keys, near, members)

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [s.tobytes() for s in own_sets(batch, words)]
            return pa.RecordBatch.from_arrays([batch.column("node"), batch.column("tile"), batch.column("left"), pa.array(sets, pa.binary())], ["node", "tile", "left", "shingles"])

        return each

    texts = docs.join(bounded(tiles), "doc_id").select("node", "tile", "left", "tag", "text")
    sets = map_batches(texts, "node long, tile string, left boolean, shingles binary", make).filter("length(shingles) > 0")

    def compare(group: pa.Table) -> pa.Table:
        ids = group.column("node").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
        sides = group.column("left")
        left = None if sides.null_count else sides.to_numpy().astype(bool)
        found = tile_links(ids, sets, percent, left)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    found = sets.groupBy("tile").applyInArrow(compare, "a long, b long")
    # classes of one doc_id are one document
    one = classes.filter("node <> doc_id").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    component = connected_components(found.union(one), "links")
    named = materialise(classes.select("set_id", "doc_id", "node").join(component, "node", "left"), "named")
    release(tiles, component, classes)
    smallest = named.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    named = named.join(smallest, "component", "left").select("set_id", F.coalesce("least", "doc_id").alias("c"))
    return sig.select("doc_id", "n_shingles", "set_id").join(named, "set_id", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate group; empty texts all stay."""
    first = materialise(jaccard_components(docs, percent, words).filter("component_id = doc_id").select("doc_id").distinct(), "kept")
    return docs.join(bounded(first), "doc_id", "left_semi").unionByName(docs.filter("doc_id is null"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))
