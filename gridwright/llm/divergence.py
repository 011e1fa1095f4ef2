"""Divergence of sources: which sources of a language use other words than the rest, and which words.

A group is a language and a source. Term counts of all groups become packed vectors, one for each
group and chunk of the vocabulary. Groups are dealt to blocks; a pair of blocks is a tile, and each
vector is sent to the tiles of its block. A tile walks the chunks of the vocabulary one after another
and adds up the submatrix of its pairs, so it holds two blocks of one chunk at a time, whatever the
vocabulary and however many sources there are. A tile is also cut into spans of chunks, whose
submatrices are summed. All arithmetic is on whole numbers.

Defined results: null text, lang and source count as ''; a row is a document, so repeated rows count
each; a group without terms still has its pairs, and a language with one source has none; a language
without kept terms has pairs of value 0; ties go to the smaller item in UTF-8 order; long texts count
whole, piece by piece in bounded memory; other columns, of any name, are not read; an empty table
gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, join_few, materialise, read_table, release

#: A term stands in so many documents of its language at least.
MIN_DOCUMENTS = 3
TOP_TERMS = 200
#: Terms in a chunk of the vocabulary, groups in a block and chunks in a span, each on average.
CHUNK_TERMS, BLOCK_GROUPS, SPAN_CHUNKS = 1 << 14, 32, 64
#: Counted terms that a task holds before it passes them on.
HELD_TERMS = 400_000
#: Characters of a text that are cut into terms at once.
PIECE = 1 << 20

# Term characters: ASCII letters, lower-cased, and all beyond ASCII; the rest separates.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in lists of bounded size; no term is cut."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE) if at + PIECE < len(data) else -1
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs; the term '' stands for the group itself, with n and docs 0."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def passed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in held.items():
                n[b""] = d[b""] = 0
                every = list(n)
                for at in range(0, len(every), 50_000):
                    terms = every[at : at + 50_000]
                    columns = [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(map(n.__getitem__, terms), pa.int64()), pa.array(map(d.__getitem__, terms), pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                before, kinds = len(n), set()
                for terms in terms_of(text):
                    n.update(terms)
                    kinds.update(terms)
                d.update(kinds)
                size += len(n) - before
            if size > HELD_TERMS or len(held) > HELD_TERMS // 100:
                yield from passed_on()
                size = 0
        yield from passed_on()

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(text("lang"), text("source"), text("text")).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str) -> str:
    """SQL for 1 + floor(10^9 * (count + 1) / total) in two steps, which stay in a long up to counts of 9 * 10^13."""
    high = f"100000 * ({count} + 1)"
    return f"1 + 10000 * ({high} div {total}) + (10000 * (({high}) % {total})) div {total}"


def _share(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    whole, rest = np.divmod(100_000 * (count + 1), total)
    return 1 + 10_000 * whole + 10_000 * rest // total


def pack(places: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted places in a chunk and their counts, in as few bytes each as the largest needs."""
    order = np.argsort(places)
    kinds = [np.min_scalar_type(int(x.max(initial=0))) for x in (places, counts)]
    head = np.array([len(places), kinds[0].itemsize, kinds[1].itemsize], "<u4").tobytes()
    return head + places[order].astype(kinds[0]).tobytes() + counts[order].astype(kinds[1]).tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, a, b = np.frombuffer(data, "<u4", 3).tolist()
    return np.frombuffer(data, f"<u{a}", n, 12).astype(np.int64), np.frombuffer(data, f"<u{b}", n, 12 + a * n).astype(np.int64)


class Tile:
    """The pairs of two blocks of groups, added up chunk by chunk."""

    def __init__(self, groups: list[list[tuple[str, int]]]):
        """groups: (source, N + V) by block; one block on the diagonal."""
        self.groups = groups
        self.places = [{source: i for i, (source, _) in enumerate(block)} for block in groups]
        self.totals = [np.array([total for _, total in block], np.int64) for block in groups]
        a, b = len(groups[0]), len(groups[-1])
        self.forth, self.back, self.seen = np.zeros((a, b), np.int64), np.zeros((b, a), np.int64), 0

    def add(self, vectors: list[tuple[int, str, bytes]]) -> None:
        """vectors: (block, source, packed counts) of one chunk."""
        opened = [(block, self.places[block][source], *unpack(data)) for block, source, data in vectors]
        union = np.unique(np.concatenate([places for _, _, places, _ in opened]))
        self.seen += len(union)
        p = [np.repeat(_share(np.zeros(len(t), np.int64), t)[:, None], len(union), 1) for t in self.totals]
        for block, i, places, counts in opened:
            p[block][i, np.searchsorted(union, places)] = _share(counts, self.totals[block][i])
        for i, row in enumerate(p[0]):
            squares = (row - p[-1]) ** 2
            self.forth[i] += (squares // p[-1]).sum(1)
            if len(p) > 1:
                self.back[:, i] += (squares // row).sum(1)

    def pairs(self) -> Iterator[tuple[str, str, int, int, int, int]]:
        """source, item, value, terms looked at, N + V of both."""
        for matrix, one, other in [(self.forth, 0, -1), (self.back, -1, 0)][: len(self.groups)]:
            for i, (source, total) in enumerate(self.groups[one]):
                for j, (item, item_total) in enumerate(self.groups[other]):
                    if source != item:
                        yield source, item, int(matrix[i, j]), self.seen, total, item_total


def _packed(kept: DataFrame) -> DataFrame:
    """lang, source, chunk, counts: one packed vector for each group and chunk of the vocabulary."""
    rows = kept.groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct("place", "n")).alias("entries"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries = batch.column("entries")
            flat, ends = entries.flatten(), entries.offsets.to_numpy() - entries.offsets[0].as_py()
            places, n = flat.field("place").to_numpy().astype(np.int64), flat.field("n").to_numpy()
            packed = [pack(places[a:b], n[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("source"), batch.column("chunk"), pa.array(packed, pa.binary())], ["lang", "source", "chunk", "counts"])

    return rows.mapInArrow(run, "lang string, source string, chunk long, counts binary")


def _tiled(rows: DataFrame) -> DataFrame:
    """Each row once for each tile of its block: the pairs of the block with every block, the smaller one first."""
    tiles = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: F.struct(F.least(x, "block").alias("one"), F.greatest(x, "block").alias("other")))
    return rows.withColumn("tile", F.explode(tiles)).select("*", "tile.*").withColumn("side", (F.col("block") != F.col("one")).cast("int"))


def pair_sums(headers: DataFrame, vectors: DataFrame) -> DataFrame:
    """lang, source, item, value, seen, total, item_total of every ordered pair of groups, summed over the spans of the vocabulary.

    headers: lang, source, block, blocks, spans, total; vectors: lang, source, block, blocks, chunk, counts."""
    spark = headers.sparkSession
    bounded_batches(spark)
    columns = ["lang", "one", "other", "span", "chunk", "side", "source", "total", "counts"]
    every = headers.withColumn("span", F.explode(F.sequence(F.lit(0).cast("long"), F.col("spans") - 1))).withColumn("chunk", F.lit(-1).cast("long")).withColumn("counts", F.lit(None).cast("binary"))
    sent = vectors.withColumn("span", F.expr(f"chunk div {SPAN_CHUNKS}")).withColumn("total", F.lit(0).cast("long"))
    rows = _tiled(every).select(columns).unionByName(_tiled(sent).select(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True))
        for (lang, one, other, _), of_tile in groupby(stream, key=lambda r: r[:4]):
            tile = None
            for _, of_chunk in groupby(of_tile, key=lambda r: r[4]):
                if tile is None:
                    blocks: list[list[tuple[str, int]]] = [[] for _ in range(1 + (one != other))]
                    for r in of_chunk:
                        blocks[r[5]].append((r[6], r[7]))
                    tile = Tile(blocks)
                else:
                    tile.add([(r[5], r[6], r[8]) for r in of_chunk])
            pairs = list(tile.pairs())
            if pairs:
                made = [pa.array([lang] * len(pairs)), *(pa.array(x, kind) for x, kind in zip(zip(*pairs, strict=True), [pa.string()] * 2 + [pa.int64()] * 4, strict=True))]
                yield pa.RecordBatch.from_arrays(made, ["lang", "source", "item", "value", "seen", "total", "item_total"])

    parts = (rows.repartition("lang", "one", "other", "span").sortWithinPartitions("lang", "one", "other", "span", "chunk", "side", "source")
        .mapInArrow(run, "lang string, source string, item string, value long, seen long, total long, item_total long"))
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.max("total").alias("total"), F.max("item_total").alias("item_total"))


def _ranked(rows: DataFrame, part: str, most: int | None = None) -> DataFrame:
    order = [F.desc("value"), "item"]
    if most is not None:  # first among a share of the group's items, so that no task meets all of them
        rows = rows.withColumn("_share", F.pmod(F.xxhash64("item"), F.lit(64)))
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "_share").orderBy(*order))).filter(F.col("rank") <= most)
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))
    out = out.filter(F.col("rank") <= most) if most is not None else out
    return out.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def divergence(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top_terms: int = TOP_TERMS, chunk_terms: int = CHUNK_TERMS, block_groups: int = BLOCK_GROUPS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank.

    pair: how far the group's shares are from each other source's of its language; term: the terms
    that the group uses more than its language does, the most telling first."""
    counts = materialise(count_terms(docs), "divergence-counts")
    of_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter((F.col("docs") >= min_documents) & (F.col("term") != "")).drop("docs")
    terms = materialise(of_lang, "divergence-terms")
    sizes = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    numbers = counts.filter("term = ''").groupBy("lang").agg(F.count("*").alias("groups")).join(sizes, "lang", "left").na.fill(0, ["v", "lang_total"])
    # a row a language
    langs = numbers.selectExpr("lang", "v", "lang_total + v as lang_total", f"(groups + {block_groups - 1}) div {block_groups} as blocks", f"greatest(1, (v + {chunk_terms - 1}) div {chunk_terms}) as chunks")
    langs = langs.withColumn("spans", F.expr(f"(chunks + {SPAN_CHUNKS - 1}) div {SPAN_CHUNKS}"))
    langs = materialise(langs, "divergence-langs")
    chunked = join_few(terms, langs.select("lang", "chunks"), "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), "chunks")).drop("chunks")
    placed = chunked.withColumn("place", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1)
    kept = materialise(counts.filter("n > 0").drop("docs").join(placed, ["lang", "term"]), "divergence-kept")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.filter("term = ''").select("lang", "source").join(sums, ["lang", "source"], "left")
    groups = join_few(groups, langs, "lang")
    groups = materialise(groups.select("lang", "source", (F.coalesce("total", F.lit(0)) + F.col("v")).alias("total"), "lang_total", "v", "blocks", "spans", F.pmod(F.xxhash64("source"), "blocks").alias("block")), "divergence-groups")
    release(counts, terms, langs)

    vectors = join_few(_packed(kept), groups.select("lang", "source", "block", "blocks"), ["lang", "source"])
    pairs = pair_sums(groups.select("lang", "source", "block", "blocks", "spans", "total"), vectors)
    pairs = join_few(pairs, groups.select("lang", "source", "v"), ["lang", "source"])
    # terms that neither group of a pair has are alike: one value, times their number; without kept terms totals are 0
    unseen = pairs.withColumn("p", F.expr(share("0", "greatest(1, total)"))).withColumn("q", F.expr(share("0", "greatest(1, item_total)")))
    pairs = unseen.withColumn("value", F.expr("value + (v - seen) * (((p - q) * (p - q)) div q)"))

    used = join_few(kept, groups.select("lang", "source", "total", "lang_total"), ["lang", "source"])
    used = used.withColumn("p", F.expr(share("n", "total"))).withColumn("q", F.expr(share("lang_n", "lang_total"))).filter("p > q")
    used = used.select("lang", "source", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div q").alias("value"))
    return _ranked(pairs, "pair").unionByName(_ranked(used, "term", top_terms))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH docs AS (
    SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
    FROM documents),
used AS (SELECT lang, source, unnest(terms) AS term FROM docs),
known AS (
    SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM docs)
    GROUP BY lang, term HAVING count(*) >= 3),
kept AS (SELECT lang, source, term, count(*) AS n FROM used SEMI JOIN known USING (lang, term) GROUP BY lang, source, term),
vocabulary AS (SELECT lang, count(*) AS v FROM known GROUP BY lang),
groups AS (
    SELECT g.lang, g.source, CAST(coalesce(sum(k.n), 0) AS BIGINT) AS total, coalesce(max(y.v), 0) AS v
    FROM (SELECT DISTINCT lang, source FROM docs) g
    LEFT JOIN kept k ON k.lang = g.lang AND k.source = g.source LEFT JOIN vocabulary y ON y.lang = g.lang
    GROUP BY g.lang, g.source),
shares AS (
    SELECT g.lang, g.source, t.term, coalesce(k.n, 0) AS n, 1 + (1000000000 * (coalesce(k.n, 0) + 1)) // (g.total + g.v) AS p
    FROM groups g JOIN known t ON t.lang = g.lang
    LEFT JOIN kept k ON k.lang = g.lang AND k.source = g.source AND k.term = t.term),
lang_counts AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM kept GROUP BY lang, term),
lang_shares AS (
    SELECT lang, term, 1 + (1000000000 * (n + 1)) // (CAST(sum(n) OVER (PARTITION BY lang) AS BIGINT) + count(*) OVER (PARTITION BY lang)) AS q
    FROM lang_counts),
pair_values AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS f
    FROM shares a JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source
    GROUP BY a.lang, a.source, b.source),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, CAST(coalesce(x.f, 0) AS BIGINT) AS value
    FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
    LEFT JOIN pair_values x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
telling AS (
    SELECT s.lang, s.source, s.term AS item, ((s.p - l.q) * (s.p - l.q)) // l.q AS value
    FROM shares s JOIN lang_shares l ON l.lang = s.lang AND l.term = s.term WHERE s.n > 0 AND s.p > l.q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT * FROM (
    SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM telling)
WHERE rank <= 200
"""
