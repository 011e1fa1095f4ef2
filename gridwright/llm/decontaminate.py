"""Benchmark decontamination: BM25 over an inverted index of test items with block-max WAND.

Test items are the indexed side; every passage of every training document is a query. An item's term
weights are its BM25 weights divided by their sum, so a passage's score is the share of the item's
weight that it covers. Items of similar length share a block; the largest weights of the blocks
bound a passage's score from above, first for all passages of a batch at once, then in the cursor
walk that finds every item above the threshold. Hits are verified: five-word shingles of the item's
question and of its answer must both overlap the passage.

A passage is two neighbouring chunks, and a chunk is no shorter than the longest item, so no item is
cut by every passage. Defined results: null or empty texts and items without a word match nothing;
equal items are reported each; a document is reported once for each item, with its best passage.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_BYTES, bounded, lower_bytes, map_batches, materialise, read_table, shingle_hashes, word_hashes

K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.8
WORDS = 5
CHUNK = 64
BLOCKS = 64
#: Items in one index; more items make more indexes, each run over all documents in turn.
SHARD_ITEMS = 8192
SCHEMA = "doc_id {id}, item_id {item}, score double, passages int, question_overlap double, answer_overlap double"


def words_of(text: str | None) -> np.ndarray:
    return word_hashes(lower_bytes((text or "").lower()), WORD_BYTES)


def question_and_answer(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Words before and after the last question mark; without one, the first two thirds and the rest."""
    before, mark, after = text.rpartition("?")
    q, a = words_of(before), words_of(after)
    if mark and len(q) and len(a):
        return q, a
    words = words_of(text)
    cut = -(-2 * len(words) // 3)
    return words[:cut], words[cut:]


def overlap(part: np.ndarray, passage: np.ndarray) -> float:
    """Share of the part's distinct shingles that the passage holds; 1 for an empty part."""
    if not len(part):
        return 1.0
    k = min(WORDS, len(part))
    return float(np.isin(np.unique(shingle_hashes(part, k)), shingle_hashes(passage, k) if len(passage) >= k else passage[:0]).mean())


@dataclass
class Index:
    """Postings by term, items in the order of their length, and the largest weight of each block."""

    names: list
    parts: list[tuple[np.ndarray, np.ndarray]]
    terms: np.ndarray
    postings: list[tuple[list[int], list[float]]]
    block_max: np.ndarray
    top: np.ndarray
    block: int
    chunk: int

    @classmethod
    def build(cls, items: Iterable[tuple[object, str]], n_items: int, frequency: dict[int, int], mean_length: float, longest: int) -> Index:
        rows = sorted(((words_of(text), name, text) for name, text in items), key=lambda x: len(x[0]))
        vocabulary = np.unique(np.concatenate([w for w, _, _ in rows] or [np.zeros(0, np.uint64)]))
        postings: list[tuple[list[int], list[float]]] = [([], []) for _ in vocabulary]
        block = max(4, -(-len(rows) // BLOCKS))
        most = np.zeros((len(vocabulary), max(1, -(-len(rows) // block))), np.float32)
        for i, (words, _, _) in enumerate(rows):
            kinds, tf = np.unique(words, return_counts=True)
            df = np.array([frequency[int(k)] for k in kinds.view(np.int64)], float)
            weight = np.log1p((n_items - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean_length))
            weight /= weight.sum() if len(weight) else 1
            at = np.searchsorted(vocabulary, kinds)
            most[at, i // block] = np.maximum(most[at, i // block], weight)
            for t, x in zip(at.tolist(), weight.tolist(), strict=True):
                postings[t][0].append(i)
                postings[t][1].append(x)
        return cls([n for _, n, _ in rows], [question_and_answer(t) for _, _, t in rows], vocabulary, postings, most, most.max(1) if len(vocabulary) else np.zeros(0), block, max(CHUNK, longest))

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Items whose score is at least the threshold: block-max WAND over the terms' posting lists."""
        lists = [(self.postings[t], float(self.top[t]), self.block_max[t]) for t in terms]
        cursor = [0] * len(lists)
        live = [(p[0][0], k) for k, (p, _, _) in enumerate(lists)]
        end, out, n = len(self.names), [], len(self.names)
        threshold -= 1e-6

        def advance(k: int, target: int) -> int:
            items, at = lists[k][0][0], cursor[k]
            while at < len(items) and items[at] < target:
                at += 1
            cursor[k] = at
            return items[at] if at < len(items) else end

        while live:
            live.sort()
            bound, pivot = 0.0, -1
            for i, (_, k) in enumerate(live):
                bound += lists[k][1]
                if bound >= threshold:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = live[pivot][0]
            while pivot + 1 < len(live) and live[pivot + 1][0] == item:
                pivot += 1
            block = item // self.block
            if sum(float(lists[k][2][block]) for _, k in live[: pivot + 1]) < threshold:
                # nothing up to the block's end, or to the next list's item, can reach the threshold
                target = min((block + 1) * self.block, live[pivot + 1][0] if pivot + 1 < len(live) else n)
                moved = [(advance(k, max(target, item + 1)), k) for _, k in live[: pivot + 1]]
            elif live[0][0] == item:
                score = sum(lists[k][0][1][cursor[k]] for _, k in live[: pivot + 1])
                if score >= threshold:
                    out.append((item, score))
                moved = [(advance(k, item + 1), k) for _, k in live[: pivot + 1]]
            else:
                moved = [(advance(k, item) if at < item else at, k) for at, k in live[: pivot + 1]]
            live = [x for x in moved + live[pivot + 1 :] if x[0] < end]
        return out

    def scan(self, texts: list[str | None], threshold: float, least: float) -> list[dict[int, list[float]]]:
        """By text: verified items with [best score, passages, question overlap, answer overlap]."""
        found: list[dict[int, list[float]]] = [{} for _ in texts]
        if not len(self.terms):
            return found
        docs = [words_of(t) for t in texts]
        chunks = [-(-len(w) // self.chunk) for w in docs]
        first = np.concatenate(([0], np.cumsum(chunks))).astype(np.int64)
        if not first[-1]:
            return found
        words = np.concatenate(docs)
        chunk = np.concatenate([first[i] + np.arange(len(w)) // self.chunk for i, w in enumerate(docs)])
        at = np.searchsorted(self.terms, words)
        at[at == len(self.terms)] = 0
        known = np.flatnonzero(self.terms[at] == words)
        pairs = np.unique(chunk[known] * len(self.terms) + at[known])
        of, term = np.divmod(pairs, len(self.terms))
        bound = np.zeros((first[-1], self.block_max.shape[1]), np.float32)
        if len(pairs):
            begins = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            bound[of[begins]] = np.add.reduceat(self.block_max[term], begins)
        both = bound.copy()
        both[:-1] += bound[1:]
        last = first[1:][np.array(chunks) > 0] - 1  # a text's last chunk has no next one
        both[last] = bound[last]
        for window in np.flatnonzero((both >= threshold - 1e-4).any(1)).tolist():
            doc = int(np.searchsorted(first, window, side="right")) - 1
            start = window - int(first[doc])
            if start and start == chunks[doc] - 1:
                continue  # the passage before holds this chunk
            a, b = np.searchsorted(of, [window, window + (2 if start + 1 < chunks[doc] else 1)])
            for item, score in self.search(np.unique(term[a:b]).tolist(), threshold):
                passage = docs[doc][start * self.chunk : (start + 2) * self.chunk]
                question, answer = (overlap(p, passage) for p in self.parts[item])
                if min(question, answer) < least:
                    continue
                best = found[doc].setdefault(item, [0.0, 0, 0.0, 0.0])
                best[1] += 1
                if (score, question, answer) > (best[0], best[2], best[3]):
                    best[0], best[2], best[3] = score, question, answer
        return found


def build_indexes(benchmark: DataFrame) -> list[Index]:
    """Indexes over benchmark(item_id, text), SHARD_ITEMS items each, with statistics over all items."""
    rows = benchmark.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([words_of(t).view(np.int64) for t in batch.column("text").to_pylist()], pa.list_(pa.int64()))], ["words"])

        return each

    words = map_batches(rows, "words array<long>", make)
    n, mean, longest = words.filter(F.size("words") > 0).agg(F.count("*"), F.avg(F.size("words")), F.max(F.size("words"))).first()
    frequency = words.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    shards = -(-n // SHARD_ITEMS)
    out = []
    for shard in range(shards):
        mine = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == shard)
        items = [(r.item_id, r.text) for r in mine.collect() if len(words_of(r.text))]  # SHARD_ITEMS items
        terms = map_batches(mine, "words array<long>", make).select(F.explode("words").alias("term")).distinct()
        df = {r.term: r.df for r in frequency.join(terms, "term", "left_semi").collect()}  # the terms of these items
        out.append(Index.build(items, n, df, mean, longest))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least: float = OVERLAP) -> DataFrame:
    """SCHEMA's rows: every document and test item that a passage of the document leaks."""
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = SCHEMA.format(id=kind, item=item_kind)
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], schema)
    for index in build_indexes(benchmark):
        send = spark.sparkContext.broadcast(index)  # SHARD_ITEMS items at most
        item_type = pa.int64() if item_kind == "bigint" else pa.int32() if item_kind == "int" else pa.string()

        def make(send=send, item_type=item_type):
            index = send.value

            def each(batch: pa.RecordBatch) -> pa.RecordBatch:
                hits = index.scan(batch.column("text").to_pylist(), threshold, least)
                flat = [(doc, index.names[item], *values) for doc, found in enumerate(hits) for item, values in found.items()]
                columns = list(zip(*flat, strict=True)) or [()] * 6
                kinds = [item_type, pa.float64(), pa.int32(), pa.float64(), pa.float64()]
                return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(columns[0], pa.int32())), *(pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True))], ["doc_id", "item_id", "score", "passages", "question_overlap", "answer_overlap"])

            return each

        out = out.union(map_batches(rows, schema, make))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no test item, as they are; documents without a doc_id are judged by no id and stay."""
    leaked = materialise(find_leaks(docs, benchmark).select("doc_id").distinct(), "leaked")
    return docs.join(bounded(leaked), "doc_id", "left_anti").select(*docs.columns)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
