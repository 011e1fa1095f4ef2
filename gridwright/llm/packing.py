"""Best-fit packing of token sequences by linear grouping.

Lengths are whole numbers up to the capacity, so all of the plan follows from a histogram of at most
``capacity`` counts, whatever the number of documents: large lengths are rounded up within groups of
equal cardinality, configurations of those few sizes are filled to the brim one after another, the
actual documents take their group's slots, and the small ones go best-fit into what is left. The
plan, as runs of equal bins, then gives every piece its place by its rank within its length.

Defined results: null and empty texts are one id (the end id); longer documents are cut into pieces
of the capacity, the first piece taking the remainder; equal rows are separate documents; an empty
table gives no rows; other columns, of any name, are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import encoder, map_batches, materialise, read_table, tokenizer_path

CAPACITY = 2048
GROUPS = 192
#: Lengths up to this part of the capacity are small ones.
SMALL_PART = 8
PIECES = "doc_id {id}, row_key long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, row_key, piece, start, length, ids_crc32 of every piece of every document."""

    def make():
        encode = encoder(tokenizer)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            names, out = batch.column("doc_id").to_pylist(), [[] for _ in range(6)]
            texts = batch.column("text").to_pylist()
            for name, text, ids in zip(names, texts, encode.encode(texts), strict=True):
                full = np.append(ids, encode.dtype.type(0)).astype("<u4")
                rest = len(full) % capacity or capacity
                key = zlib.crc32(full.tobytes())
                start = 0
                for piece, end in enumerate(range(rest, len(full) + 1, capacity)):
                    for column, value in zip(out, (name, key, piece, start, end - start, zlib.crc32(full[start:end].tobytes())), strict=True):
                        column.append(value)
                    start = end
            kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "row_key", "piece", "start", "length", "ids_crc32"])

        return each

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", F.col("text").cast("string").alias("text")), PIECES.format(id=kind), make)


class Runs:
    """Bins as runs (how many, [slot sizes]); open ones are found by what they have left."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
        self.left: list[int] = []

    def add(self, n: int, slots: tuple[int, ...]) -> None:
        left = self.capacity - sum(slots)
        if left not in self.open:
            self.open[left] = []
            insort(self.left, left)
        self.open[left].append((n, slots))

    def tightest(self, size: int) -> tuple[int, tuple[int, ...]] | None:
        at = bisect_left(self.left, size)
        if at == len(self.left):
            return None
        left = self.left[at]
        n, slots = self.open[left].pop()
        if not self.open[left]:
            del self.open[left]
            self.left.pop(at)
        return n, slots

    def put(self, size: int, count: int) -> None:
        """Best fit for `count` pieces of one size, whole runs at a time."""
        while count:
            n, slots = self.tightest(size) or (count, ())
            each = min((self.capacity - sum(slots)) // size, count)
            used = min(n, count // each)
            if used < n and slots:
                self.add(n - used, slots)
            self.add(used, (*slots, *[size] * each))
            count -= used * each


def fill_pattern(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size make the fullest bin that holds the largest size still left."""
    reach = np.full(capacity + 1, -1, np.int32)  # the last kind used to reach a fill
    first = int(np.flatnonzero(counts)[0])
    reach[sizes[first]] = first
    used_first = {int(sizes[first])}
    for k in range(first, len(sizes)):
        size, most = int(sizes[k]), int(counts[k]) - (k == first)
        for _ in range(min(most, capacity // size)):
            src = np.flatnonzero(reach[: capacity + 1 - size] >= 0)
            dst = src + size
            new = dst[reach[dst] < 0]
            if not len(new):
                break
            reach[new] = k
            if reach[capacity] >= 0:
                break
        if reach[capacity] >= 0:
            break
    out = np.zeros(len(sizes), np.int64)
    at = int(np.flatnonzero(reach >= 0)[-1])
    while at not in used_first:
        out[reach[at]] += 1
        at -= int(sizes[reach[at]])
    out[first] += 1
    return out if (out <= counts).all() else np.eye(len(sizes), dtype=np.int64)[first]


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, tuple[int, ...]]]:
    """Runs of equal bins (how many, slot sizes) that hold exactly the lengths of the histogram."""
    runs = Runs(capacity)
    small = capacity // SMALL_PART
    large = np.array(sorted((s for s in histogram if s > small), reverse=True), np.int64)
    n = np.array([histogram[s] for s in large], np.int64)
    if len(large):
        # equal-cardinality groups over the descending lengths; each group's lengths round up to its largest
        per = max(1, -(-int(n.sum()) // groups))
        ends = np.cumsum(n)
        cuts = np.minimum(np.arange(1, groups + 1) * per, ends[-1])
        cuts = np.unique(cuts)
        begins = np.concatenate(([0], cuts[:-1]))
        rounded = large[np.searchsorted(ends, begins, side="right")]
        counts = cuts - begins
        taken = begins.copy()
        while counts.any():
            pattern = fill_pattern(rounded, counts, capacity)
            kinds = np.flatnonzero(pattern)
            times = int((counts[kinds] // pattern[kinds]).min())
            # substitute actual documents: slots take consecutive ranks of their group
            lanes = [int(taken[k]) + j * times for k in kinds for j in range(pattern[k])]
            steps = {0, times}
            for lane in lanes:
                inside = ends[np.searchsorted(ends, lane, side="right") :]
                steps.update((inside[inside < lane + times] - lane).tolist())
            marks = sorted(steps)
            for a, b in zip(marks, marks[1:], strict=False):
                runs.add(b - a, tuple(int(large[np.searchsorted(ends, lane + a, side="right")]) for lane in lanes))
            counts[kinds] -= times * pattern[kinds]
            taken[kinds] += times * pattern[kinds]
    for size in sorted((s for s in histogram if s <= small), reverse=True):
        runs.put(size, histogram[size])
    return [run for left in sorted(runs.open) for run in runs.open[left]]


def plan_slots(runs: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """(length, first rank, first sequence, offset) for each slot of each run, by length and rank."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for n, slots in runs:
        offset = 0
        for size in slots:
            first = rank.get(size, 0)
            rows.append((size, first, sequence, offset))
            rank[size] = first + n
            offset += size
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def ranked(pieces: DataFrame, buckets: int) -> DataFrame:
    """Rank of each piece within its length, without a task that holds a whole length.

    Rows are ranked within (length, bucket); the ranks before a bucket come from the counts."""
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "row_key")
    return keyed.join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.row_number().over(order) - 1).drop("bucket", "before")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    pieces = materialise(token_pieces(docs, tokenizer, capacity), "pieces")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    slots = plan_slots(plan_bins(histogram, capacity, groups))
    lengths, firsts = slots[:, 0], slots[:, 1]
    # one sorted key for (length, rank); ranks stay below 2^44, lengths below 2^19
    keys = (lengths << 44) + firsts
    buckets = max(16, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = ranked(pieces, buckets)
    send = spark.sparkContext.broadcast((keys, slots))  # 40 bytes a slot; the slots of a plan are bounded by the capacity

    def make():
        keys, slots = send.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            placed = [pa.array(slots[at, 2] + rank - slots[at, 1]), pa.array(slots[at, 3])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *placed], [*names, "sequence_id", "offset"])

        return each

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(out, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long", make)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), tokenizer_path())
