"""Token-ID output: concatenated ids with Elias-Fano encoded document boundaries.

A store is a folder of shards, each one binary record: header, 16- or 32-bit little-endian ids of
its documents one after another, then the boundaries as an Elias-Fano sequence (low bits packed,
high bits unary, and the place of every 64th set bit for ``select``). Shards are written in
ascending doc_id order by Spark's own committer, so a lost executor only repeats its shards.

Defined results: null and empty texts give one id, the end id; documents with equal doc_id stand in
the order of their texts; a null doc_id comes first; an empty table gives a store without shards; other
columns, of any name, are not read; a very long text is a shard of its own. The query reads each document's
place by ``select``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, encoder, map_batches, new_path, read_table, tokenizer_path

MAGIC = b"GWEF"
SAMPLE = 64
END_ID = 0
#: Ids in a shard, beyond which the next one starts; a longer document has a shard to itself.
SHARD_IDS = 1 << 20


class EliasFano:
    """A non-decreasing sequence of n numbers below a bound in about 2 + log2(bound / n) bits each."""

    def __init__(self, n: int, low_width: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_width, self.low, self.high, self.samples = n, low_width, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        ones = (values >> width) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        low = (values[:, None] >> np.arange(width)) & 1
        pack = lambda b: np.packbits(b.astype(np.uint8).ravel(), bitorder="little").tobytes()
        return cls(n, width, pack(low), pack(bits), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return struct.pack("<QBII", self.n, self.low_width, len(self.low), len(self.high)) + self.low + self.high + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview) -> EliasFano:
        n, width, a, b = struct.unpack_from("<QBII", data)
        at = struct.calcsize("<QBII")
        return cls(n, width, bytes(data[at : at + a]), bytes(data[at + a : at + a + b]), np.frombuffer(data, "<u4", -(-n // SAMPLE), at + a + b))

    def _low(self, i: int) -> int:
        first = i * self.low_width
        chunk = int.from_bytes(self.low[first // 8 : (first + self.low_width + 7) // 8], "little")
        return chunk >> first % 8 & (1 << self.low_width) - 1

    def select(self, i: int) -> int:
        """The i-th value: from the sampled place, skip whole bytes by their bit counts."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, bits = at // 8, self.high[at // 8] >> at % 8 << at % 8
        while bits.bit_count() <= left:
            left -= bits.bit_count()
            byte += 1
            bits = self.high[byte]
        for _ in range(left):
            bits &= bits - 1
        place = byte * 8 + (bits & -bits).bit_length() - 1
        return place - i << self.low_width | self._low(i)

    def decode(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)) << self.low_width
        if self.low_width and self.n:
            bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_width].reshape(self.n, self.low_width)
            out |= bits.astype(np.int64) @ (1 << np.arange(self.low_width, dtype=np.int64))
        return out


def pack_shard(ids: list[np.ndarray]) -> bytes:
    """One binary record of the documents' ids; their ends are the Elias-Fano sequence."""
    body = np.concatenate(ids)
    ends = EliasFano.encode(np.cumsum([len(x) for x in ids])).to_bytes()
    return MAGIC + struct.pack("<BQ", body.dtype.itemsize, len(body)) + body.tobytes() + ends


class Shard:
    def __init__(self, record: bytes):
        data = memoryview(record)
        if bytes(data[:4]) != MAGIC:
            raise ValueError("not a shard")
        width, n = struct.unpack_from("<BQ", data, 4)
        self.ids = np.frombuffer(data, f"<u{width}", n, 13)
        self.ends = EliasFano.from_bytes(data[13 + width * n :])

    def __len__(self) -> int:
        return self.ends.n

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


def write_store(docs: DataFrame, path: str, tokenizer: str, partitions: int | None = None) -> None:
    """Encode every text and write the store. Texts move once, to the range of their doc_id."""
    spark = docs.sparkSession
    bounded_batches(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode = TaskContext.get().partitionId(), encoder(tokenizer)
        held, names, count, before, k = [], [], 0, 0, 0

        def record() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([before], pa.int64()), pa.array([count], pa.int64()), pa.array([names], pa.list_(batch.schema.field("doc_id").type)), pa.array([pack_shard(held)], pa.binary())], ["part", "shard", "ids_before", "n_ids", "doc_ids", "record"])

        for batch in batches:
            for name, ids in zip(batch.column("doc_id").to_pylist(), encode.encode(batch.column("text").to_pylist()), strict=True):
                if held and count + len(ids) + 1 > SHARD_IDS:
                    yield record()
                    held, names, before, count, k = [], [], before + count, 0, k + 1
                held.append(np.append(ids, encode.dtype.type(END_ID)))
                names.append(name)
                count += len(ids) + 1
        if held:
            yield record()

    (docs.select("doc_id", F.col("text").cast("string").alias("text"))
        .repartitionByRange(n, F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
        .mapInArrow(write, f"part int, shard int, ids_before long, n_ids long, doc_ids array<{kind}>, record binary")
        .write.parquet(path))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone.

    The ids before each partition are a running sum over one number for each partition."""
    shards = spark.read.parquet(path)
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    sums = sorted((r.part, r.n) for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    base, total = {}, 0
    for part, n in sums:
        base[part], total = total, total + n

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[], [], [], []]
            for part, before, names, record in zip(*(batch.column(c).to_pylist() for c in ("part", "ids_before", "doc_ids", "record")), strict=True):
                shard = Shard(record)
                ends = np.array([shard.ends.select(i) for i in range(len(shard))])
                starts = np.concatenate(([0], ends[:-1]))
                out[0] += names
                out[1] += (base[part] + before + starts).tolist()
                out[2] += (ends - starts).tolist()
                out[3] += [zlib.crc32(shard.ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts, ends, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field("doc_ids").type.value_type), *(pa.array(c, pa.int64()) for c in out[1:])], ["doc_id", "start", "n_tokens", "ids_crc32"])

        return each

    return map_batches(shards.select("part", "ids_before", "doc_ids", "record"), f"doc_id {kind}, start long, n_tokens long, ids_crc32 long", make)


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-store")
    write_store(read_table(spark, sf_dir, "documents"), path, tokenizer_path())
    return read_store(spark, path)
