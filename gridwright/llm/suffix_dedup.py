"""Removal of long repeated byte strings by a common-prefix-aware distributed merge sort.

Every window of ``length`` bytes holds an anchor: a place whose K-byte hash is the smallest of the
window. Equal windows have their anchors at equal offsets, so only anchors whose K bytes stand in
two places need suffixes. Anchors with equal surroundings are one class, which is repeated as it
is. The classes' suffixes, and what stands before them read backwards, are sorted in runs, exchanged
front-coded by key range (ranges of a bounded number of suffixes, so that a task's memory does not grow),
and merged with loser trees that carry the common prefix with the last winner and never compare those bytes
again. The common prefixes of neighbours, on both sides of the anchor, give every window that has a double.

Byte b of a text is removed if a window over b also starts elsewhere, in this text or another one;
overlapping windows count, and all is judged on the input. Defined results: null is an empty text;
texts shorter than the window lose nothing by themselves; equal rows are documents of their own.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded_batches, map_batches, materialise, mix64, prefix_codes, read_table, release, salted_join, slice_hashes

LENGTH = 200
K = 64
#: Suffixes in a key range on average, and bytes that a task holds before it sends a run to each range.
RANGE_SUFFIXES, RUN_BYTES = 16_384, 12_000_000
#: An anchor of more classes than this is dealt to several ranges: for each band of so many offsets, by the bytes
#: that all windows of the band share.
SPLIT_CLASSES, BAND = 20_000, 17
KEY = 8


def _sliding(x: np.ndarray, w: int, fold: np.ufunc, pad: int) -> np.ndarray:
    """fold over every w neighbours, by running folds within blocks of w."""
    n = len(x)
    size = -(-n // w) * w
    full = np.full(size, pad, x.dtype)
    full[:n] = x
    blocks = full.reshape(-1, w)
    ahead = fold.accumulate(blocks, axis=1).ravel()
    back = fold.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return fold(back[: n - w + 1], ahead[w - 1 : n])


def anchors(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors, hashes of their K bytes, hashes of all around them that a window can reach."""
    n, w = len(data), length - K + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    prefix = prefix_codes(data)
    at = np.arange(n - K + 1)
    h = slice_hashes(prefix, at, at + K)
    smallest = _sliding(h, w, np.minimum, 2**64 - 1)  # by window
    # a place is an anchor if the largest of its windows' minima is its own hash
    padded = np.concatenate((np.zeros(w - 1, np.uint64), smallest, np.zeros(w - 1, np.uint64)))
    place = np.flatnonzero(_sliding(padded, w, np.maximum, 0) == h)
    left, right = np.minimum(place, w - 1), np.minimum(n - place, length)
    around = slice_hashes(prefix, place - left, place + right)
    return place, h[place], mix64(around ^ (left * 1024 + right).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """h, c, row, pos, l, r of every anchor of docs(row, data)."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, found, reach = [], [], []
            for row, data in zip(batch.column("row").to_pylist(), batch.column("data").to_pylist(), strict=True):
                a = anchors(np.frombuffer(data, np.uint8), length)
                if len(a[0]):
                    rows.append(np.full(len(a[0]), row))
                    found.append(a)
                    reach.append((np.minimum(a[0], length - K), np.minimum(len(data) - a[0], length)))
            join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
            columns = [join([a[1].view(np.int64) for a in found], np.int64), join([a[2].view(np.int64) for a in found], np.int64), join(rows, np.int64), join([a[0] for a in found], np.int32), join([x[0] for x in reach], np.int16), join([x[1] for x in reach], np.int16)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "c", "row", "pos", "l", "r"])

        return each

    return map_batches(docs.select("row", "data"), "h long, c long, row long, pos int, l short, r short", make)


# --- front-coded runs and their merge ----------------------------------------------------------


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of two strings that agree in the first `known` bytes."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n if not differ else n - (differ.bit_length() + 7) // 8


def front_code(run: list[bytes]) -> bytes:
    """A sorted run as lengths shared with the string before, rest lengths, and rests."""
    shared = [0, *(common_prefix(a, b) for a, b in zip(run, run[1:], strict=False))] if run else []
    rests = [s[k:] for s, k in zip(run, shared, strict=True)]
    return struct.pack("<I", len(run)) + np.array(shared, "<u2").tobytes() + np.array(list(map(len, rests)), "<u2").tobytes() + b"".join(rests)


def front_decode(data: bytes) -> tuple[list[bytes], list[int]]:
    (n,) = struct.unpack_from("<I", data)
    shared, rest = np.frombuffer(data, "<u2", n, 4).tolist(), np.frombuffer(data, "<u2", n, 4 + 2 * n).tolist()
    at, last, out = 4 + 4 * n, b"", []
    for k, m in zip(shared, rest, strict=True):
        last = last[:k] + data[at : at + m]
        out.append(last)
        at += m
    return out, shared


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Order of all strings as (run, index) and the common prefix of each with the one before.

    A loser tree: every node keeps the loser of its match and that loser's common prefix with the
    winner. Of two strings the one that shares more with the last winner is smaller; only on a draw
    are bytes compared, from the shared length on."""
    size = 1
    while size < len(runs):
        size *= 2
    at = [0] * size
    head: list[bytes | None] = [runs[i][0][0] if i < len(runs) and runs[i][0] else None for i in range(size)]
    share = [0] * size  # of a run's head with the last winner, while it plays
    loser, kept = [0] * size, [0] * size

    def play(a: int, b: int) -> tuple[int, int, int]:
        """winner, loser, the loser's common prefix with the winner; share[winner] stays."""
        x, y = head[a], head[b]
        if y is None or x is None:
            return (a, b, 0) if y is None else (b, a, 0)
        if share[a] != share[b]:
            return (a, b, share[b]) if share[a] > share[b] else (b, a, share[a])
        k = common_prefix(x, y, share[a])
        first = a if (x[k:] <= y[k:] if x[k:] != y[k:] else a < b) else b
        return first, (b if first == a else a), k

    winners = list(range(size))
    level = [*range(size)]
    node = size
    while len(level) > 1:
        node //= 2
        above = []
        for i in range(0, len(level), 2):
            w, lost, k = play(level[i], level[i + 1])
            loser[node + i // 2], kept[node + i // 2] = lost, k
            above.append(w)
        level = above
    del winners
    w = level[0]
    order, prefixes = [], []
    while head[w] is not None:
        order.append((w, at[w]))
        prefixes.append(share[w])
        strings, shared = runs[w]
        at[w] += 1
        if at[w] < len(strings):
            head[w], share[w] = strings[at[w]], shared[at[w]]
        else:
            head[w] = None
        node = (size + w) // 2
        while node >= 1 and size > 1:
            other = loser[node]
            share[other] = kept[node]
            w, lost, k = play(w, other)
            loser[node], kept[node] = lost, k
            node //= 2
    return order, prefixes


def classes_at(prefixes: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """By string: the number of its class among those that agree in the first `length` bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(prefixes < length)
    return out


def doubled_offsets(right: tuple[np.ndarray, np.ndarray], left: tuple[np.ndarray, np.ndarray], l: np.ndarray, r: np.ndarray, length: int, first: np.ndarray | int = 0, last: np.ndarray | int = LENGTH) -> tuple[np.ndarray, np.ndarray]:  # noqa: E741
    """Smallest and largest offset (from first to last) of each anchor in a window that two classes share; -1 without one."""
    n = len(l)
    low, high = np.full(n, -1), np.full(n, -1)
    for o in range(length - K + 1):
        can = np.flatnonzero((l >= o) & (r >= length - o) & (first <= o) & (last >= o))
        if len(can) < 2:
            continue
        key = classes_at(*right, KEY + length - o)[can] * (n + 1) + classes_at(*left, KEY + o)[can]
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        hit = can[by[np.append(same, False) | np.append(False, same)]]
        high[hit] = o
        low[hit[low[hit] < 0]] = o
    return low, high


def bands(key: int, suffix: bytes, before: bytes, length: int) -> Iterator[tuple[int, int, int]]:
    """Key, first and last offset of the bands in which an anchor (`before` is read backwards) has whole windows."""
    for first in range(0, length - K + 1, BAND):
        last = min(first + BAND - 1, length - K)
        if len(before) >= first and len(suffix) >= length - last:
            shared = before[:first][::-1] + suffix[: length - last]
            yield int.from_bytes(hashlib.blake2b(shared, digest_size=8, key=key.to_bytes(8, "big"), salt=first.to_bytes(8, "big")).digest(), "big"), first, last


def sorted_runs(heads: DataFrame, length: int, ranges: int) -> DataFrame:
    """range, h, c, l, r, first, last, run, left_run, left_at: front-coded runs of suffixes, and of what is before them, for each batch and key range.

    heads: data and at, an array of the anchors (h, c, pos, split) to take from it. The key of an anchor is its hash. A
    split one has a key for each band of offsets, mixed with the bytes that its windows of the band have in common if they are
    equal, so that equal windows still meet; where keys coincide, bytes decide as ever."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes, int, int, int, int, int, int]] = []
        size = 0

        def flush():
            held.sort()
            key = np.array([x[7] for x in held], np.uint64)
            part = ((key >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(int)
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(held)]
            out = [[] for _ in range(10)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                group = held[a:b]
                lefts = [x[0][:KEY] + x[1] for x in group]
                left_at = sorted(range(b - a), key=lefts.__getitem__)
                values = (int(part[a]), [x[2] for x in group], [x[3] for x in group], [len(x[1]) for x in group], [x[4] for x in group], [x[5] for x in group], [x[6] for x in group], front_code([x[0] for x in group]), front_code([lefts[i] for i in left_at]), left_at)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 4, pa.binary(), pa.binary(), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["range", "h", "c", "l", "r", "first", "last", "run", "left_run", "left_at"])

        for batch in batches:
            for data, at in zip(batch.column("data").to_pylist(), batch.column("at").to_pylist(), strict=True):
                # anchors have small hashes, so ranges are those of the hashes mixed once more
                keys = mix64(np.array([x["h"] for x in at], np.int64).view(np.uint64)).tolist()
                for x, key in zip(at, keys, strict=True):
                    pos = x["pos"]
                    suffix, before = data[pos : pos + length], data[max(0, pos - (length - K)) : pos][::-1]
                    for band, first, last in bands(key, suffix, before, length) if x["split"] else [(key, 0, length - K)]:
                        held.append((band.to_bytes(KEY, "big") + suffix, before, x["h"], x["c"], len(suffix), first, last, band))
                        size += len(suffix) + len(before)
            if size > RUN_BYTES:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    bounded_batches(heads.sparkSession)
    return heads.select("data", "at").mapInArrow(run, "range int, h array<long>, c array<long>, l array<int>, r array<int>, first array<int>, last array<int>, run binary, left_run binary, left_at array<int>")


def merge_range(group: pa.Table, length: int) -> pa.Table:
    """h, c, low, high of the classes of one key range that share a window with another class."""
    flat = lambda name: np.concatenate([np.array(x, np.int64) for x in group.column(name).to_pylist()])
    h, c, l, r, low, high = (flat(x) for x in ("h", "c", "l", "r", "first", "last"))  # noqa: E741
    first = np.cumsum([0, *(len(x) for x in group.column("h"))])

    def side(column: str, at: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Common prefixes and order of all runs of the column; at: the suffix of each string of a run."""
        order, prefixes = merge_runs([front_decode(x) for x in group.column(column).to_pylist()])
        return np.array(prefixes, np.int64), np.array([at[a][b] for a, b in order], np.int64)

    right = side("run", [np.arange(a, b) for a, b in zip(first, first[1:], strict=False)])
    left = side("left_run", [a + np.array(x) for a, x in zip(first, group.column("left_at").to_pylist(), strict=False)])
    low, high = doubled_offsets(right, left, l, r, length, low, high)
    hit = np.flatnonzero(low >= 0)
    return pa.table({"h": h[hit], "c": c[hit], "low": low[hit].astype(np.int32), "high": high[hit].astype(np.int32)})


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """row, spans: per text of docs(row, doc_id, data) the stretches, one or more an anchor, that have a double elsewhere."""
    spark = docs.sparkSession
    found = anchor_rows(docs, length)
    shared = found.groupBy("h").agg(F.count("*").alias("n"), F.min("c").alias("a"), F.max("c").alias("b")).filter("n > 1").select("h", (F.col("a") != F.col("b")).alias("mixed"))
    shared = materialise(shared, "anchor-hashes")  # read back, so that a hash of very many places can be split in the join
    known = materialise(found.join(shared, "h"), "anchors")
    classes = known.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("row", "pos")).alias("head"), F.first("mixed").alias("mixed"), F.first("l").alias("l"), F.first("r").alias("r"))
    classes = materialise(classes, "anchor-classes")
    mixed = classes.filter("mixed").select("h", "c", F.col("head.row").alias("row"), F.col("head.pos").alias("pos"))
    many = materialise(mixed.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > SPLIT_CLASSES).select("h", F.lit(True).alias("split")), "split-anchors")
    # few anchors have many classes, as their number times SPLIT_CLASSES is bounded by the places; salted where they do not fit a broadcast
    n_split = many.count()
    heads = mixed.withColumn("split", F.lit(False)) if not n_split else (mixed.join(F.broadcast(many), "h", "left") if n_split <= BROADCAST_ROWS else salted_join(mixed, many, "h", "left")).withColumn("split", F.coalesce("split", F.lit(False)))
    listed = heads.groupBy("row").agg(F.collect_list(F.struct("h", "c", "pos", "split")).alias("at"))
    suffixes = heads.agg(F.coalesce(F.sum(F.when(F.col("split"), -(-(length - K + 1) // BAND)).otherwise(1)), F.lit(0))).first()[0]
    ranges = max(1, -(-suffixes // RANGE_SUFFIXES))
    runs = sorted_runs(docs.join(listed, "row"), length, ranges)
    found_in_ranges = runs.groupBy("range").applyInArrow(lambda group: merge_range(group, length), "h long, c long, low int, high int")
    matched = found_in_ranges if not n_split else found_in_ranges.groupBy("h", "c").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    # a class of several places is doubled wherever a window fits; one place needs another class
    several = classes.filter((F.col("n") > 1) & (F.col("l") + F.col("r") >= length)).select("h", "c", F.greatest(F.lit(0), length - F.col("r")).cast("int").alias("low"), F.col("l").cast("int").alias("high"))
    alone = classes.filter("n = 1 and mixed").select("h", "c", F.col("head.row").alias("row"), F.col("head.pos").alias("pos"))
    places = known.select("h", "c", "row", "pos").join(several, ["h", "c"]).unionByName(alone.join(matched, ["h", "c"]))
    spans = places.select("row", F.struct((F.col("pos") - F.col("high")).alias("a"), (F.col("pos") - F.col("low") + length).alias("b")).alias("span"))
    out = materialise(spans.groupBy("row").agg(F.collect_set("span").alias("spans")), "spans")
    release(shared, known, classes, many)
    return out


def union_of(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def as_bytes(docs: DataFrame) -> DataFrame:
    """row, doc_id, data: the key of a row follows from its doc_id and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.xxhash64("doc_id", text).alias("row"), "doc_id", F.encode(text, "utf-8").alias("data"))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, kept (the remaining bytes), spans (removed stretches) for docs(doc_id, text)."""
    docs = as_bytes(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    span_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, kept, removed = [], [], []
            for data, spans in zip(batch.column("data").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                cut = union_of(spans)
                edges = [0, *(x for s in cut for x in s), len(data)]
                sizes.append(len(data))
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                removed.append([{"a": a, "b": b} for a, b in cut])
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, span_type)], ["doc_id", "n_bytes", "kept", "spans"])

        return each

    return map_batches(docs.join(repeated_spans(docs, length), "row", "left"), f"doc_id {kind}, n_bytes long, kept binary, spans array<struct<a:int,b:int>>", make)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
