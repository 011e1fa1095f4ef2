"""Media columns: ISO base media containers in a binary column.

``encode_media`` stores payloads as 8-bit PCM access units of 64 bytes; ``probe_media`` walks the
nested boxes of a container and decodes its first track's sample tables into codec, duration and keyframe
byte ranges without touching ``mdat``; ``read_payload`` follows the tables to the stored bytes. Sizes come
from ``stsz`` or ``stz2``; runs of fragments (``moof``) follow the samples of the tables, and with them the duration
is the sum of the samples' own. Edit lists are not read.

Defined results: a null text is an empty one; an empty payload is one unit of zeros; bytes that are
no container, and tables that contradict one another or claim more than the file holds, give nulls and
``error``, if they are the first track's (other tracks do not void it); long texts get 64-bit chunk offsets only past 4 GiB; repeated rows are encoded each; other
columns, also of PROBE_SCHEMA's names, are passed by or replaced; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

UNIT = 64
UNITS_PER_CHUNK = 16
SYNC_EVERY = 16
#: Boxes nested deeper than this are no container.
DEPTH = 32
RATE = 8000

#: Box types that hold other boxes (fixed values of ISO/IEC 14496-12).
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}

PROBE_SCHEMA = "codec string, handler string, timescale long, duration long, n_samples long, payload_bytes long, n_keyframes long, keyframes array<struct<offset:long,size:long>>, error string"


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full_box(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad_payload(data: bytes) -> bytes:
    """Zeros up to a positive multiple of the unit."""
    return data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b"\0")


def build_container(payload: bytes) -> bytes:
    """A one-track container whose samples are the payload's 64-byte units."""
    n = len(payload) // UNIT
    chunks = -(-n // UNITS_PER_CHUNK)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")

    def moov(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.int64) * UNIT * UNITS_PER_CHUNK
        wide = first + len(payload) >= 1 << 32
        places = full_box(b"co64", struct.pack(">I", chunks), offsets.astype(">u8").tobytes()) if wide else full_box(b"stco", struct.pack(">I", chunks), offsets.astype(">u4").tobytes())
        last = n - (chunks - 1) * UNITS_PER_CHUNK
        runs = [(1, min(UNITS_PER_CHUNK, n), 1)] + ([(chunks, last, 1)] if chunks > 1 and last != UNITS_PER_CHUNK else [])
        sync = np.arange(1, n + 1, SYNC_EVERY)
        entry = box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, RATE << 16))
        stbl = box(
            b"stbl",
            full_box(b"stsd", struct.pack(">I", 1), entry),
            full_box(b"stts", struct.pack(">III", 1, n, UNIT)),
            full_box(b"stss", struct.pack(">I", len(sync)), sync.astype(">u4").tobytes()),
            full_box(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full_box(b"stsz", struct.pack(">II", UNIT, n)),
            places,
        )
        minf = box(b"minf", full_box(b"smhd", bytes(4)), box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", full_box(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n * UNIT, 0x55C4, 0)), full_box(b"hdlr", bytes(4), b"soun", bytes(12), b"bytes\0"), minf)
        tkhd = full_box(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, n * UNIT, 0, 0, 0x100, 0), matrix, bytes(8), flags=3)
        mvhd = full_box(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, RATE, n * UNIT, 0x10000, 0x100), matrix, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = 16 if len(payload) + 8 >= 1 << 32 else 8
    before = len(ftyp) + len(moov(0)) + head
    if before + len(payload) >= 1 << 32:  # the table is wider then
        before = len(ftyp) + len(moov(1 << 32)) + head
    mdat = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if head == 16 else struct.pack(">I4s", len(payload) + 8, b"mdat")
    return b"".join((ftyp, moov(before), mdat, payload))


def walk_boxes(data: memoryview, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()):
    """Yield (path, start, body start, end) of every box, outer ones first."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                raise ValueError("box header is cut")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} does not fit")
        if len(path) >= DEPTH:
            raise ValueError("boxes are nested too deeply")
        yield (*path, kind), start, start + head, start + size
        if kind in CONTAINERS:
            yield from walk_boxes(data, start + head, start + size, (*path, kind))
        start += size


def _table(data: memoryview, at: int, kind: str, columns: int = 1) -> np.ndarray:
    (n,) = struct.unpack_from(">I", data, at + 4)
    out = np.frombuffer(data, kind, n * columns, at + 8).astype(np.int64)
    return out.reshape(n, columns) if columns > 1 else out


def _read_box(t: dict, kind: bytes, data: memoryview, at: int, whole: int) -> None:
    """What one box says of its track; data ends with the box, so no table reaches past it."""
    if kind == b"tkhd":
        (t["id"],) = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))
    elif kind == b"mdhd":
        wide = data[at] == 1
        t["timescale"], t["duration"] = struct.unpack_from(">IQ" if wide else ">II", data, at + (20 if wide else 12))
    elif kind == b"hdlr":
        t["handler"] = bytes(data[at + 8 : at + 12]).decode("latin-1")
    elif kind == b"stsd":
        t["codec"] = bytes(data[at + 12 : at + 16]).decode("latin-1")
    elif kind == b"stts":
        t["stts"] = _table(data, at, ">u4", 2)
    elif kind == b"stss":
        t["sync"] = _table(data, at, ">u4") - 1
    elif kind == b"stsc":
        t["stsc"] = _table(data, at, ">u4", 3)
    elif kind == b"stco":
        t["chunks"] = _table(data, at, ">u4")
    elif kind == b"co64":
        t["chunks"] = _table(data, at, ">u8")
    elif kind == b"stsz":
        size, n = struct.unpack_from(">II", data, at + 4)
        if size * n > whole:
            raise ValueError("more samples than bytes")
        t["sizes"] = np.full(n, size, np.int64) if size else np.frombuffer(data, ">u4", n, at + 12).astype(np.int64)
    elif kind == b"stz2":
        width, n = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
        if width == 4:
            pairs = np.frombuffer(data, np.uint8, -(-n // 2), at + 12).astype(np.int64)
            t["sizes"] = np.column_stack((pairs >> 4, pairs & 15)).ravel()[:n]
        elif width in (8, 16):
            t["sizes"] = np.frombuffer(data, f">u{width // 8}", n, at + 12).astype(np.int64)
        else:
            raise ValueError("unknown field size")


def _place_samples(t: dict) -> None:
    """Offsets of the samples of a track's tables."""
    sizes, chunks, runs = t["sizes"], t["chunks"], t["stsc"]
    firsts = np.append(runs[:, 0] - 1, len(chunks))
    if len(chunks) and (not len(runs) or firsts[0] or (np.diff(firsts) < 0).any()):
        raise ValueError("chunk runs are out of order")
    of_chunk = np.repeat(runs[:, 1], np.diff(firsts)) if len(chunks) else np.zeros(0, np.int64)
    if sum(of_chunk.tolist()) != len(sizes):
        raise ValueError("chunk and size tables disagree")
    if len(sizes) and (chunks.min() < 0 or ("sync" in t and len(t["sync"]) and (t["sync"].min() < 0 or t["sync"].max() >= len(sizes)))):
        raise ValueError("an entry is out of range")
    chunk = np.repeat(np.arange(len(chunks)), of_chunk)
    before = np.cumsum(sizes) - sizes
    first_sample = np.cumsum(of_chunk) - of_chunk
    t["offsets"] = chunks[chunk] + before - before[first_sample[chunk]] if len(sizes) else sizes
    t.setdefault("sync", np.arange(len(sizes)))


#: Fields that the flags of a fragment's header and of its runs announce, in their order (fixed values of ISO/IEC 14496-12).
HEADER_FIELDS = {0x1: "base", 0x2: "description", 0x8: "duration", 0x10: "size", 0x20: "flags"}
SAMPLE_FIELDS = {0x100: "duration", 0x200: "size", 0x400: "flags", 0x800: "composition"}
BASE_IS_MOOF, RUN_OFFSET, FIRST_FLAGS, NOT_SYNC = 0x20000, 0x1, 0x4, 0x10000


def _fragment(data: memoryview, at: int) -> tuple[int, dict]:
    """Track and given fields of a fragment's header."""
    flags, track = struct.unpack_from(">II", data, at)
    given, at = {"at moof": bool(flags & BASE_IS_MOOF)}, at + 8
    for bit, name in HEADER_FIELDS.items():
        if flags & bit:
            (given[name],) = struct.unpack_from(">Q" if name == "base" else ">I", data, at)
            at += 8 if name == "base" else 4
    if given.get("base", 0) > len(data.obj):
        raise ValueError("a fragment starts beyond the file")
    return track, given


def _run(data: memoryview, at: int, known: dict, place: int, whole: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """Offsets, sizes and sync marks of a run's samples, their duration, and the place behind them."""
    flags, n = struct.unpack_from(">II", data, at)
    at += 8
    if flags & RUN_OFFSET:
        place, at = known["base"] + struct.unpack_from(">i", data, at)[0], at + 4
    first = None
    if flags & FIRST_FLAGS:
        first, at = struct.unpack_from(">I", data, at)[0], at + 4
    names = [name for bit, name in SAMPLE_FIELDS.items() if flags & bit]
    if not names and n > whole:
        raise ValueError("more samples than bytes")
    each = dict(zip(names, np.frombuffer(data, ">u4", n * len(names), at).reshape(n, len(names)).T.astype(np.int64), strict=True)) if names else {}
    sizes, durations, marks = (each[f] if f in each else np.full(n, known.get(f, 0), np.int64) for f in ("size", "duration", "flags"))
    if n and first is not None and "flags" not in each:
        marks[0] = first
    offsets = place + np.cumsum(sizes) - sizes
    return offsets, sizes, marks & NOT_SYNC == 0, int(durations.sum()), place + int(sizes.sum())


def sample_tables(container: bytes) -> list[dict]:
    """One dict for each track: codec, handler, timescale, duration, sample offsets and sizes, sync samples; a track whose
    tables are wrong has an ``error`` instead of them."""
    whole = memoryview(container)
    tracks: list[dict] = []
    usual: dict[int, dict] = {}
    runs: list[tuple[int, dict, memoryview, int]] = []
    moof = known = None
    for path, start, at, end in walk_boxes(whole):
        kind, data = path[-1], whole[:end]
        if kind == b"trak":
            tracks.append({})
        elif kind == b"moof":
            moof, known = start, None
        elif path == (b"moov", b"mvex", b"trex"):
            track, _, duration, size, flags = struct.unpack_from(">5I", data, at + 4)
            usual[track] = {"duration": duration, "size": size, "flags": flags}
        elif path == (b"moof", b"traf", b"tfhd"):
            track, given = _fragment(data, at)
            # without a base, a fragment starts at its moof, and a later one of the same moof behind the one before
            known = {"base": moof if given["at moof"] or known is None else None, **usual.get(track, {}), **given}
            runs.append((track, known, None, 0))
        elif path == (b"moof", b"traf", b"trun"):
            if known is None:
                raise ValueError("a run stands before its fragment's header")
            runs.append((track, known, data, at))
        elif len(path) >= 3 and path[1] == b"trak":
            try:
                _read_box(tracks[-1], kind, data, at, len(whole))
            except (ValueError, IndexError, struct.error) as e:
                tracks[-1].setdefault("error", e)
    for t in tracks:
        try:
            if "error" not in t:
                _place_samples(t)
        except (ValueError, KeyError) as e:
            t["error"] = e
    _add_runs(tracks, runs, len(whole))
    for t in tracks:
        if "error" not in t and len(t["sizes"]) and (t["offsets"].min() < 0 or (t["offsets"] + t["sizes"]).max() > len(whole)):
            t["error"] = ValueError("a sample lies beyond the file")
    return tracks


def _add_runs(tracks: list[dict], runs: list[tuple[int, dict, memoryview | None, int]], whole: int) -> None:
    """Append the samples of fragments to those of their tracks' tables; runs are in the order of the file."""
    found: dict[int, list] = {}
    place, n, taken = 0, 0, 0
    for track, known, data, at in runs:
        if data is None:  # a header
            if known["base"] is None:
                known["base"] = place
            place = known["base"]
            found.setdefault(track, [])
            continue
        made = _run(data, at, known, place, whole)
        place = made[-1]
        n, taken = n + len(made[0]), taken + int(made[1].sum())
        if n > whole or taken > whole:
            raise ValueError("more samples than bytes")
        found[track].append(made)
    for t in tracks:
        mine = found.get(t.get("id"))
        if "error" in t or mine is None:
            continue
        tables = len(t["sizes"])
        offsets, sizes, sync, durations, _ = zip(*mine, strict=True) if mine else ((), (), (), (), ())
        t["duration"] = int((t["stts"][:, 0] * t["stts"][:, 1]).sum() if "stts" in t else 0) + sum(durations)
        t["sync"] = np.concatenate([t["sync"], tables + np.flatnonzero(np.concatenate([np.zeros(0, bool), *sync]))])
        t["offsets"], t["sizes"] = np.concatenate([t["offsets"], *offsets]), np.concatenate([t["sizes"], *sizes])


def _first(container: bytes) -> dict:
    t = sample_tables(container)[0]
    if "error" in t:
        raise t["error"]
    return t


def read_payload(container: bytes) -> bytes:
    """The samples of the first track, joined in order."""
    t = _first(container)
    starts, ends = t["offsets"], t["offsets"] + t["sizes"]
    if not len(starts):
        return b""
    new = np.flatnonzero(np.append(True, starts[1:] != ends[:-1]))
    return b"".join(container[a:b] for a, b in zip(starts[new], ends[np.append(new[1:] - 1, len(ends) - 1)], strict=True))


def _probe(container: bytes | None) -> dict:
    try:
        t = _first(container or b"")
        ranges = [{"offset": int(a), "size": int(n)} for a, n in zip(t["offsets"][t["sync"]], t["sizes"][t["sync"]], strict=True)]
        return {"codec": t["codec"], "handler": t.get("handler"), "timescale": t["timescale"], "duration": t["duration"], "n_samples": len(t["sizes"]), "payload_bytes": int(t["sizes"].sum()), "n_keyframes": len(ranges), "keyframes": ranges, "error": None}
    except (ValueError, IndexError, KeyError, struct.error) as e:
        return dict.fromkeys(("codec", "handler", "timescale", "duration", "n_samples", "payload_bytes", "n_keyframes", "keyframes")) | {"error": f"{type(e).__name__}: {e}" or "no track"}


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every whole text as a container."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            media = [build_container(pad_payload(x)) for x in raw]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

        return each

    ids = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), f"doc_id {ids}, n_bytes long, media binary", make)


def probe_media(df: DataFrame, media: str = "media") -> DataFrame:
    """The other columns of df with PROBE_SCHEMA's instead of the media column."""
    keep = [c for c in df.columns if c != media and c not in {p.split()[0] for p in PROBE_SCHEMA.split(", ")}]
    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    made = pa.schema([("codec", pa.string()), ("handler", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()), ("payload_bytes", pa.int64()), ("n_keyframes", pa.int64()), ("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())]))), ("error", pa.string())])

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = pa.RecordBatch.from_pylist([_probe(x) for x in batch.column(media).to_pylist()], made)
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *found.columns], [*keep, *made.names])

        return each

    return map_batches(df.select(*keep, media), kinds + PROBE_SCHEMA, make)


def media_digests(media: DataFrame) -> DataFrame:
    """Per row of encode_media(): digests of the stored form, of the payload read back, and its feature."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for stored in batch.column("media").to_pylist():
                p, payload = _probe(stored), read_payload(stored)
                keys = p["keyframes"]
                ranges = zlib.crc32(np.array([(k["offset"], k["size"]) for k in keys], "<i8").tobytes())
                feature = f"codec={p['codec'].strip()};handler={p['handler']};seconds={p['duration'] / p['timescale']:.3f};samples={p['n_samples']};keyframes={len(keys)};first={keys[0]['offset']}+{keys[0]['size']};ranges={ranges:08x}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

        return each

    ids = media.schema["doc_id"].dataType.simpleString()
    return map_batches(media, f"doc_id {ids}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", make)


def op4_media(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").cast("string"))
    return media_digests(encode_media(docs))
