"""Members of archives: what they are and whether they may be unpacked; dBase tables inside them."""

from __future__ import annotations

import posixpath
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ranges

#: Bytes of a member that are inflated at once.
CHUNK = 1 << 20
MEMBERS = "path string, name string, size long, crc long, kind string, unsafe boolean, intact boolean"


def member_kind(name: Column) -> Column:
    n = F.lower(name)
    return F.when(n.rlike(r"\.(shp|gpkg|geojson)$"), "vector").when(n.rlike(r"\.tif\.vat\.dbf$"), "classes").when(n.rlike(r"\.tif$"), "raster").otherwise("other")


def member_unsafe(name: Column) -> Column:
    """Absolute names and names that climb out of their folder."""
    return F.contains(name, F.lit("..")) | name.startswith("/")


def _directories(spark: SparkSession, path: str, most: int) -> DataFrame:
    """path, name, size, crc, link of every member of every ZIP file under the path, from the archives' directories alone."""
    files = spark.read.format("binaryFile").load(path).select("path")

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name in frame["path"]:
                with ranges.open_file(name) as file, zipfile.ZipFile(file) as z:
                    infos = z.infolist()
                    if len(infos) > most:
                        raise ValueError(f"{name}: more than {most} members")
                    rows += [(name, i.filename, i.file_size, i.CRC, i.external_attr >> 28 == 0xA) for i in infos]
            yield pd.DataFrame(rows, columns=["path", "name", "size", "crc", "link"])

    return files.mapInPandas(each, "path string, name string, size long, crc long, link boolean")


def _intact(path: str, name: str) -> bool:
    """Does a member inflate to its checksum? Read piece by piece."""
    try:
        with ranges.open_file(path) as file, zipfile.ZipFile(file) as z, z.open(name) as member:
            while member.read(CHUNK):
                pass
    except (zipfile.BadZipFile, zlib.error, EOFError, ValueError):
        return False
    return True


def read_members(spark: SparkSession, path: str, most: int = 10_000) -> DataFrame:
    """MEMBERS of every ZIP file under the path, nothing extracted; more members than `most` fail the read.

    An archive is never loaded: its directory is read in ranges, and members are checked in parallel, each piece by piece."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(intact=[_intact(p, n) for p, n in zip(frame["path"], frame["name"], strict=True)])

    listed = _directories(spark, path, most).repartition(F.col("path"), F.col("name"))
    x = listed.mapInPandas(each, "path string, name string, size long, crc long, link boolean, intact boolean")
    return x.select("path", "name", "size", "crc", member_kind(F.col("name")).alias("kind"), (member_unsafe(F.col("name")) | F.col("link")).alias("unsafe"), "intact")


def one_member(names: list[str], suffix: str) -> str:
    """The only member with the suffix; none or several are an error."""
    found = [n for n in names if n.lower().endswith(suffix.lower())]
    if len(found) != 1:
        raise ValueError(f"expected exactly one member {suffix}, found {len(found)}")
    return found[0]


def persistent_path(path: str, roots: list[str]) -> str:
    """The path, if it lies under one of the roots and does not climb out of it."""
    plain = posixpath.normpath(path)
    if ".." in path.split("/") or not any(plain == r.rstrip("/") or plain.startswith(r.rstrip("/") + "/") for r in map(posixpath.normpath, roots)):
        raise ValueError(f"{path} is under none of {roots}")
    return plain


def unpack(spark: SparkSession, path: str, members: list[str], most_bytes: int) -> DataFrame:
    """path, name, content of the named members of every ZIP under the path, and of no others; a task inflates one member.

    A member that is unsafe, missing or a link, and more than most_bytes from one archive, fail the read."""
    files = spark.read.format("binaryFile").load(path).select("path")

    def allowed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name in frame["path"]:
                with ranges.open_file(name) as file, zipfile.ZipFile(file) as z:
                    infos = [z.getinfo(m) for m in members]
                if any(".." in i.filename or i.filename.startswith("/") or i.external_attr >> 28 == 0xA for i in infos):
                    raise ValueError(f"{name}: a member may not be unpacked")
                if sum(i.file_size for i in infos) > most_bytes:
                    raise ValueError(f"{name}: more than {most_bytes} bytes")
                yield pd.DataFrame({"path": [name] * len(infos), "name": [i.filename for i in infos]})

    def inflate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, member in zip(frame["path"], frame["name"], strict=True):
                with ranges.open_file(name) as file, zipfile.ZipFile(file) as z:
                    yield pd.DataFrame({"path": [name], "name": [member], "content": [z.read(member)]})

    wanted = files.mapInPandas(allowed, "path string, name string").repartition(F.col("path"), F.col("name"))
    return wanted.mapInPandas(inflate, "path string, name string, content binary")


def unpack_to(spark: SparkSession, path: str, members: list[str], most_bytes: int, folder: str) -> DataFrame:
    """path, name, bytes of the named members, written as files under a folder that all machines share, piece by piece.

    A file appears under its name when it is whole; members of any size pass in bounded memory."""
    checked = _directories(spark, path, 1_000_000).filter(F.col("name").isin(members))
    rows = checked.groupBy("path").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max(member_unsafe(F.col("name")) | F.col("link")).alias("bad"))
    for r in rows.filter((F.col("bytes") > most_bytes) | F.col("bad") | (F.col("n") != len(members))).limit(1).collect():
        raise ValueError(f"{r.path}: members are missing, may not be unpacked, or have more than {most_bytes} bytes")

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = ranges.file_system(folder)
        for frame in frames:
            for archive, name, size in zip(frame["path"], frame["name"], frame["size"], strict=True):
                to = posixpath.join(root, posixpath.basename(archive), name)
                store.create_dir(posixpath.dirname(to), recursive=True)
                beside = f"{to}.{uuid.uuid4().hex}"
                with ranges.open_file(archive) as file, zipfile.ZipFile(file) as z, z.open(name) as member, store.open_output_stream(beside) as out:
                    while piece := member.read(CHUNK):
                        out.write(piece)
                store.move(beside, to)
                yield pd.DataFrame({"path": [to], "name": [name], "bytes": [size]})

    return checked.select("path", "name", "size").repartition(F.col("path"), F.col("name")).mapInPandas(each, "path string, name string, bytes long")


def parse_dbf(data: bytes) -> tuple[list[str], list[dict]]:
    """Fields and rows of a dBase table: deleted rows are left out, N and F are numbers, blanks null."""
    count, header, width = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 0x0D:
        name = data[at : at + 11].split(b"\0")[0].decode("latin-1")
        fields.append((name, chr(data[at + 11]), data[at + 16], data[at + 17]))
        at += 32
    rows = []
    for i in range(count):
        at = header + i * width
        if data[at : at + 1] == b"*":
            continue
        row, at = {}, at + 1
        for name, kind, size, decimals in fields:
            text = data[at : at + size].decode("latin-1").strip("\0 ")
            at += size
            row[name] = None if not text else text if kind not in "NF" else float(text) if decimals or kind == "F" or "." in text else int(text)
        rows.append(row)
    return [f[0] for f in fields], rows


def read_classes(spark: SparkSession, path: str, member: str | None, names: dict[str, str]) -> DataFrame:
    """value and the named columns of the class table inside each ZIP under the path; of equal values the last row stays.

    names: output column by field of the table. Without a member, the archive's only `.tif.vat.dbf` is read, and
    an archive with none or several has no classes."""
    files = spark.read.format("binaryFile").load(path).select("path")

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive in frame["path"]:
                with ranges.open_file(archive) as file, zipfile.ZipFile(file) as z:
                    named = [member] if member else [n for n in z.namelist() if n.lower().endswith(".tif.vat.dbf")]
                    _, rows = parse_dbf(z.read(named[0])) if len(named) == 1 else ([], [])
                rows = [(i, r["Value"], *(None if r.get(f) is None else str(r[f]) for f in names)) for i, r in enumerate(rows) if isinstance(r.get("Value"), int)]
                yield pd.DataFrame(rows, columns=["seq", "value", *names.values()])

    x = files.mapInPandas(each, "seq long, value int, " + ", ".join(f"{c} string" for c in names.values()))
    return x.groupBy("value").agg(*(F.max_by(c, "seq").alias(c) for c in names.values()))
