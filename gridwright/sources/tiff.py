"""Pixels of TIFF rasters as a Spark source, and rasters written as GeoTIFF.

The driver reads the directory of a file in ranges and deals its blocks (tiles or strips) that a window
touches to partitions; a task reads only the bytes of its blocks. Read with

    spark.dataSource.register(TiffPixels)
    spark.read.format("tiff_pixels").option("window", "row,col,rows,cols").load(path)

With the option ``pushed``, comparisons of row and col with constants narrow the window further; Spark wants
``spark.sql.python.filterPushdown.enabled`` for that (`read_pixels` looks it up). Of several planes, the option ``plane`` names one
(1 if nothing is said): of planes stored apart only its blocks are read, of interleaved ones the blocks of all. Classic and big
TIFF, integers or floats of one kind, Deflate, LZW, PackBits or none, with or without predictor. A block without bytes is all nodata, as are
missing values; such pixels give no rows. Broken blocks fail the read.
"""

from __future__ import annotations

import math
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from . import ranges

#: struct codes of the field types (fixed values of TIFF 6 and of big TIFF).
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
# tags (fixed values)
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_SIZES, PLANES = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES, FORMAT = 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS, METADATA, NODATA = 33550, 33922, 34735, 42112, 42113
#: GeoKeys of the system's code: geographic and projected (fixed values).
CRS_KEYS = (2048, 3072)
NO_COMPRESSION, LZW, DEFLATE, OLD_DEFLATE, PACK_BITS = 1, 5, 8, 32946, 32773
BLOCKS_PER_PARTITION = 16


def read_tags(file) -> tuple[str, dict[int, tuple]]:
    """Byte order and tags of the first directory, read in ranges; ValueError for what is no TIFF."""
    head = ranges.read_range(file, 0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack_from(order + "H", head, 2)[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF")
    big = version == 43
    try:
        at = struct.unpack(order + "Q", ranges.read_range(file, 8, 8))[0] if big else struct.unpack_from(order + "I", head, 4)[0]
        count = struct.unpack(order + ("Q" if big else "H"), ranges.read_range(file, at, 8 if big else 2))[0]
        if count > 65535:
            raise ValueError("directory is too long")
        size, first = (20, at + 8) if big else (12, at + 2)
        entries = ranges.read_range(file, first, count * size)
        tags = {}
        for i in range(count):
            tag, kind, n = struct.unpack_from(order + ("HHQ" if big else "HHI"), entries, i * size)
            if kind not in TYPES:
                continue
            code = f"{order}{n}s" if kind == 2 else order + TYPES[kind] * n if n <= 4 else f"{order}{n * len(TYPES[kind])}{TYPES[kind][0]}"
            width, place = struct.calcsize(code), i * size + (12 if big else 8)
            if width > file.size():
                raise ValueError(f"tag {tag} is longer than the file")
            data = entries[place : place + width] if width <= (8 if big else 4) else ranges.read_range(file, struct.unpack_from(order + ("Q" if big else "I"), entries, place)[0], width)
            tags[tag] = struct.unpack(code, data)
    except struct.error as e:
        raise ValueError(f"directory is cut: {e}") from e
    return order, tags


@dataclass
class Layout:
    """Where the blocks of a raster are, and how they are coded."""

    rows: int
    cols: int
    block_rows: int
    block_cols: int
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]
    compression: int
    predictor: int
    kind: str
    nodata: float | None
    #: Planes of the raster, the chosen one (from 0), and whether each has its own blocks.
    planes: int = 1
    plane: int = 0
    apart: bool = False
    #: Place of the file's own bytes: 0, or the start of a stored archive member.
    base: int = 0
    across: int = field(init=False)

    def __post_init__(self) -> None:
        self.across = -(-self.cols // self.block_cols)
        expected = self.across * -(-self.rows // self.block_rows) * (self.planes if self.apart else 1)
        if len(self.offsets) != expected or len(self.sizes) != expected:
            raise ValueError(f"{len(self.offsets)} blocks, expected {expected}")

    @classmethod
    def of(cls, file, plane: int = 1) -> Layout:
        order, t = read_tags(file)
        get = lambda tag, default=None: t[tag][0] if tag in t else default
        if missing := [x for x in (WIDTH, HEIGHT) if x not in t]:
            raise ValueError(f"tags are missing: {missing}")
        planes, bits, kind = get(SAMPLES, 1), get(BITS, 1), get(FORMAT, 1)
        if not 1 <= plane <= planes:
            raise ValueError(f"no plane {plane} of {planes}")
        if len({*t.get(BITS, (1,))}) > 1 or len({*t.get(FORMAT, (1,))}) > 1 or (kind, bits) not in {(k, b) for k in (1, 2) for b in (8, 16, 32, 64)} | {(3, 32), (3, 64)}:
            raise ValueError(f"planes of {t.get(BITS)} bits in format {t.get(FORMAT)} are not read")
        tiled = TILE_OFFSETS in t
        shape = (get(TILE_HEIGHT), get(TILE_WIDTH)) if tiled else (min(get(ROWS_PER_STRIP, get(HEIGHT)), get(HEIGHT)), get(WIDTH))
        if not all(shape) or not get(WIDTH) or not get(HEIGHT):
            raise ValueError("raster without pixels")
        text = t[NODATA][0].rstrip(b"\0 ").decode("ascii", "replace") if NODATA in t else ""
        try:
            nodata = float(text) if text else None
        except ValueError:
            nodata = None
        return cls(get(HEIGHT), get(WIDTH), *shape, t.get(TILE_OFFSETS if tiled else STRIP_OFFSETS, ()), t.get(TILE_SIZES if tiled else STRIP_SIZES, ()), get(COMPRESSION, 1), get(PREDICTOR, 1), order + {1: "u", 2: "i", 3: "f"}[kind] + str(bits // 8), nodata, planes, plane - 1, get(PLANES, 1) == 2 and planes > 1)

    def blocks_in(self, row: int, col: int, rows: int, cols: int) -> list[int]:
        """Numbers of the blocks that a window touches."""
        r0, c0, r1, c1 = max(row, 0), max(col, 0), min(row + rows, self.rows), min(col + cols, self.cols)
        if r0 >= r1 or c0 >= c1:
            return []
        return [r * self.across + c for r in range(r0 // self.block_rows, (r1 - 1) // self.block_rows + 1) for c in range(c0 // self.block_cols, (c1 - 1) // self.block_cols + 1)]

    def block(self, number: int, file) -> tuple[int, int, np.ndarray | None]:
        """First row and column of a block and its pixels; None for a block without bytes."""
        row, col = number // self.across * self.block_rows, number % self.across * self.block_cols
        if self.apart:  # the blocks of a plane follow those of the plane before
            number += self.plane * (len(self.sizes) // self.planes)
        if not self.sizes[number]:
            return row, col, None
        data = decompress(ranges.read_range(file, self.base + self.offsets[number], self.sizes[number]), self.compression)
        # the last strip may be shorter than the others, tiles are all whole
        rows = self.block_rows if self.block_cols != self.cols else min(self.block_rows, self.rows - row)
        mixed = 1 if self.apart else self.planes
        expected = rows * self.block_cols * mixed * np.dtype(self.kind).itemsize
        if len(data) < expected:
            raise ValueError(f"block {number} has {len(data)} bytes, expected {expected}")
        return row, col, unpredict(data[:expected], rows, self.block_cols, self.kind, self.predictor, mixed)[..., 0 if self.apart else self.plane]


def decompress(data: bytes, compression: int) -> bytes:
    if compression == NO_COMPRESSION:
        return data
    if compression in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompress(data)
        except zlib.error as e:
            raise ValueError(f"block is broken: {e}") from e
    if compression == LZW:
        return unpack_lzw(data)
    if compression == PACK_BITS:
        return unpack_bits(data)
    raise ValueError(f"compression {compression} is not read")


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; 256 clears the table and 257 ends."""
    out, table, last = bytearray(), [], b""
    bits = held = at = 0
    width = 9
    single = [bytes([i]) for i in range(256)] + [b"", b""]
    while True:
        while held < width:
            if at == len(data):
                return bytes(out)
            bits, held, at = (bits << 8 | data[at]) & 0xFFFFFF, held + 8, at + 1
        held -= width
        code = bits >> held & (1 << width) - 1
        if code == 257:
            return bytes(out)
        if code == 256:
            table, width, last = list(single), 9, b""
            continue
        if not table:
            raise ValueError("LZW does not start with a clear code")
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise ValueError("LZW code is not in the table")
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        # the table switches one code early
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12


def unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + n + 2]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def unpredict(data: bytes, rows: int, cols: int, kind: str, predictor: int, planes: int = 1) -> np.ndarray:
    """Values by row, column and plane; differences are taken within a plane."""
    if predictor == 2:
        plain = np.frombuffer(data, kind).reshape(rows, cols, planes)
        native = plain.astype(plain.dtype.newbyteorder("="))
        return np.cumsum(native.view(f"u{native.itemsize}"), axis=1, dtype=f"u{native.itemsize}").view(native.dtype)
    if predictor == 3:  # bytes of the floats by place, highest first, each the difference from the one a pixel's planes before
        width = np.dtype(kind).itemsize
        by_place = np.cumsum(np.frombuffer(data, np.uint8).reshape(rows, cols * width, planes), axis=1, dtype=np.uint8).reshape(rows, width, cols * planes)
        return np.ascontiguousarray(by_place.transpose(0, 2, 1)).view(f">f{width}").reshape(rows, cols, planes)
    if predictor != 1:
        raise ValueError(f"predictor {predictor} is not read")
    return np.frombuffer(data, kind).reshape(rows, cols, planes)


def open_raster(path: str, member: str | None = None, plane: int = 1):
    """(file, layout) of a TIFF, or of a member that a ZIP archive stores as it is."""
    file = ranges.open_file(path)
    if member is None:
        return file, Layout.of(file, plane)
    with zipfile.ZipFile(file) as z:
        info = z.getinfo(member)
        if info.compress_type != zipfile.ZIP_STORED:
            raise ValueError(f"{member} is compressed: unpack it first")
        head = ranges.read_range(file, info.header_offset, 30)
        start = info.header_offset + 30 + sum(struct.unpack_from("<HH", head, 26))
    file = ranges.open_file(path)
    layout = Layout.of(ranges.Within(file, start, info.file_size), plane)
    layout.base = start
    return file, layout


@dataclass
class Blocks(InputPartition):
    numbers: list[int]

    def __init__(self, numbers: list[int]):
        self.numbers = numbers


class TiffPixels(DataSource):
    """row, col, value of a raster's pixels; options: window (row,col,rows,cols), member (of a ZIP archive), plane (from 1)."""

    @classmethod
    def name(cls) -> str:
        return "tiff_pixels"

    def schema(self) -> str:
        return "row int, col int, value double"

    def reader(self, schema) -> DataSourceReader:
        return (_PushedReader if self.options.get("pushed") == "true" else _Reader)(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.member = options["path"], options.get("member")
        file, self.layout = open_raster(self.path, self.member, int(options.get("plane", 1)))
        file.close()
        window = options.get("window")
        row, col, rows, cols = map(int, window.split(",")) if window else (0, 0, self.layout.rows, self.layout.cols)
        if rows <= 0 or cols <= 0:
            raise ValueError("window without pixels")
        self.window = [row, col, row + rows, col + cols]

    def partitions(self) -> list[Blocks]:
        r0, c0, r1, c1 = self.window
        numbers = self.layout.blocks_in(r0, c0, r1 - r0, c1 - c0)
        return [Blocks(numbers[i : i + BLOCKS_PER_PARTITION]) for i in range(0, len(numbers), BLOCKS_PER_PARTITION)] or [Blocks([])]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        if not partition.numbers:
            return
        file = ranges.open_file(self.path)
        r0, c0, r1, c1 = self.window
        for number in partition.numbers:
            row, col, pixels = self.layout.block(number, file)
            if pixels is None:
                continue
            # pixels outside the window, and padding outside the raster, go
            top, left = max(r0, 0) - row, max(c0, 0) - col
            r, c = np.mgrid[max(0, top) : min(len(pixels), r1 - row, self.layout.rows - row), max(0, left) : min(pixels.shape[1], c1 - col, self.layout.cols - col)]
            values = pixels[r, c].astype(float)
            keep = ~np.isnan(values)
            if self.layout.nodata is not None:
                keep &= values != self.layout.nodata
            yield pa.RecordBatch.from_arrays([pa.array((r + row)[keep].astype(np.int32)), pa.array((c + col)[keep].astype(np.int32)), pa.array(values[keep])], ["row", "col", "value"])


class _PushedReader(_Reader):
    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        """Comparisons of row and col shrink the window; Spark still checks all of them."""
        for f in filters:
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and f.attribute in (("row",), ("col",)) and isinstance(f.value, int):
                k = 0 if f.attribute == ("row",) else 1
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.window[k] = max(self.window[k], f.value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.window[k + 2] = min(self.window[k + 2], f.value + (not isinstance(f, LessThan)))
            yield f


def read_pixels(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None, member: str | None = None, plane: int = 1) -> DataFrame:
    """row, col, value of a plane's pixels in a window (row, col, rows, cols), nodata left out."""
    spark.dataSource.register(TiffPixels)
    reader = spark.read.format("tiff_pixels").option("pushed", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).option("plane", plane)
    if window:
        reader = reader.option("window", ",".join(map(str, window)))
    if member:
        reader = reader.option("member", member)
    return reader.load(path)


def describe(path: str, member: str | None = None) -> dict:
    """rows, cols, kind, nodata, block size and, where the file has them, pixel sizes, corner and system code: a few ranges are read."""
    file, layout = open_raster(path, member)
    _, tags = read_tags(file if member is None else ranges.Within(file, layout.base, file.size() - layout.base))
    out = {"rows": layout.rows, "cols": layout.cols, "planes": layout.planes, "kind": layout.kind, "nodata": layout.nodata, "block_rows": layout.block_rows, "block_cols": layout.block_cols, "compression": layout.compression}
    if PIXEL_SCALE in tags and TIE_POINT in tags:
        (sx, sy), tie = tags[PIXEL_SCALE][:2], tags[TIE_POINT]
        out |= {"pixel_x": sx, "pixel_y": sy, "west": tie[3] - tie[0] * sx, "north": tie[4] + tie[1] * sy}
    keys = tags.get(GEO_KEYS, ())
    out["crs_epsg"] = next((keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k] in CRS_KEYS), None)
    return out


# --- windows and downsampling --------------------------------------------------------------------


def window_of(facts: dict, west: float, south: float, east: float, north: float) -> tuple[int, int, int, int]:
    """The window (row, col, rows, cols) of a described raster that covers an envelope; ValueError if the raster does not."""
    col, row = math.floor((west - facts["west"]) / facts["pixel_x"]), math.floor((facts["north"] - north) / facts["pixel_y"])
    end_col, end_row = math.ceil((east - facts["west"]) / facts["pixel_x"]), math.ceil((facts["north"] - south) / facts["pixel_y"])
    if row < 0 or col < 0 or end_row > facts["rows"] or end_col > facts["cols"]:
        raise ValueError("raster does not cover the envelope")
    return row, col, end_row - row, end_col - col


def downsample_nearest(pixels: DataFrame, window: tuple[int, int, int, int], rows: int, cols: int) -> DataFrame:
    """row, col, value of a grid of rows x cols laid over a window of pixels: the pixel under each cell's centre.

    A pixel finds the one cell whose centre it holds, so nothing is joined. Cells are no smaller than pixels."""
    row, col, window_rows, window_cols = window
    if rows > window_rows or cols > window_cols or rows < 1 or cols < 1:
        raise ValueError("cells must not be smaller than pixels")

    def cell(at: str, first: int, size: int, n: int):
        """Target index of a source index, and whether it is the one under the centre, in whole numbers."""
        k = F.col(at).cast("long") - first
        i = F.expr(f"((2 * {n} * (`{at}` - {first}) + {size - 1}) div {size}) div 2")
        return i, (k >= 0) & (k < size) & (i < n) & (F.expr(f"((2 * (((2 * {n}L * (`{at}` - {first}) + {size - 1}) div {size}) div 2) + 1) * {size}) div {2 * n}") == k)

    (r, r_held), (c, c_held) = cell("row", row, window_rows, rows), cell("col", col, window_cols, cols)
    return pixels.filter(r_held & c_held).select(r.cast("int").alias("row"), c.cast("int").alias("col"), "value")


# --- writing -------------------------------------------------------------------------------------


def _entry(tag: int, kind: int, values: tuple, at: int) -> tuple[bytes, bytes]:
    """A directory entry and what it keeps elsewhere, at a place."""
    data = values[0] if kind == 2 else struct.pack("<" + TYPES[kind] * len(values), *values)
    n = len(data) if kind == 2 else len(values)
    if len(data) <= 4:
        return struct.pack("<HHI", tag, kind, n) + data.ljust(4, b"\0"), b""
    return struct.pack("<HHII", tag, kind, n, at), data + b"\0" * (len(data) % 2)


def header(rows: int, cols: int, block: int, kind: str, nodata: float | None, offsets: list[int], sizes: list[int], west: float, north: float, pixel: float, crs_epsg: int, projected: bool, metadata: dict[str, str], first: int) -> bytes:
    """The directory of a tiled raster, to stand at byte `first`."""
    number = (lambda x: str(int(x)) if float(x).is_integer() else repr(float(x)))
    keys = (1, 1, 0, 3, 1024, 0, 1, 1 if projected else 2, 1025, 0, 1, 1, CRS_KEYS[projected], 0, 1, crs_epsg)
    escape = lambda s: str(s).replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")
    xml = "<GDALMetadata>" + "".join(f'<Item name="{escape(k)}">{escape(v)}</Item>' for k, v in metadata.items()) + "</GDALMetadata>\0"
    fields = [(WIDTH, 4, (cols,)), (HEIGHT, 4, (rows,)), (BITS, 3, (np.dtype(kind).itemsize * 8,)), (COMPRESSION, 3, (DEFLATE,)), (PHOTOMETRIC, 3, (1,)), (SAMPLES, 3, (1,)), (PLANES, 3, (1,)),
              (TILE_WIDTH, 4, (block,)), (TILE_HEIGHT, 4, (block,)), (TILE_OFFSETS, 4, tuple(offsets)), (TILE_SIZES, 4, tuple(sizes)), (FORMAT, 3, ({"u": 1, "i": 2, "f": 3}[kind[1]],)),
              (PIXEL_SCALE, 12, (pixel, pixel, 0.0)), (TIE_POINT, 12, (0.0, 0.0, 0.0, west, north, 0.0)), (GEO_KEYS, 3, keys)]
    if metadata:
        fields.append((METADATA, 2, (xml.encode(),)))
    if nodata is not None:
        fields.append((NODATA, 2, (number(nodata).encode() + b"\0",)))
    entries, more = b"", b""
    at = first + 2 + 12 * len(fields) + 4
    for tag, code, values in fields:
        entry, data = _entry(tag, code, values, at + len(more))
        entries, more = entries + entry, more + data
    return struct.pack("<H", len(fields)) + entries + b"\0" * 4 + more


def write_geotiff(cells: DataFrame, path: str, rows: int, cols: int, west: float, north: float, pixel: float, crs_epsg: int, nodata: float | None = None, kind: str = "<u2", block: int = 256, projected: bool = True, metadata: dict[str, str] | None = None) -> None:
    """cells(row, col, value) as a tiled, deflated GeoTIFF, which must not exist; missing cells are nodata, or 0 without one.

    Blocks are packed in parallel and kept beside the destination. The running sum of their sizes gives
    their offsets, and one task appends them to the file, a block at a time, and the directory after them:
    a file has one writer, but what it holds in memory is a block and the directory. The file then gets its name."""
    spark = cells.sparkSession
    store, at = ranges.file_system(path)
    if store.get_file_info(at).type.name != "NotFound":
        raise FileExistsError(path)
    if block % 16 or np.dtype(kind).byteorder == ">":
        raise ValueError("blocks are multiples of 16 pixels, little-endian")
    across = -(-cols // block)
    beside = f"{path}.{uuid.uuid4().hex}"
    known = cells.filter(F.col("value").isNotNull() & F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1))
    keyed = known.select(F.expr(f"cast((row div {block}) * {across} + col div {block} as int)").alias("number"), F.expr(f"cast((row % {block}) * {block} + col % {block} as int)").alias("place"), F.col("value").cast("double").alias("value"))

    def pack(table: pa.Table) -> pa.Table:
        pixels = np.full(block * block, 0 if nodata is None else nodata, kind)
        pixels[table.column("place").to_numpy()] = table.column("value").to_numpy()
        data = zlib.compress(pixels.tobytes(), 6)
        return pa.table({"number": pa.array([table.column("number")[0].as_py()], pa.int32()), "size": pa.array([len(data)], pa.int32()), "data": pa.array([data], pa.binary())})

    packed = keyed.groupBy("number").applyInArrow(lambda table: pack(table), "number int, size int, data binary")
    packed.repartitionByRange("number").sortWithinPartitions("number").write.parquet(beside + ".blocks")
    blocks = spark.read.parquet(beside + ".blocks")
    sizes = [0] * (across * -(-rows // block))
    for r in blocks.select("number", "size").toLocalIterator():  # two numbers a block, as the directory lists
        sizes[r.number] = r.size
    offsets, end = [], 8
    for size in sizes:
        offsets.append(end if size else 0)
        end += size + size % 2
    if end > 0xFFFFFFFF - 64 - 8 * len(sizes):
        raise ValueError("a classic TIFF has no more than 4 GB")
    last = header(rows, cols, block, kind, nodata, offsets, sizes, west, north, pixel, crs_epsg, projected, metadata or {}, end)

    def append(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, name = ranges.file_system(beside)
        with target.open_output_stream(name) as out:
            out.write(b"II" + struct.pack("<HI", 42, end))
            for batch in batches:
                for data in batch.column("data"):
                    out.write(data.as_buffer())
                    out.write(b"\0" * (len(data.as_buffer()) % 2))
            out.write(last)
        yield pa.RecordBatch.from_arrays([pa.array([end + len(last)], pa.int64())], ["bytes"])

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))
    # the only task, as the file is one: blocks pass through it in order, a batch at a time
    written = blocks.select("number", "data").repartition(1).sortWithinPartitions("number").select("data").mapInArrow(append, "bytes long").collect()
    folder, name = ranges.file_system(beside)
    if folder.get_file_info(name).size != written[0].bytes:
        raise OSError(f"{path} is not whole")
    folder.move(name, at)
    folder.delete_dir(name + ".blocks")
