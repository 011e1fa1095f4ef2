"""TIFF blocks: written files read back, windows that touch only their blocks, codes of other writers, broken files."""

import random
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwright.sources import geotiff, ranges, tiff


def values_of(rows, cols, seed=1):
    r = random.Random(seed)
    return {(i, j): r.randint(0, 9) for i in range(rows) for j in range(cols) if r.random() < 0.9}


def table(spark, values):
    return spark.createDataFrame([(*k, v) for k, v in values.items()], "row int, col int, value int")


def got(df):
    return {(r.row, r.col): r.value for r in df.collect()}


def plain_tiff(path, pixels, compression=1, predictor=1, tile=None, order="<", big=False, squeeze=lambda b: b, nodata=None, apart=False):
    """A TIFF by hand: strips of five rows or square tiles, coded by `squeeze`; a third axis of pixels is planes."""
    rows, cols = pixels.shape[:2]
    n_planes = pixels.shape[2] if pixels.ndim == 3 else 1
    blocks = []
    for part in [pixels[..., k] for k in range(n_planes)] if apart else [pixels]:
        if tile:
            padded = np.zeros((-(-rows // tile) * tile, -(-cols // tile) * tile, *part.shape[2:]), pixels.dtype)
            padded[:rows, :cols] = part
            blocks += [padded[r : r + tile, c : c + tile] for r in range(0, rows, tile) for c in range(0, cols, tile)]
        else:
            blocks += [part[r : r + 5] for r in range(0, rows, 5)]

    def coded(b):
        b = b.astype(b.dtype.newbyteorder(order))
        if predictor == 2:
            b = np.concatenate([b[:, :1], b[:, 1:] - b[:, :-1]], 1).astype(b.dtype)
        if predictor == 3:
            step = b.shape[2] if b.ndim == 3 else 1
            by = np.stack([np.frombuffer(np.ascontiguousarray(b).astype(">f4").tobytes(), np.uint8).reshape(len(b), -1, 4)[..., k] for k in range(4)], 1).reshape(len(b), -1)
            return squeeze(np.concatenate([by[:, :step], by[:, step:] - by[:, :-step]], 1).astype(np.uint8).tobytes())
        return squeeze(b.tobytes())

    data = [coded(b) for b in blocks]
    start = 16 if big else 8
    offsets = [start + sum(map(len, data[:i])) for i in range(len(data))]
    kind = {"u": 1, "i": 2, "f": 3}[pixels.dtype.kind]
    tags = [(256, 4, (cols,)), (257, 4, (rows,)), (258, 3, (pixels.dtype.itemsize * 8,) * n_planes), (259, 3, (compression,)), (277, 3, (n_planes,)), (284, 3, (2 if apart else 1,)), (317, 3, (predictor,)), (339, 3, (kind,) * n_planes)]
    tags += [(322, 4, (tile,)), (323, 4, (tile,)), (324, 16 if big else 4, offsets), (325, 4, list(map(len, data)))] if tile else [(273, 16 if big else 4, offsets), (278, 4, (5,)), (279, 4, list(map(len, data)))]
    if nodata:
        tags.append((42113, 2, (nodata,)))
    at = start + sum(map(len, data))
    n, size = ("Q", 20) if big else ("H", 12)
    entries, more = b"", b""
    after = at + struct.calcsize(n) + size * len(tags) + (8 if big else 4)
    for tag, code, v in sorted(tags):
        body = v[0] if code == 2 else struct.pack(f"{order}{len(v)}{tiff.TYPES[code]}", *v)
        room = 8 if big else 4
        place = body.ljust(room, b"\0") if len(body) <= room else struct.pack(order + ("Q" if big else "I"), after + len(more))
        more += b"" if len(body) <= room else body
        entries += struct.pack(order + ("HHQ" if big else "HHI"), tag, code, len(body) if code == 2 else len(v)) + place
    head = {"<": b"II", ">": b"MM"}[order] + (struct.pack(order + "HHHQ", 43, 8, 0, at) if big else struct.pack(order + "HI", 42, at))
    path.write_bytes(head + b"".join(data) + struct.pack(order + n, len(tags)) + entries + b"\0" * (8 if big else 4) + more)


def lzw(data):
    """A plain coder: the longest known string, and a clear code when the table is full."""
    out, width = [(256, 9)], 9
    known, last = {bytes([i]): i for i in range(256)}, b""
    count = 258
    for c in data:
        c = bytes([c])
        if last + c in known:
            last += c
            continue
        out.append((known[last], width))
        known[last + c] = count
        count += 1
        width = 9 if count < 512 else 10 if count < 1024 else 11 if count < 2048 else 12
        if count == 4094:
            out.append((256, width))
            known, count, width = {bytes([i]): i for i in range(256)}, 258, 9
        last = c
    if last:
        out.append((known[last], width))
        count += 1
        width = 9 if count < 512 else 10 if count < 1024 else 11 if count < 2048 else 12
    out.append((257, width))
    bits = "".join(f"{code:0{w}b}" for code, w in out)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def pack_bits(data):
    out, i = b"", 0
    while i < len(data):
        run = 1
        while run < 128 and i + run < len(data) and data[i + run] == data[i]:
            run += 1
        out += bytes([257 - run, data[i]]) if run > 1 else bytes([0, data[i]])
        i += run
    return out


@pytest.mark.parametrize("apart", [False, True])
@pytest.mark.parametrize("tile", [None, 16])
@pytest.mark.parametrize(("kind", "predictor", "order"), [("u1", 2, "<"), ("i2", 2, ">"), ("u2", 1, ">"), ("f4", 3, "<"), ("f4", 1, "<")])
def test_planes(spark, tmp_path, apart, tile, kind, predictor, order):
    r = np.random.default_rng(3)
    pixels = r.integers(0, 100, (23, 37, 3)).astype(kind)
    path = tmp_path / "planes.tif"
    plain_tiff(path, pixels, 8, predictor, tile, order, squeeze=zlib.compress, apart=apart, nodata=b"7\0")
    assert tiff.describe(str(path))["planes"] == 3
    for plane in (1, 3):
        part = got(tiff.read_pixels(spark, str(path), (3, 5, 19, 30), plane=plane))
        assert part == {(i, j): pixels[i, j, plane - 1] for i in range(3, 22) for j in range(5, 35) if pixels[i, j, plane - 1] != 7}
    for plane in (0, 4):
        with pytest.raises(Exception, match=f"no plane {plane} of 3"):
            tiff.read_pixels(spark, str(path), plane=plane).count()


def test_planes_apart_read_their_blocks_only(tmp_path, monkeypatch):
    path = tmp_path / "planes.tif"
    plain_tiff(path, np.arange(20 * 20 * 3, dtype="u2").reshape(20, 20, 3), apart=True)
    file, layout = tiff.open_raster(str(path), plane=2)
    asked = []
    monkeypatch.setattr(ranges, "read_range", lambda f, at, n, real=ranges.read_range: asked.append(at) or real(f, at, n))
    _, _, block = layout.block(layout.blocks_in(7, 0, 1, 1)[0], file)
    assert asked == [layout.offsets[4 + 1]] and block[2, 0] == (7 * 20 + 0) * 3 + 1


def test_written_rasters_read_back(spark, tmp_path):
    values = values_of(100, 70)
    for i, j in list(values):
        if 32 <= i < 64 and 32 <= j < 64:
            del values[i, j]  # a block without pixels
    path = str(tmp_path / "a.tif")
    tiff.write_geotiff(table(spark, values), path, 100, 70, 1000.0, 9000.0, 5.0, 3308, nodata=65535, block=32, metadata={"release": 'a<b&"c"'})
    assert got(tiff.read_pixels(spark, path)) == values
    assert got(tiff.read_pixels(spark, path, (30, 10, 35, 25))) == {k: v for k, v in values.items() if 30 <= k[0] < 65 and 10 <= k[1] < 35}
    facts = tiff.describe(path)
    assert (facts["rows"], facts["cols"], facts["nodata"], facts["pixel_x"], facts["west"], facts["north"], facts["crs_epsg"]) == (100, 70, 65535, 5.0, 1000.0, 9000.0, 3308)
    r = geotiff.read_headers(spark, str(tmp_path)).collect()
    assert [(x.width, x.height, x.bits, x.samples, x.crs_epsg, x.south, x.east, x.nodata, x.error) for x in r] == [(70, 100, 16, 1, 3308, 8500.0, 1350.0, "65535", None)]
    assert list(tmp_path.iterdir()) == [tmp_path / "a.tif"]
    with pytest.raises(FileExistsError):
        tiff.write_geotiff(table(spark, values), path, 100, 70, 0.0, 0.0, 5.0, 3308)


def test_a_window_touches_only_its_blocks(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "a.tif")
    tiff.write_geotiff(table(spark, values_of(96, 96)), path, 96, 96, 0.0, 0.0, 5.0, 3308, nodata=255, kind="|u1", block=16)
    file, layout = tiff.open_raster(path)
    assert layout.blocks_in(17, 30, 10, 20) == [7, 8, 9] and layout.blocks_in(0, 0, 96, 96) == list(range(36)) and layout.blocks_in(96, 0, 5, 5) == []
    read = []
    monkeypatch.setattr(ranges, "read_range", lambda f, start, size, real=ranges.read_range: read.append((start, size)) or real(f, start, size))
    reader = tiff._Reader({"path": path, "window": "17,30,10,20"})
    read.clear()
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert read == [(layout.offsets[i], layout.sizes[i]) for i in (7, 8, 9)]
    assert {(r["row"], r["col"]) for r in rows} <= {(r, c) for r in range(17, 27) for c in range(30, 50)}
    # comparisons that Spark pushes down narrow the window
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    narrow = tiff._PushedReader({"path": path})
    assert len(list(narrow.pushFilters([GreaterThanOrEqual(("row",), 20), LessThan(("row",), 30), EqualTo(("col",), 40), EqualTo(("value",), 3.0)]))) == 4
    assert narrow.window == [20, 40, 30, 41] and sum(len(p.numbers) for p in narrow.partitions()) == 1


def test_pushed_filters_in_a_query(spark, tmp_path):
    values = values_of(64, 64)
    path = str(tmp_path / "a.tif")
    tiff.write_geotiff(table(spark, values), path, 64, 64, 0.0, 0.0, 5.0, 3308, nodata=65535, block=16)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = tiff.read_pixels(spark, path).filter("row >= 20 and row < 30 and col = 40")
        assert got(df) == {k: v for k, v in values.items() if 20 <= k[0] < 30 and k[1] == 40}
        assert df.rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@pytest.mark.parametrize(("compression", "squeeze"), [(1, bytes), (5, lzw), (8, zlib.compress), (32946, zlib.compress), (32773, pack_bits)])
@pytest.mark.parametrize(("tile", "order", "big"), [(None, "<", False), (16, ">", False), (16, "<", True)])
def test_codes_of_other_writers(tmp_path, compression, squeeze, tile, order, big):
    r = np.random.default_rng(compression)
    for dtype, predictor in (("u1", 1), ("u2", 2), ("i2", 1), ("i4", 2), ("f4", 1), ("f4", 3), ("f8", 1)):
        pixels = (r.integers(0, 40, (23, 37)) * (1 if dtype[0] == "u" else -1.5 if dtype[0] == "f" else -1)).astype(dtype)
        path = tmp_path / f"{compression}{tile}{order == '<'}{big}{dtype}{predictor}.tif"
        plain_tiff(path, pixels, compression, predictor, tile, order, big, squeeze)
        file, layout = tiff.open_raster(str(path))
        out = np.zeros_like(pixels)
        for n in range(len(layout.sizes)):
            row, col, block = layout.block(n, file)
            part = block[: 23 - row, : 37 - col]
            out[row : row + part.shape[0], col : col + part.shape[1]] = part
        assert (out == pixels).all(), (dtype, predictor)


def test_long_lzw_runs_through_all_widths():
    r = random.Random(4)
    for data in (bytes(r.randrange(256) for _ in range(30_000)), b"ab" * 30_000, b"", b"x"):
        assert tiff.unpack_lzw(lzw(data)) == data


def test_broken_rasters_fail(spark, tmp_path):
    path = tmp_path / "a.tif"
    plain_tiff(path, np.arange(400, dtype="u2").reshape(20, 20), 8, 1, 16, squeeze=zlib.compress)
    whole = path.read_bytes()
    for name, data in {"cut": whole[:60], "text": b"no raster at all", "empty": b"", "deflate": whole[:10] + b"\xff" * 8 + whole[18:]}.items():
        (tmp_path / name).write_bytes(data)
        with pytest.raises(ValueError):
            file, layout = tiff.open_raster(str(tmp_path / name))
            layout.block(0, file)
    with pytest.raises(ValueError):
        tiff.unpack_lzw(b"\x00\x00\x00")
    errors = {r.path.rsplit("/", 1)[1]: r.error for r in geotiff.read_headers(spark, str(tmp_path)).collect()}
    assert errors["text"] and errors["cut"]


def test_large_sparse_files_are_read_in_ranges(spark, tmp_path):
    """A raster whose last blocks lie beyond 3 GB, in an archive and alone: only ranges are read."""
    path = tmp_path / "big.tif"
    pixels = np.arange(32 * 32, dtype="u2").reshape(32, 32)
    plain_tiff(path, pixels, 8, 1, 16, squeeze=zlib.compress)
    data = bytearray(path.read_bytes())
    file, layout = tiff.open_raster(str(path))
    blocks = [bytes(data[o : o + s]) for o, s in zip(layout.offsets, layout.sizes, strict=True)]
    far = [3_000_000_000 + 100_000 * i for i in range(4)]
    spot = data.find(struct.pack("<4I", *layout.offsets))
    data[spot : spot + 16] = struct.pack("<4I", *far)
    with path.open("wb") as f:
        f.write(data)
        for at, block in zip(far, blocks, strict=True):
            f.seek(at)
            f.write(block)
    assert path.stat().st_size > 3_000_000_000
    window = got(tiff.read_pixels(spark, str(path), (14, 14, 4, 4)))
    assert window == {(r, c): float(pixels[r, c]) for r in range(14, 18) for c in range(14, 18)}


def test_stored_members_of_archives(spark, tmp_path):
    plain_tiff(tmp_path / "a.tif", np.arange(400, dtype="u2").reshape(20, 20), 8, 1, 16, squeeze=zlib.compress, nodata=b"7\0")
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.write(tmp_path / "a.tif", "in/other.tif", zipfile.ZIP_DEFLATED)
        z.write(tmp_path / "a.tif", "in/a.tif", zipfile.ZIP_STORED)
    want = {(i, j): float(20 * i + j) for i in range(20) for j in range(20) if 20 * i + j != 7}
    assert got(tiff.read_pixels(spark, str(tmp_path / "a.zip"), member="in/a.tif")) == want
    assert tiff.describe(str(tmp_path / "a.zip"), "in/a.tif")["rows"] == 20
    with pytest.raises(ValueError):
        tiff.open_raster(str(tmp_path / "a.zip"), "in/other.tif")


def test_downsampling_takes_the_pixel_under_the_centre(spark):
    rows = spark.range(61 * 47).select(F.expr("cast(id div 47 as int)").alias("row"), (F.col("id") % 47).cast("int").alias("col"), F.col("id").alias("value"))
    for window, n, m in (((0, 0, 61, 47), 4, 3), ((3, 5, 40, 31), 7, 31), ((10, 10, 1, 1), 1, 1), ((5, 0, 20, 47), 20, 2)):
        r0, c0, nr, nc = window
        want = {(i, j): (r0 + (2 * i + 1) * nr // (2 * n)) * 47 + c0 + (2 * j + 1) * nc // (2 * m) for i in range(n) for j in range(m)}
        assert got(tiff.downsample_nearest(rows, window, n, m)) == want
    with pytest.raises(ValueError):
        tiff.downsample_nearest(rows, (0, 0, 5, 5), 6, 5)


def test_windows_cover_envelopes():
    facts = {"rows": 100, "cols": 200, "pixel_x": 5.0, "pixel_y": 5.0, "west": 1000.0, "north": 2000.0}
    assert tiff.window_of(facts, 1012.0, 1900.0, 1099.0, 1988.0) == (2, 2, 18, 18)
    with pytest.raises(ValueError):
        tiff.window_of(facts, 990.0, 1900.0, 1099.0, 1988.0)
