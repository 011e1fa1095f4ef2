"""Datum steps against published points, warping and sampling against direct computation."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwright.functions.geo import Datum, Geographic, LambertConic, TransverseMercator, to_geocentric
from gridwright.operators import warp

TM, LCC = TransverseMercator(), LambertConic()


def test_published_control_point_both_ways(spark):
    """The permanent station of the published step, to a tenth of a millimetre (fixed values)."""
    old, new = (-4052051.7643, 4212836.2017, -2545106.0245), (-4052052.7379, 4212835.9897, -2545104.5898)
    d = Datum()
    row = lambda p: spark.createDataFrame([p], "x double, y double, z double")
    forth = row(old).select(*d.geocentric(F.col("x"), F.col("y"), F.col("z"))).first()
    back = row(new).select(*d.reversed().geocentric(F.col("x"), F.col("y"), F.col("z"))).first()
    assert np.allclose(forth, new, atol=1e-4) and np.allclose(back, old, atol=1e-4)


def test_steps_undo_each_other(spark):
    r = random.Random(1)
    rows = [(i, r.uniform(-180, 180), r.uniform(-89, 89), r.uniform(-100, 4000)) for i in range(200)]
    start = spark.createDataFrame(rows, "id int, lon double, lat double, h double")
    d = Datum()
    moved = d.shift(start, "lon", "lat", "h")
    back = {x.id: x for x in d.reversed().shift(moved, "lon", "lat", "h").collect()}
    far = moved.select("id", *(c.alias(n) for c, n in zip(to_geocentric(F.col("lon"), F.col("lat"), F.col("h")), "xyz", strict=True))).collect()
    near = {x.id: x for x in start.select("id", *(c.alias(n) for c, n in zip(to_geocentric(F.col("lon"), F.col("lat"), F.col("h")), "xyz", strict=True))).collect()}
    for i, lon, lat, h in rows:
        assert abs(back[i].lon - lon) < 1e-11 and abs(back[i].lat - lat) < 1e-11 and abs(back[i].h - h) < 1e-6
    shifts = [np.linalg.norm(np.array([x.x, x.y, x.z]) - [near[x.id].x, near[x.id].y, near[x.id].z]) for x in far]
    assert 0.1 < min(shifts) and max(shifts) < 2.5  # metres
    assert d.shift(start, "lon", "lat").columns == start.columns


def test_pole_and_equator(spark):
    rows = spark.createDataFrame([(0.0, 90.0), (10.0, -90.0), (0.0, 0.0), (180.0, 0.0)], "lon double, lat double")
    still = Datum((0.0, 0.0, 0.0), (0.0, 0.0, 0.0), 0.0).shift(rows, "lon", "lat").collect()
    assert [round(x.lat, 10) for x in still] == [90.0, -90.0, 0.0, 0.0]


def image(spark, rows, cols, seed=2):
    r = random.Random(seed)
    values = {(i, j): r.randint(0, 50) for i in range(rows) for j in range(cols) if r.random() < 0.95}
    return values, spark.createDataFrame([(*k, float(v)) for k, v in values.items()], "row int, col int, value double")


def places_of(spark, n, rows, cols, seed=3):
    r = random.Random(seed)
    rows = [(i, 0, r.uniform(-3, rows + 3), r.uniform(-3, cols + 3)) for i in range(n)]
    rows += [(n + i, 0, y, x) for i, (y, x) in enumerate([(0.0, 0.0), (4.0, 4.0), (3.999999, 8.0), (4.5, 4.5), (7.5, 8.5)])]
    return rows, spark.createDataFrame(rows, "row int, col int, py double, px double")


@pytest.mark.parametrize("tile", [1, 4, 64])
def test_taking_pixels_does_not_depend_on_tiles(spark, tile):
    values, pixels = image(spark, 20, 30)
    rows, places = places_of(spark, 300, 20, 30)
    near = {r.row: r.value for r in warp.take(pixels, places, "nearest", tile).collect()}
    assert near == {i: values[int(np.floor(y)), int(np.floor(x))] for i, _, y, x in rows if (int(np.floor(y)), int(np.floor(x))) in values}
    smooth = {r.row: r.value for r in warp.take(pixels, places, "bilinear", tile).collect()}
    want = {}
    for i, _, y, x in rows:
        r, c = int(np.floor(y - 0.5)), int(np.floor(x - 0.5))
        four = [((1 - abs(y - 0.5 - a)) * (1 - abs(x - 0.5 - b)), values[a, b]) for a in (r, r + 1) for b in (c, c + 1) if (a, b) in values]
        if sum(w for w, _ in four) > 0:
            want[i] = sum(w * v for w, v in four) / sum(w for w, _ in four)
    assert smooth.keys() == want.keys() and all(abs(smooth[k] - want[k]) < 1e-9 for k in want)


def test_warping_a_plane_keeps_it(spark):
    """Pixels that hold their own northing: a warp to another grid gives the northings of its cells."""
    source = warp.Frame(LCC, 9_691_500.0, 4_553_200.0, 120.0, 120.0, 65, 80)
    target = warp.Frame(TM, 330_000.0, 6_380_000.0, 100.0, 100.0, 20, 20)
    every = spark.range(65 * 80).select(F.expr("cast(id div 80 as int)").alias("row"), (F.col("id") % 80).cast("int").alias("col"))
    back = warp.cell_centres(every, source)
    pixels = back.select("row", "col", (F.col("x") + 2 * F.col("y")).alias("value"))
    cells = spark.range(400).select(F.expr("cast(id div 20 as int)").alias("row"), (F.col("id") % 20).cast("int").alias("col"))
    got = {(r.row, r.col): r.value for r in warp.warp(pixels, source, cells, target, "bilinear", tile=16).collect()}
    want = {(r.row, r.col): r.x + 2 * r.y for r in warp.to_system(warp.cell_centres(cells, target), TM, LCC).collect()}
    assert len(got) == 400 and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    # a datum step moves the cells by its metres
    moved = {(r.row, r.col): r.value for r in warp.warp(pixels, source, cells, target, "bilinear", Datum().reversed(), 16).collect()}
    assert all(0.1 < abs(moved[k] - got[k]) < 6 for k in want)


def test_sampling_reads_one_window(spark):
    raster = warp.Frame(Geographic(), 150.0, -30.0, 0.1, 0.1, 40, 50)
    values, pixels = image(spark, 40, 50)
    asked = []

    def read(window):
        asked.append(window)
        row, col, rows, cols = window
        return pixels.filter(F.col("row").between(row, row + rows - 1) & F.col("col").between(col, col + cols - 1))

    r = random.Random(5)
    points = [(str(i), r.uniform(151, 152.5), r.uniform(-32.9, -31)) for i in range(60)]
    table = spark.createDataFrame(points, "preset string, x double, y double")
    got = {x.preset: x.value for x in warp.sample(table, Geographic(), raster, read).collect()}
    cell = lambda x, y: (int(np.floor((-30 - y) / 0.1)), int(np.floor((x - 150) / 0.1)))
    assert got == {i: values.get(cell(x, y)) for i, x, y in points}
    rows, cols = zip(*(cell(x, y) for _, x, y in points), strict=True)
    assert asked == [(min(rows), min(cols), max(rows) - min(rows) + 1, max(cols) - min(cols) + 1)]
    with pytest.raises(ValueError):
        warp.sample(spark.createDataFrame([("a", 149.0, -31.0)], table.schema), Geographic(), raster, read)
    with pytest.raises(ValueError):
        warp.sample(spark.createDataFrame([("a", None, -31.0)], table.schema), Geographic(), raster, read)
    assert warp.sample(table.limit(0), Geographic(), raster, read).count() == 0
    counts, totals = warp.class_report(warp.sample(table, Geographic(), raster, read).withColumn("preset", F.lit("p")), spark.createDataFrame([(1, "one")], "value int, name string"))
    total = totals.first()
    assert total.cells == 60 and total.native + total.nodata + total.unclassified == 60 and sum(c.cells for c in counts.collect()) == 60
