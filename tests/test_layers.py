"""Writers, archives' single members, layers and reports on small tables."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from gridwright.operators import layers, report
from gridwright.sources import archives, writers


def test_route_sets_are_published_once_and_read_back(spark, tmp_path):
    rows = [("a", i, i, 2 * i) for i in range(5)] + [("b", 0, 7, 7)]
    routes = spark.createDataFrame(rows, "preset string, step int, row int, col int")
    path = f"file://{tmp_path}/set"
    manifest = writers.publish_routes(routes, path, scenario="s")
    assert [(r["preset"], r["cells"], r["destination"]) for r in manifest["routes"]] == [("a", 5, [4, 8]), ("b", 1, [7, 7])]
    assert sorted(map(tuple, writers.read_routes(spark, path).select("preset", "step", "row", "col").collect())) == rows
    with pytest.raises(FileExistsError):
        writers.publish_routes(routes, path)


def test_layers_need_their_header(spark, tmp_path):
    features = spark.createDataFrame([(i, [float(i)]) for i in range(7)], "id long, numbers array<double>")
    header = writers.write_layer(features, f"file://{tmp_path}/one", {"component": "roads"}, {"features": 7})
    got, rows = writers.read_layer(spark, f"file://{tmp_path}/one", "id long, numbers array<double>")
    assert got == header and got["feature_count"] == rows.count() == 7
    with pytest.raises(ValueError, match="more than 6"):
        writers.write_layer(features, f"file://{tmp_path}/two", {}, {"features": 6})
    with pytest.raises(Exception, match="layer.json|PATH_NOT_FOUND"):
        writers.read_layer(spark, f"file://{tmp_path}/two", "id long")


def test_pages_replace_only_themselves(spark, tmp_path):
    path = f"file://{tmp_path}/pages"
    make = lambda rows: spark.createDataFrame(rows, "tile int, page int, ids array<long>, cache_key string")
    writers.write_pages(make([(0, 0, [1, 2], "k"), (0, 1, [3], "k"), (1, 0, [4], "k")]), path)
    writers.write_pages(make([(0, 1, [3, 5], "k2")]), path)
    assert sorted((r.tile, r.page, r.ids, r.cache_key) for r in spark.read.parquet(path).collect()) == [(0, 0, [1, 2], "k"), (0, 1, [3, 5], "k2"), (1, 0, [4], "k")]


def test_rasters_round_trip_by_windows(spark, tmp_path):
    path = f"file://{tmp_path}/raster"
    cells = [(r, c, float((r * 7 + c) % 500)) for r in range(0, 600, 7) for c in range(0, 300, 5)]
    writers.write_raster(spark.createDataFrame(cells, "row int, col int, value double"), path, 65535, unit="class")
    whole = sorted(map(tuple, writers.read_raster(spark, path).collect()))
    assert whole == cells and writers.read_document(spark, path + "/raster.json")["rows"] == 596
    part = sorted(map(tuple, writers.read_raster(spark, path, (250, 90, 20, 30)).collect()))
    assert part == [x for x in cells if 250 <= x[0] < 270 and 90 <= x[1] < 120]


def test_single_members_and_unpacking(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, text in (("a.tif", "x" * 10), ("b.txt", "yy"), ("../c.txt", "z")):
            z.writestr(name, text)
    (tmp_path / "z.zip").write_bytes(data.getvalue())
    assert archives.one_member(["q/A.TIF", "b"], ".tif") == "q/A.TIF"
    for names in ([], ["a.tif", "b.tif"]):
        with pytest.raises(ValueError, match="exactly one"):
            archives.one_member(names, ".tif")
    path = f"file://{tmp_path}/z.zip"
    assert [(r.name, bytes(r.content)) for r in archives.unpack(spark, path, ["a.tif"], 10).collect()] == [("a.tif", b"x" * 10)]
    for members, most in ((["a.tif", "b.txt"], 11), (["../c.txt"], 10), (["none"], 10)):
        with pytest.raises(Exception, match="bytes|unpacked|no item"):
            archives.unpack(spark, path, members, most).collect()
    assert archives.persistent_path("/data/x/", ["/data"]) == "/data/x"
    for bad in ("/data/../etc", "/database/x"):
        with pytest.raises(ValueError, match="under none"):
            archives.persistent_path(bad, ["/data"])
    found = report.provenance(spark, f"file://{tmp_path}").first()
    assert found.artifact_bytes == len(data.getvalue()) == report.folder_bytes(spark, f"file://{tmp_path}").first().bytes


def test_shared_stretches_count_once(spark):
    """Two segments of one feature that overlap on a step, a point crossing, a feature beside the route."""
    steps = spark.createDataFrame([("p", 0, 0.0, 0.0, 10.0, 0.0), ("p", 1, 10.0, 0.0, 10.0, 10.0)], "preset string, step int, x1 double, y1 double, x2 double, y2 double")
    lines = [(1, 2.0, 0.0, 6.0, 0.0), (1, 4.0, 0.0, 9.0, 0.0), (2, 5.0, -5.0, 5.0, 5.0), (3, 0.0, 1.0, 8.0, 1.0), (4, 10.0, 5.0, 10.0, 50.0), (4, 8.0, 0.0, 20.0, 0.0)]
    got = {r.id: (r.length_m, r.dimension) for r in report.crossings(steps, spark.createDataFrame(lines, "id long, x1 double, y1 double, x2 double, y2 double"), 4.0).collect()}
    assert got == {1: (7.0, 1), 2: (0.0, 0), 4: (7.0, 1)}


def test_broken_routes_are_refused(spark):
    wide = spark.range(9).select((F.col("id") / 3).cast("int").alias("row"), (F.col("id") % 3).cast("int").alias("col"), F.lit(0.5).alias("terrain"), F.lit(1.0).alias("slope"), F.lit(False).alias("closed"))
    cells = wide.select(F.lit("length").alias("component"), "row", "col", F.lit(1.0).alias("value"))
    weights = spark.createDataFrame([("p", "length", 1.0)], "preset string, component string, weight double")
    make = lambda steps: report.assess_routes(spark.createDataFrame([("p", i, r, c) for i, (r, c) in enumerate(steps)], "preset string, step int, row int, col int"), wide, cells, weights, 3, 3)
    good = make([(0, 0), (1, 1), (1, 2)]).first()
    assert abs(good.length_m - 100 * (1 + 2**0.5)) < 1e-9 and good.delta_km is None and good.exposure == 3 and good.available
    for bad in ([(0, 0), (2, 2)], [(2, 2), (3, 3)]):
        with pytest.raises(Exception, match="no neighbour|leaves the grid"):
            make(bad).collect()


def test_tile_sizes_and_conflicts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(layers.tile_degrees(F.lit(None), F.lit(0.5))) == 0.5 and one(layers.tile_degrees(F.lit(None), F.lit(None))) is None
    with pytest.raises(Exception, match="above 0"):
        one(layers.tile_degrees(F.lit(-1.0), F.lit(0.5)))
    rows = [(0, 0, 1, ["a"], [1.0, 2.0]), (1, 0, 1, ["a"], [1.0, 2.0 + 5e-7]), (0, 0, 2, ["a"], [1.0]), (2, 0, 2, ["a"], [1.0, 1.0]), (0, 1, 3, ["a"], [1.0]), (1, 0, 3, ["b"], [1.0]), (0, 2, 4, None, []), (0, 0, 9, ["x"], [0.0])]
    captured = spark.createDataFrame(rows, "tile int, page int, id long, texts array<string>, numbers array<double>")
    features, bad = layers.complete_layer(spark.createDataFrame([(0, 1), (1, 1), (0, 2), (0, 3), (0, 4), (0, 5)], "tile int, id long"), captured)
    assert {r.id: (r.tile, r.times, r.conflict) for r in features.collect()} == {1: (0, 2, False), 2: (0, 2, True), 3: (0, 2, True), 4: (0, 1, False), 9: (0, 1, False)}
    assert {(r.id, r.problem) for r in bad.collect()} == {(2, "conflict"), (3, "conflict"), (5, "missing"), (9, "unexpected")}
