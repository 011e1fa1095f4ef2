"""A small study area derived from written files, against plain computation of each step."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from gridwright.functions.geo import Datum, Geographic, LambertConic, TransverseMercator
from gridwright.operators import derive, warp
from gridwright.sources import tiff, writers

ENVELOPE = (150.901, -32.911, 150.918, -32.899)


def raster(spark, path, rows, cols, values, west, north, pixel, crs, nodata, kind, projected):
    table = spark.createDataFrame([(*k, float(v)) for k, v in values.items()], "row int, col int, value double")
    tiff.write_geotiff(table, path, rows, cols, west, north, pixel, crs, nodata, kind, 16, projected)


@pytest.fixture(scope="module")
def area(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("area"))
    r = random.Random(4)
    # two height tiles side by side that share a column, the second one wrong there
    left = {(i, j): 100 + i + 2 * j + r.random() for i in range(30) for j in range(21)}
    right = {(i, j): (900 if j == 0 else 100 + i + 2 * (j + 20) + r.random()) for i in range(30) for j in range(20) if (i, j) != (12, 10)}
    raster(spark, f"{folder}/a.tif", 30, 21, left, 150.89, -32.89, 0.001, 4326, -32767, "<f8", False)
    raster(spark, f"{folder}/b.tif", 30, 20, right, 150.91, -32.89, 0.001, 4326, -32767, "<f8", False)
    heights = {(i, j): left[i, j] if j < 21 else right.get((i, j - 20)) for i in range(30) for j in range(40)}
    frame = derive.study_frame(spark, ENVELOPE, 100.0)
    corner = spark.createDataFrame([(frame.west, frame.north)], "x double, y double")
    at = warp.to_system(corner, TransverseMercator(), LambertConic()).first()
    west, north = math.floor(at.x / 50) * 50 - 500.0, math.ceil(at.y / 50) * 50 + 500.0
    classes = {(i, j): r.randint(0, 4) for i in range(60) for j in range(70) if r.random() < 0.95}
    raster(spark, f"{folder}/classes.tif", 60, 70, classes, west, north, 50.0, 3308, 65535, "<u2", True)
    return folder, heights, classes, (west, north), frame


def layers(spark, frame):
    def lines(*rows):
        return spark.createDataFrame([(i, *(frame.west + a * 100 if k % 2 == 0 else frame.north - a * 100 for k, a in enumerate(row))) for i, row in enumerate(rows)], "id int, x1 double, y1 double, x2 double, y2 double")

    square = lines((2, 2, 5, 2), (5, 2, 5, 5), (5, 5, 2, 5), (2, 5, 2, 2)).withColumn("id", F.lit(1))
    return {"roads": lines((0.5, 0.5, 4.5, 4.5)), "railways": lines((1.5, 0.1, 1.5, 3.9)), "hydrography_line": lines((0.2, 6.5, 7.8, 6.5))}, {"protected_land": square, "hydrography_area": square.limit(0)}


def test_derivation_from_files(spark, area):
    folder, heights, classes, (west, north), frame = area
    lines, areas = layers(spark, frame)
    made = derive.derive(spark, ENVELOPE, [f"{folder}/b.tif", f"{folder}/a.tif"], f"{folder}/classes.tif", lines, areas, {"origin": (150.903, -32.901)})
    cells = {(c.row, c.col): c for c in made.cells.collect()}
    assert len(cells) == frame.rows * frame.cols and (frame.rows, frame.cols) == (made.facts["rows"], made.facts["cols"])
    centres = warp.cell_centres(spark.createDataFrame(list(cells), "row int, col int"), frame)
    degrees = {(p.row, p.col): ((-32.89 - p.y) / 0.001, (p.x - 150.89) / 0.001) for p in warp.to_system(centres, TransverseMercator(), Geographic()).collect()}
    pixels = {(p.row, p.col): ((north - p.y) / 50, (p.x - west) / 50) for p in warp.to_system(centres, TransverseMercator(), LambertConic(), Datum().reversed()).collect()}
    for k, c in cells.items():
        y, x = degrees[k]
        r, s = math.floor(y - 0.5), math.floor(x - 0.5)
        four = [((1 - abs(y - 0.5 - a)) * (1 - abs(x - 0.5 - b)), heights[a, b]) for a in (r, r + 1) for b in (s, s + 1) if heights.get((a, b)) is not None]
        assert c.elevation == pytest.approx(sum(w * v for w, v in four) / sum(w for w, _ in four), abs=1e-6)
        value = classes.get(tuple(map(math.floor, pixels[k])), 65535)
        assert c.value == value and c.native_vegetation == (value > 0) and c.closed == (value == 65535)
        z = lambda i, j: cells[i, j].elevation
        (i, j), n, m = k, frame.rows - 1, frame.cols - 1
        gy = (z(min(i + 1, n), j) - z(max(i - 1, 0), j)) / (100 * (min(i + 1, n) - max(i - 1, 0)))
        gx = (z(i, min(j + 1, m)) - z(i, max(j - 1, 0))) / (100 * (min(j + 1, m) - max(j - 1, 0)))
        assert c.slope == pytest.approx(math.degrees(math.atan(math.hypot(gx, gy))), abs=1e-6) and c.terrain == pytest.approx(min(1, c.slope / 20), abs=1e-6)
        assert c.protected_land == (1 <= i <= 5 and 1 <= j <= 5) and c.hydrography == (i == 6 and j <= 7) and c.length == 1
        assert c.roads == (i == j and i <= 4 or abs(i - j) == 1 and max(i, j) <= 4) and c.railways == (j == 1 and i <= 3)
    header = derive.write_bundle(made, f"{folder}/bundle")
    stored = writers.read_grid(spark, f"{folder}/bundle/grids", ["roads"])
    assert stored.count() == len(cells) and stored.agg(F.sum("value")).first()[0] == sum(c.roads for c in cells.values())
    assert header["diagnostics"]["cells"] == len(cells) and header["origin_cell"] == made.facts["origin_cell"]
    assert json.loads(json.dumps(header, default=str))["rows"] == writers.read_document(spark, f"{folder}/bundle/bundle.json")["rows"]
    with pytest.raises(FileExistsError):
        derive.write_bundle(made, f"{folder}/bundle")


def test_what_a_derivation_refuses(spark, area):
    folder, _, classes, _, frame = area
    lines, areas = layers(spark, frame)
    with pytest.raises(ValueError, match="layers differ"):
        derive.derive(spark, ENVELOPE, [f"{folder}/a.tif"], f"{folder}/classes.tif", {}, areas)
    with pytest.raises(ValueError, match="under the grid"):
        derive.derive(spark, (151.5, -32.5, 151.51, -32.49), [f"{folder}/a.tif"], f"{folder}/classes.tif", lines, areas)
    with pytest.raises(ValueError, match="no height tiles"):
        derive.derive(spark, ENVELOPE, [], f"{folder}/classes.tif", lines, areas)
    with pytest.raises(derive.OutsideGrid, match="outside"):
        derive.endpoint_cells(spark, {"origin": (150.5, -32.9)}, frame)
    inside = derive.endpoint_cells(spark, {"origin": (150.905, -32.905)}, frame)["origin"]
    with pytest.raises(derive.OutsideGrid, match="without values"):
        derive.endpoint_cells(spark, {"origin": (150.905, -32.905)}, frame, spark.createDataFrame([inside], "row int, col int"))


def test_reports_and_documents(spark, tmp_path):
    """A selection with its attempts, and a document that is replaced while it is there."""
    selected = spark.createDataFrame([("t1", "b")], "tile string, source string")
    attempts = spark.createDataFrame([("a", "failed"), ("b", "valid")], "source string, status string").coalesce(1)
    path = f"file://{tmp_path}/report.json"
    for _ in range(2):
        writers.write_report(selected, path, attempts)
    assert writers.read_document(spark, path)["attempts"] == [{"source": "a", "status": "failed"}, {"source": "b", "status": "valid"}]
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["report.json"]
