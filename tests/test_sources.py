"""Files, services, streams and checks on small inputs."""

import io
import json
import math
import struct
import threading
import urllib.error
import zipfile
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridwright.functions import scalar
from gridwright.functions.geo import TransverseMercator, columns
from gridwright.operators import assess, checks, grid, vector
from gridwright.operators.cost import COMPONENTS
from gridwright.sources import archives, assets, bundles, config, feature_service, geotiff
from gridwright.streaming import capture


def tiff(order="<", **tags):
    """A header of a one-degree tile at 150 E, 32 S."""
    base = {256: ("H", [3600]), 257: ("H", [3600]), 258: ("H", [32]), 259: ("H", [8]), 277: ("H", [1]), 322: ("H", [1024]), 323: ("H", [1024]), 33550: ("d", [1 / 3600, 1 / 3600, 0]), 33922: ("d", [0, 0, 0, 150, -32, 0]), 34735: ("H", [1, 1, 0, 1, 2048, 0, 1, 4326])}
    base |= {int(k[1:]): v for k, v in tags.items()}
    base = {k: v for k, v in base.items() if v}
    kinds, extra, body = {"H": 3, "I": 4, "d": 12}, b"", b""
    at = 8 + 2 + 12 * len(base) + 4
    for tag, (kind, values) in sorted(base.items()):
        data = struct.pack(order + kind * len(values), *values)
        if len(data) > 4:
            field, extra = struct.pack(order + "I", at + len(extra)), extra + data
        else:
            field = data.ljust(4, b"\0")
        body += struct.pack(order + "HHI", tag, kinds[kind], len(values)) + field
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HIH", 42, 8, len(base)) + body + bytes(4) + extra


def test_tiff_headers(spark, tmp_path):
    for name, data in {"a": tiff(), "b": tiff(">"), "c": tiff(t277=None), "d": b"II\0\0", "e": tiff(t256=("H", [1800]))}.items():
        (tmp_path / f"{name}.tif").write_bytes(data)
    rows = {r.path[-5]: r for r in geotiff.read_headers(spark, f"file://{tmp_path}").collect()}
    for k in "ab":
        r = rows[k]
        assert (r.width, r.bits, r.crs_epsg, r.west, r.east, r.north, r.error) == (3600, 32, 4326, 150.0, 151.0, -32.0, None) and abs(r.south + 33) < 1e-9
    assert "277" in rows["c"].error and rows["d"].error
    bad = {r.path[-5]: r.problem for r in geotiff.tile_violations(geotiff.read_headers(spark, f"file://{tmp_path}")).collect()}
    assert bad == {"c": "header", "d": "header", "e": "size"}


def test_xml_sidecars(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<g:root xmlns:g="u"><g:westBoundLongitude><g:Decimal>150</g:Decimal></g:westBoundLongitude><eastBoundLongitude>151</eastBoundLongitude><southBoundLatitude>-33</southBoundLatitude><northBoundLatitude>-32</northBoundLatitude><resolution>30</resolution><nrInvalidPixels valueInvalidPixels="-32767">7</nrInvalidPixels></g:root>')
    r = geotiff.read_sidecars(spark, f"file://{tmp_path}").first()
    assert (r.west, r.south, r.east, r.north, r.resolution, r.invalid_value, r.invalid_pixels) == (150, -33, 151, -32, 30, -32767, 7)


def test_raster_identity(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<m:meta xmlns:m="u"><m:title>Release_7</m:title><identCode code="3308"/><NoDataValue> 65535 </NoDataValue></m:meta>')
    (tmp_path / "b.xml").write_text("<meta><title>other</title><identCode code='1'/></meta>")
    got = {(r.path[-5], r.problem) for r in geotiff.identity_violations(spark, f"file://{tmp_path}", "Release_7", 3308, 65535).collect()}
    assert got == {("b", "release"), ("b", "crs"), ("b", "nodata")}


def dbf(fields, rows):
    head = struct.pack("<B3xIHH20x", 3, len(rows), 33 + 32 * len(fields), 1 + sum(f[2] for f in fields))
    body = b"".join(n.encode().ljust(11, b"\0") + k.encode() + bytes(4) + bytes([size, dec]) + bytes(14) for n, k, size, dec in fields)
    return head + body + b"\r" + b"".join(mark + b"".join(str(v).encode().ljust(f[2]) for v, f in zip(r, fields, strict=True)) for mark, r in rows)


def test_archives(spark, tmp_path):
    table = dbf([("Value", "N", 6, 0), ("PCTName", "C", 8, 0), ("share", "F", 6, 2)], [(b" ", (1, "old", 1.5)), (b"*", (2, "gone", 1)), (b" ", (1, "new", "")), (b" ", ("", "none", 2))])
    fields, rows = archives.parse_dbf(table)
    assert fields == ["Value", "PCTName", "share"] and rows[0] == {"Value": 1, "PCTName": "old", "share": 1.5} and rows[1]["share"] is None and len(rows) == 3
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, content in {"m/x.tif.vat.dbf": table, "m/x.tif": b"1", "a.SHP": b"", "../up.txt": b"2", "/abs": b""}.items():
            z.writestr(name, content)
    (tmp_path / "p.zip").write_bytes(data.getvalue())
    got = {r.name: (r.kind, r.unsafe, r.intact) for r in archives.read_members(spark, f"file://{tmp_path}").collect()}
    assert got == {"m/x.tif.vat.dbf": ("classes", False, True), "m/x.tif": ("raster", False, True), "a.SHP": ("vector", False, True), "../up.txt": ("other", True, True), "/abs": ("other", True, True)}
    assert [tuple(r) for r in archives.read_classes(spark, f"file://{tmp_path}", "m/x.tif.vat.dbf", {"PCTName": "name"}).collect()] == [(1, "new")]
    with pytest.raises(PySparkException):
        archives.read_members(spark, f"file://{tmp_path}", most=2).collect()


class Service(BaseHTTPRequestHandler):
    ids: list | None = list(range(1, 8))
    cut, other, failures = False, False, 0

    def do_GET(self):
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        if type(self).failures > 0:
            type(self).failures -= 1
            self.send_response(503)
            self.end_headers()
            return
        if q.get("returnIdsOnly") == "true":
            body = {"objectIds": self.ids}
        else:
            ids = [int(i) for i in q["objectIds"].split(",")]
            body = {"spatialReference": {"wkid": int(q["outSR"])}, "exceededTransferLimit": self.cut, "features": [{"attributes": {"OBJECTID": i + self.other, "Name": f"f{i}", "n": None}, "geometry": {"x": i, "y": 0}} for i in ids]}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def service():
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Service.ids, Service.cut, Service.other, Service.failures = list(range(1, 8)), False, False, 0
    yield f"http://127.0.0.1:{server.server_port}/layer/0"
    server.shutdown()


def test_feature_service(spark, service):
    feature_service.register(spark)
    read = lambda: sorted(spark.read.format("feature_service").option("url", service).option("pagesize", 3).load().collect())
    rows = read()
    assert [r.object_id for r in rows] == list(range(1, 8)) and rows[0].attributes == {"OBJECTID": "1", "Name": "f1", "n": None} and json.loads(rows[2].geometry) == {"x": 3, "y": 0}
    Service.failures = 1
    assert len(read()) == 7
    Service.ids = None
    assert read() == []
    Service.ids, Service.cut = [1, 2], True
    with pytest.raises(PySparkException):
        read()
    Service.cut, Service.other = False, True
    with pytest.raises(PySparkException):
        read()


def test_client_retries_and_limits():
    waits, answers = [], [urllib.error.HTTPError("u", 503, "busy", {}, None), urllib.error.URLError("gone"), b'{"error": {"code": 504}}', b'{"ok": 1}']

    def opener(url, timeout):
        x = answers.pop(0)
        if isinstance(x, Exception):
            raise x
        return io.BytesIO(x)

    assert feature_service.Client(opener=opener, sleeper=waits.append).fetch("u", {"a": True, "b": None}) == {"ok": 1} and waits == [1, 2, 4]
    assert feature_service.encoded({"a": True, "b": None, "c": 1}) == "f=json&a=true&c=1"
    for body in (b"[1]", b'{"error": {"code": 400}}', b"x" * 100):
        answers[:] = [body]
        with pytest.raises((feature_service.ServiceError, ValueError)):
            feature_service.Client(opener=opener, most_bytes=50, retries=0).fetch("u", {})
    with pytest.raises(ValueError):
        feature_service.Client(timeout=0)


def test_capture_stream(spark, tmp_path):
    pages, out, mark = (tmp_path / x for x in ("pages", "out", "mark"))
    pages.mkdir()
    put = lambda n, ids: (pages / f"{n}.json").write_text("\n".join(json.dumps({"tile": n, "page": 0, "id": i, "value": 1.0}) for i in ids))
    put(1, [1, 2, 3])
    run = lambda: capture.capture_available(capture.first_captures(capture.page_stream(spark, f"file://{pages}")), f"file://{out}", f"file://{mark}").awaitTermination()
    run()
    put(2, [3, 4])
    run()
    got = spark.read.parquet(f"file://{out}")
    assert sorted(r.id for r in got.collect()) == [1, 2, 3, 4]
    assert capture.complete(got, spark.range(1, 5)) and not capture.complete(got, spark.range(1, 6))


def bundle(**changes):
    grids = {c: [[5.0 if c == "length" and j == 3 and 1 <= i <= 5 else 0.0 for j in range(7)] for i in range(7)] for c in COMPONENTS}
    return {"schema_version": 1, "format": "f", "scenario": "s", "analysis_crs_epsg": 7856, "cell_size_m": 100.0, "endpoints": {"origin": {"row": 0, "col": 0}, "destination": {"row": 6, "col": 6}}, "unavailable_cells": [], "component_grids": grids} | changes


def test_bundles(spark, tmp_path):
    def problems(doc):
        (tmp_path / "b.json").write_text(json.dumps(doc))
        return {r.problem for r in bundles.bundle_violations(bundles.read_bundle(spark, f"file://{tmp_path}/b.json"), "s", 7856, 100.0).collect()}

    assert problems(bundle()) == set()
    x = bundles.bundle_layers(bundles.read_bundle(spark, f"file://{tmp_path}/b.json"))
    assert x.count() == 7 * 49 and x.filter("value = 5").count() == 5
    assert problems(bundle(scenario="t")) == {"scenario"}
    assert problems(bundle(unavailable_cells=[{"row": 0, "col": 0}])) == {"endpoint unavailable"}
    assert problems(bundle(unavailable_cells=[{"row": 0, "col": 9}])) == {"unavailable cells"}
    assert problems(bundle(endpoints={"origin": {"row": 0, "col": 0}, "destination": {"row": 7, "col": 7}})) == {"endpoints"}
    lost = bundle()
    del lost["component_grids"]["roads"]
    assert "components" in problems(lost)
    ragged = bundle()
    ragged["component_grids"]["roads"][2] = [0.0]
    assert "ragged" in problems(ragged)


def test_config(tmp_path, spark):
    (tmp_path / "c.json").write_text('{"presets": {}}')
    assert config.load(tmp_path / "c.json") == {"presets": {}}
    for text in ("[]", "{"):
        (tmp_path / "c.json").write_text(text)
        with pytest.raises(config.ConfigError):
            config.load(tmp_path / "c.json")
    with pytest.raises(config.ConfigError):
        config.weight_table(spark, {"p": {"length": 1.0}})
    assert config.weight_table(spark, {"p": dict.fromkeys(COMPONENTS, 0.5)}).count() == 7


def test_assets(spark, tmp_path):
    r = spark.createDataFrame([("balanced", 1, 151.0, -32.5), ("balanced", 0, 150.5, -32.0)], "preset string, step int, lon double, lat double")
    assert json.loads(assets.geojson_lines(r).first().feature)["geometry"]["coordinates"] == [[150.5, -32.0], [151.0, -32.5]]
    rows = spark.createDataFrame([('a"b', "c,d", None)], "x string, y string, z int")
    assert assets.csv_lines(rows).first().line == '"a""b","c,d",'
    assets.publish(r, f"file://{tmp_path}/out")
    with pytest.raises(PySparkException):
        assets.publish(r, f"file://{tmp_path}/out")


def test_scalars(spark):
    one = spark.range(1)
    assert one.select(F.array(*(scalar.clamp_unit(F.lit(x), 0, 10) for x in (5.0, -1.0, 11.0)))).first()[0] == [0.5, 0.0, 1.0]
    with pytest.raises(PySparkException):
        one.select(scalar.clamp_unit(F.lit(math.inf), 0, 10)).collect()
    with pytest.raises(ValueError):
        scalar.clamp_unit(F.lit(1.0), 1, 1)
    assert tuple(one.select(scalar.shown_number(F.lit(1234.56), 1), scalar.shown_number(F.lit(None).cast("double"))).first()) == ("1,234.6", "—")


def test_projection_and_snap(spark):
    tm = TransverseMercator()
    p = spark.createDataFrame([(150.9, -32.4), (153.0, -33.0)], "lon double, lat double")
    x, y = columns(tm.forward_sql("lon", "lat"))
    lon, lat = columns(tm.inverse_sql("x", "y"))
    for r in p.withColumns({"x": x, "y": y}).withColumns({"lon2": lon, "lat2": lat}).collect():
        assert abs(r.lon - r.lon2) < 1e-9 and abs(r.lat - r.lat2) < 1e-9
    assert abs(p.withColumns({"x": x}).filter("lon = 153").first().x - 500_000) < 1e-6


def test_routes_and_features(spark):
    route = spark.createDataFrame([("p", i, i, i) for i in range(3)], "preset string, step int, row int, col int")
    r = assess.route_length(route).first()
    assert (round(r.length_m, 6), r.bad_steps) == (round(200 * math.sqrt(2), 6), 0)
    assert assess.route_length(route.withColumn("col", F.col("col") * 2)).first().bad_steps == 2
    assert assess.unavailable_hits(route, spark.createDataFrame([(1, 1)], "row int, col int")).count() == 1
    seg = "x1 double, y1 double, x2 double, y2 double"
    line = spark.createDataFrame([("p", 0.0, 0.0, 100.0, 0.0)], "preset string, " + seg)
    f = spark.createDataFrame([(7, 50.0, -10.0, 50.0, 10.0), (8, 100.0, -10.0, 100.0, 10.0), (9, 101.0, -10.0, 101.0, 10.0)], "id int, " + seg)
    assert sorted(x.id for x in vector.intersecting(line, f, 30.0).collect()) == [7, 8]
    x = spark.createDataFrame([({"RoadNameBase": "Pacific", "FunctionHierarchy": "2", "LaneCount": "2", "ObjectId": "42"},), ({"name": "x"},)], "attributes map<string,string>")
    a, b = vector.canonical_features(x, "roads").collect()
    assert a.object_id == 42 and a.properties == {"name": "Pacific", "hierarchy": "2", "lane_count": "2"} and a.attributes["RoadNameBase"] == "Pacific" and b.object_id is None
    loop = spark.createDataFrame([(1, [[[0.0, 0.0], [10.0, 10.0], [10.0, 0.0], [0.0, 10.0]]]), (2, [[[0.0, 0.0], [5.0, 5.0], [9.0, 0.0]], [[1.0, 1.0]]])], "id int, paths array<array<array<double>>>")
    s = vector.polyline_segments(loop)
    assert s.count() == 5 and [x.id for x in vector.crossings_of_itself(s, "id", 4.0).collect()] == [1]


def test_checks(spark):
    with pytest.raises(checks.CheckFailed):
        checks.require_none(spark.range(3), "rows")
    checks.require_none(spark.range(0), "rows")
    with pytest.raises(ValueError):
        checks.over_limits(spark.range(1), {"id": 0})
    flat = spark.createDataFrame([(0, 0, 5.0)], "row int, col int, elevation double")
    assert grid.slope(flat).first().slope == 0
    tiles = spark.createDataFrame([("b", 0, 0, 2.0), ("a", 0, 0, -32767.0), ("c", 0, 0, 3.0)], "path string, row int, col int, value double")
    assert grid.mosaic(tiles).first().value == 2.0
