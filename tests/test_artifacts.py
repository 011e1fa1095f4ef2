"""Sidecars, reports, manifests, stale files and downloads."""

import hashlib
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from gridwright.sources import artifacts, download

ENVELOPE = (150.82, -33.15, 151.62, -32.27)
GOOD = {"source_id": "a", "artifact_type": "raster", "artifact_path": "a.tif", "crs_epsg": 7856, "bounds_crs_epsg": 4326, "resolution_m": 30.0, "bounds": {"west": 150, "south": -34, "east": 152, "north": -32}, "nodata_defined": True, "coverage_status": "complete", "acquired_at_utc": "2024-01-02T03:04:05Z"}


def test_terrain(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(b"x")

    def problems(**changes):
        for f in tmp_path.glob("*.json"):
            f.unlink()
        (tmp_path / "s.json").write_text(json.dumps(GOOD | changes))
        return {r.problem for r in artifacts.terrain_violations(artifacts.read_terrain(spark, f"file://{tmp_path}/s.json"), ["a", "b"], ENVELOPE).collect()}

    assert problems() == set() == problems(artifact_path=f"{tmp_path}/a.tif") == problems(acquired_at_utc="2024-01-02T03:04:05+10:00")
    assert problems(bounds={"west": 151, "south": -34, "east": 152, "north": -32}) == {"bounds"}
    assert problems(nodata_defined=False) == {"nodata"} and problems(artifact_path="b.tif") == {"file"} and problems(source_id="c") == {"source"}
    assert problems(acquired_at_utc="") == {"time"} == problems(acquired_at_utc="2024-01-02T03:04:05") == problems(acquired_at_utc="soon")


def test_first_valid_terrain_wins(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(b"x")
    (tmp_path / "1.json").write_text(json.dumps(GOOD | {"coverage_status": "partial"}))
    (tmp_path / "2.json").write_text(json.dumps(GOOD | {"source_id": "b"}))
    found = artifacts.read_terrain(spark, f"file://{tmp_path}/[12].json")
    assert [r.source_id for r in artifacts.select_terrain(found, ["a", "b"], ["a", "b"], ENVELOPE).collect()] == ["b"]
    assert artifacts.select_terrain(found, ["a"], ["a", "b"], ENVELOPE).count() == 0


def test_reports(spark, tmp_path):
    box = {"west": 0.0, "south": 0.0, "east": 1.0, "north": 1.0}
    raster = {"representation": "raster", "coverage_status": "complete", "crs_epsg": 3308, "raster_width": 5, "raster_height": 5, "resolution_m": 5.0, "nodata_value": 65535, "value_table_fields": ["Value", "PCTID"], "bounds": box}
    vector = {"representation": "vector", "coverage_status": "complete", "crs_epsg": 3308, "fields": ["VALUE", "pctid", "x"], "feature_count": 3, "unique_id_count": 3, "duplicate_id_count": 0, "rest_count_reconciled": "true", "bounds": box}

    def problems(doc):
        (tmp_path / "r.json").write_text(json.dumps(doc))
        return {r.problem for r in artifacts.report_violations(spark.read.schema(artifacts.REPORT).json(f"file://{tmp_path}/r.json"), ["value", "pctid"], 3308).collect()}

    assert problems(raster) == problems(vector) == set()
    assert problems(raster | {"nodata_value": None}) == {"nodata"} and problems(raster | {"value_table_fields": ["Value"]}) == {"fields"}
    assert problems(vector | {"duplicate_id_count": 1}) == {"ids"} and problems(vector | {"rest_count_reconciled": "false"}) == {"count"} and problems(vector | {"crs_epsg": 1}) == {"crs"}


def test_metadata_and_probe(spark, tmp_path):
    layer = "struct<id:int,name:string,geometryType:string>"
    crs = "struct<wkid:int,latestWkid:int>"
    (tmp_path / "m.json").write_text("\n".join(json.dumps(x) for x in [{"url": "a", "spatialReference": {"wkid": 1, "latestWkid": 7844}, "layers": [{"id": 0, "name": "x"}]}, {"url": "b", "extent": {"spatialReference": {"wkid": 4283}}, "id": 3, "name": "y", "geometryType": "line"}]))
    m = spark.read.schema(f"url string, id int, name string, geometryType string, spatialReference {crs}, extent struct<spatialReference:{crs}>, layers array<{layer}>").json(f"file://{tmp_path}/m.json")
    got = {r.url: (r.crs, [tuple(x) for x in r.layers]) for r in artifacts.metadata_summary(m).collect()}
    assert got == {"a": (7844, [(0, "x", None)]), "b": (4283, [(3, "y", "line")])}
    s = spark.createDataFrame([("a", "use", False, None, 1, 1), ("b", "use", False, "x", 1, 1), ("c", "context", False, None, 1, 1), ("d", "use", True, None, 1, 1), ("e", "use", False, None, 2, 1)], "source_id string, role string, deferred boolean, error string, crs int, expected_crs int")
    assert [r.status for r in artifacts.probe_status(s).orderBy("source_id").collect()] == ["validated", "failed", "context-only", "deferred", "failed"]
    ends = spark.createDataFrame([("origin", 251)], "role string, id int")
    assert artifacts.endpoint_manifest(ends, spark.createDataFrame([(251, "n", 1.0, 2.0)], "id int, name string, lat double, lon double")).first()[:5] == ("origin", 251, "n", 1.0, 2.0)


def test_stale_files(spark, tmp_path):
    for name in (".staging-a/x.bin", "kept/y.bin"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    assert artifacts.stale_files(spark, f"file://{tmp_path}/.staging-a", 1).count() == 0
    old = artifacts.stale_files(spark, f"file://{tmp_path}/.staging-a", -1)
    assert len(artifacts.delete_stale(spark, old)) == 1 and (tmp_path / ".staging-a/x.bin").exists()
    artifacts.delete_stale(spark, artifacts.stale_files(spark, f"file://{tmp_path}/.staging-a", -1), dry_run=False)
    assert not (tmp_path / ".staging-a/x.bin").exists() and (tmp_path / "kept/y.bin").exists()
    assert spark.range(1).select(F.lit(1)).count() == 1


DATA = bytes(range(256)) * 50


class Files(BaseHTTPRequestHandler):
    tag, ranges, gets = hashlib.md5(DATA).hexdigest(), True, 0

    def answer(self, body):
        start = int((self.headers.get("Range") or "bytes=0-")[6:-1])
        part = self.ranges and start > 0
        self.send_response(206 if part else 200)
        if part:
            self.send_header("Content-Range", f"bytes {start}-{len(DATA) - 1}/{len(DATA)}")
        self.send_header("Content-Length", str(len(DATA) - (start if part else 0)))
        self.send_header("ETag", f'"{self.tag}"')
        self.end_headers()
        if body:
            type(self).gets += 1
            self.wfile.write(DATA[start if part else 0 :])

    def do_GET(self):
        self.answer(True)

    def do_HEAD(self):
        self.answer(False)

    def log_message(self, *args):
        pass


@pytest.mark.parametrize("ranges", [True, False])
def test_download(tmp_path, ranges):
    server = HTTPServer(("127.0.0.1", 0), Files)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url, to = f"http://127.0.0.1:{server.server_port}/f", tmp_path / "f"
    Files.tag, Files.ranges, Files.gets = hashlib.md5(DATA).hexdigest(), ranges, 0
    (tmp_path / "f.part").write_bytes(DATA[:700])
    assert download.fetch(url, to, 10**6).read_bytes() == DATA and not (tmp_path / "f.part").exists()
    download.fetch(url, to, 10**6)
    assert Files.gets == 1
    with pytest.raises(download.DownloadError):
        download.fetch(url, tmp_path / "g", 100)
    Files.tag = "0" * 32
    with pytest.raises(download.DownloadError):
        download.fetch(url, tmp_path / "g", 10**6)
    assert not (tmp_path / "g").exists()
    Files.tag = "0" * 32 + "-3"
    assert download.fetch(url, tmp_path / "g", 10**6).read_bytes() == DATA
    server.shutdown()
