"""Terrain tiles from a server, and service metadata."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from gridwright.sources import artifacts, feature_service, terrain
from gridwright.sources.download import DownloadError
from test_sources import tiff

NAMES = [f"Copernicus_DSM_COG_10_S33_00_E{lon}_00_DEM" for lon in (150, 151)]


def sidecar(west, nodata=-32767):
    return f'<r><westBoundLongitude>{west}</westBoundLongitude><eastBoundLongitude>{west + 1}</eastBoundLongitude><southBoundLatitude>-33</southBoundLatitude><northBoundLatitude>-32</northBoundLatitude><resolution>30</resolution><nrInvalidPixels valueInvalidPixels="{nodata}">0</nrInvalidPixels></r>'.encode()


class Files(BaseHTTPRequestHandler):
    files: dict[str, bytes] = {}

    def answer(self, body):
        data = self.files.get(self.path.split("?")[0])
        self.send_response(200 if data is not None else 404)
        self.send_header("Content-Length", str(len(data or b"")))
        self.end_headers()
        if body:
            self.wfile.write(data or b"")

    def do_GET(self):
        self.answer(True)

    def do_HEAD(self):
        self.answer(False)

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    Files.files = {}
    for i, name in enumerate(NAMES):
        Files.files |= {f"/{name}.tif": tiff(t33922=("d", [0, 0, 0, 150 + i, -32, 0])), f"/{name}.xml": sidecar(150 + i)}
    http = HTTPServer(("127.0.0.1", 0), Files)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}"
    http.shutdown()


def test_terrain_tiles(spark, tmp_path, server):
    get = lambda folder, **limits: terrain.acquire_tiles(spark, (150.2, -32.9, 151.5, -32.1), str(tmp_path / folder), server + "/{tile}.{kind}", "heights", **limits)
    header = get("a")
    assert header["tile_count"] == 2 and header["bounds"] == {"west": 150.0, "south": -33.0, "east": 152.0, "north": -32.0} and header["tile_bytes"] == 2 * len(tiff())
    assert json.loads((tmp_path / "a/terrain_manifest.json").read_text())["coverage_status"] == "complete"
    assert sorted(r.tile_id for r in spark.read.parquet(f"file://{tmp_path}/a/tiles.parquet").collect()) == NAMES
    assert get("a")["tile_count"] == 2  # a second call keeps the files
    with pytest.raises(DownloadError):
        get("b", most_tiles=1)
    with pytest.raises(DownloadError):
        get("c", most_bytes=2 * len(tiff()) - 1)
    with pytest.raises(ValueError):
        get("d", most_tiles=0)
    for i, broken in enumerate((sidecar(140), sidecar(150, 0))):
        Files.files[f"/{NAMES[0]}.xml"] = broken
        with pytest.raises(DownloadError, match="bounds" if i == 0 else "nodata"):
            get(f"e{i}")
        assert not (tmp_path / f"e{i}/terrain_manifest.json").exists()


def test_service_metadata(spark, server):
    Files.files["/one"] = json.dumps({"id": 3, "name": "Roads", "geometryType": "line", "extent": {"spatialReference": {"wkid": 102100, "latestWkid": 3857}}}).encode()
    Files.files["/all"] = json.dumps({"spatialReference": {"wkid": 7856}, "layers": [{"id": 0, "name": "Rivers", "geometryType": "line"}]}).encode()
    urls = spark.createDataFrame([(f"{server}/one",), (f"{server}/all/",)], "url string")
    got = {r.url[len(server) + 1 :]: (r.crs, [tuple(x) for x in r.layers]) for r in artifacts.metadata_summary(feature_service.service_metadata(urls)).collect()}
    assert got == {"one": (3857, [(3, "Roads", "line")]), "all/": (7856, [(0, "Rivers", "line")])}
