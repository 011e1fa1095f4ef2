"""Manifests, required fields and canonical headers."""

import json

import pytest

from gridwright.sources import manifest


def test_required_fields():
    record = {"a": {"b": 1, "flag": True}, "name": "x"}
    assert manifest.require_fields(record, {"a.b": (int, float), "name": str, "a.flag": bool}) is record
    for bad, fields in (([], {}), (record, {"c": str}), (record, {"a.c": str}), (record, {"name.b": str}), (record, {"name": int}), (record, {"a.flag": int})):
        with pytest.raises(manifest.RecordError):
            manifest.require_fields(bad, fields)


def test_layers_of_a_manifest(spark, tmp_path):
    layer = lambda c, i, p: {"component": c, "layer_id": i, "geometry_type": "polyline", "feature_count": 3, "output_crs_epsg": 7856, "artifact_path": p}
    path = tmp_path / "manifest.json"
    path.write_text(json.dumps({"scenario": "S1", "sources": [{"source_id": "a", "layers": [layer("roads", "1", "r1"), layer("railways", "2", None)]}, {"source_id": "b", "layers": [layer("roads", "9", "r9")]}]}, indent=1))
    entries = manifest.read_entries(spark, f"file://{path}")
    assert entries.count() == 3
    found = manifest.layer_of(entries, "roads")
    assert (found["source_id"], found["layer_id"], found["artifact_path"]) == ("a", "1", "r1")
    for component in ("water", "railways"):
        with pytest.raises(manifest.RecordError):
            manifest.layer_of(entries, component)
    path.write_text("{broken")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        manifest.read_entries(spark, f"file://{path}").collect()


def test_canonical_header():
    artifact = {"format": manifest.ARTIFACT_FORMAT, "source_id": "s", "layer_id": 4, "query": {"where": "1=1"}, "features": [1]}
    header = manifest.canonical_header(artifact, "roads")
    assert header["component"] == "roads" and header["layer_id"] == 4 and header["query"] == {"where": "1=1"} and header["source_crs_epsg"] is None and "features" not in header
    for bad in ({}, artifact | {"format": "other"}, artifact | {"source_id": ""}, artifact | {"source_id": 5}):
        with pytest.raises(manifest.RecordError):
            manifest.canonical_header(bad, "roads")
