"""Manifests of acquired layers as tables, and headers of records whose fields are required."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "scenario string, sources array<struct<source_id:string,layers:array<struct<component:string,layer_id:string,geometry_type:string,feature_count:long,output_crs_epsg:int,artifact_path:string>>>>"
#: Fields of an artifact's header that its canonical form keeps (fixed names of the format).
CANONICAL = ("layer_id", "layer_name", "geometry_type", "source_crs_epsg", "output_crs_epsg", "processing_envelope", "query")
ARTIFACT_FORMAT, CANONICAL_FORMAT = "arcgis-json-feature-collection", "ico-canonical-vector-feature-collection"


class RecordError(ValueError):
    """A record lacks a field, or has one of another type."""


def require_fields(record: object, fields: dict[str, type | tuple[type, ...]], where: str = "record") -> dict:
    """The record, if it is an object with all the fields (dots lead inwards) and each is of its type; true is no number."""
    if not isinstance(record, dict):
        raise RecordError(f"{where} is no object")
    for name, kind in fields.items():
        value: object = record
        for part in name.split("."):
            if not isinstance(value, dict) or part not in value:
                raise RecordError(f"{where} lacks {name}")
            value = value[part]
        kinds = kind if isinstance(kind, tuple) else (kind,)
        if not isinstance(value, kinds) or (isinstance(value, bool) and bool not in kinds):
            raise RecordError(f"{name} of {where} is {type(value).__name__}")
    return record


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """source_id, component, layer_id, geometry_type, feature_count, output_crs_epsg, artifact_path, seq of a manifest's layers in
    their order. A file that is no such JSON fails the read; a manifest without sources has no rows."""
    found = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    sources = found.select(F.posexplode("sources").alias("s", "source"))
    layers = sources.select("s", "source.source_id", F.posexplode("source.layers").alias("l", "layer"))
    return layers.select("source_id", "layer.*", F.struct("s", "l").alias("seq"))


def first_layers(entries: DataFrame) -> DataFrame:
    """component and the other columns of the first layer of each component, by seq."""
    rest = [c for c in entries.columns if c not in ("component", "seq")]
    return entries.groupBy("component").agg(F.min_by(F.struct(*rest), "seq").alias("first")).select("component", "first.*")


def layer_of(entries: DataFrame, component: str) -> dict:
    """The first layer of a component; none is an error, as is one without an artifact."""
    found = first_layers(entries.filter(F.col("component") == component)).collect()
    if not found:
        raise RecordError(f"manifest has no layer {component}")
    if not found[0].artifact_path:
        raise RecordError(f"layer {component} has no artifact")
    return found[0].asDict()


def canonical_header(artifact: dict, component: str) -> dict:
    """The header of a canonical collection, with where it came from; fields that the artifact lacks are null."""
    require_fields(artifact, {"format": str, "source_id": str}, "artifact")
    if artifact["format"] != ARTIFACT_FORMAT:
        raise RecordError(f"unknown format {artifact['format']}")
    if not artifact["source_id"]:
        raise RecordError("artifact has no source")
    return {"schema_version": 1, "format": CANONICAL_FORMAT, "source_id": artifact["source_id"], "component": component, **{k: artifact.get(k) for k in CANONICAL}}
