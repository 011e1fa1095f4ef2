"""Writers: single documents, layers, page caches, route sets, raster blocks. All appear whole or not at all.

Tables go through Spark's committer; documents of the driver are written beside their place and renamed.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 256


def _store(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_document(spark: SparkSession, record: dict, path: str) -> None:
    """One JSON document, indented. It is written beside its place and renamed over the old one, so a reader finds the one or the other."""
    store, at = _store(spark, path)
    beside = at.suffix(".tmp")
    out = store.create(beside, True)
    try:
        out.write(bytearray((json.dumps(record, indent=2, default=str) + "\n").encode()))
    finally:
        out.close()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    whole = store.makeQualified(at)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), conf).rename(store.makeQualified(beside), whole, options)


def read_document(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def require_absent(spark: SparkSession, path: str) -> None:
    store, at = _store(spark, path)
    if store.exists(at):
        raise FileExistsError(path)


def publish_routes(routes: DataFrame, path: str, **facts) -> dict:
    """A route set: one folder a preset and a manifest, staged beside the destination, which must not exist, and renamed."""
    spark = routes.sparkSession
    require_absent(spark, path)
    staged = path.rstrip("/") + ".staged"
    routes.repartition("preset").sortWithinPartitions("preset", "step").write.mode("overwrite").partitionBy("preset").json(staged)
    by = spark.read.schema(routes.schema).json(staged).groupBy("preset").agg(F.count("*").alias("cells"), F.min_by(F.array("row", "col"), "step").alias("origin"), F.max_by(F.array("row", "col"), "step").alias("destination"))
    listed = [r.asDict() | {"artifact_path": f"preset={r.preset}"} for r in by.orderBy("preset").collect()]  # presets are few
    manifest = {"format": "route-set", **facts, "routes": listed}
    write_document(spark, manifest, staged + "/routes_manifest.json")
    store, at = _store(spark, path)
    if not store.rename(_store(spark, staged)[1], at):
        raise OSError(f"cannot publish {path}")
    return manifest


def read_routes(spark: SparkSession, path: str) -> DataFrame:
    """The steps of a published set; its manifest must name every preset that is there."""
    manifest = read_document(spark, path + "/routes_manifest.json")
    rows = spark.read.schema("preset string, step int, row int, col int").json([f"{path}/{r['artifact_path']}" for r in manifest["routes"]])
    return rows.withColumn("preset", F.regexp_extract(F.input_file_name(), "preset=([^/]+)", 1)) if manifest["routes"] else rows


def write_layer(features: DataFrame, path: str, header: dict, limits: dict[str, int] | None = None) -> dict:
    """A layer: its features as JSON lines, and a header that is written when they are all there, with their number.

    limits: features and bytes at most; beyond them the layer is not completed."""
    spark = features.sparkSession
    require_absent(spark, path)
    features.write.json(path + "/features")
    back = spark.read.text(path + "/features").agg(F.count("*").alias("features"), F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0)).alias("bytes")).first().asDict()
    for name, most in (limits or {}).items():
        if back[name] > most:
            raise ValueError(f"layer has {back[name]} {name}, more than {most}")
    record = header | {"format": "feature-layer", "feature_count": back["features"], "feature_bytes": back["bytes"]}
    write_document(spark, record, path + "/layer.json")
    return record


def read_layer(spark: SparkSession, path: str, schema: str) -> tuple[dict, DataFrame]:
    """(header, features); a layer without a header is not complete and cannot be read."""
    return read_document(spark, path + "/layer.json"), spark.read.schema(schema).json(path + "/features")


def write_pages(pages: DataFrame, path: str, tiles_a_folder: int = 64) -> None:
    """Cached pages(tile, page, ...), a folder for so many tiles; pages written again replace the folders of their tiles,
    with what these held of other tiles and pages."""
    spark = pages.sparkSession
    new = pages.withColumn("bucket", F.expr(f"cast(tile div {tiles_a_folder} as long)"))
    store, at = _store(spark, path)
    beside = None
    if store.exists(at):
        kept = spark.read.schema(new.schema).parquet(path).join(new.select("bucket").distinct(), "bucket", "left_semi").join(new.select("tile", "page"), ["tile", "page"], "left_anti")
        # Spark does not overwrite what it reads: the new state goes to a folder beside, and from there
        beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
        new.unionByName(kept.select(new.columns)).write.parquet(beside)
        new = spark.read.schema(new.schema).parquet(beside)
    new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    if beside:
        store.delete(_store(spark, beside)[1], True)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def write_grid(layers: DataFrame, path: str) -> None:
    """A bundle of grids: cells by component."""
    layers.repartition("component").write.mode("errorifexists").partitionBy("component").parquet(path)


def read_grid(spark: SparkSession, path: str, components: list[str] | None = None) -> DataFrame:
    """component, row, col, value of a bundle; only the folders of the named components are read."""
    cells = spark.read.parquet(path)
    return cells.filter(F.col("component").isin(components)) if components else cells


def write_report(selected: DataFrame, path: str, attempts: DataFrame | None = None) -> dict:
    """What was selected, and how many candidates were tried, as one document: a row for each group; attempts(source, status, ...)
    are listed in their order."""
    report = {"format": "terrain-selection", "attempts": [r.asDict() for r in attempts.collect()] if attempts is not None else [], "selected": [r.asDict() for r in selected.orderBy(selected.columns[0]).collect()]}  # a row a tile
    write_document(selected.sparkSession, report, path)
    return report


# --- raster blocks -----------------------------------------------------------------------------


def write_raster(cells: DataFrame, path: str, nodata: float, kind: str = "<u2", **tags) -> None:
    """cells(row, col, value) as deflated blocks of BLOCK x BLOCK pixels, missing ones nodata, with nodata and tags as a document."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        block = np.full((BLOCK, BLOCK), nodata, kind)
        block[frame["row"] % BLOCK, frame["col"] % BLOCK] = frame["value"]
        return pd.DataFrame({"block_row": frame["row"][:1] // BLOCK, "block_col": frame["col"][:1] // BLOCK, "data": [zlib.compress(block.tobytes())]})

    known = cells.filter("value is not null").select(F.col("row").cast("int"), F.col("col").cast("int"), "value", F.floor(F.col("row") / BLOCK).alias("br"), F.floor(F.col("col") / BLOCK).alias("bc"))
    packed = known.groupBy("br", "bc").applyInPandas(lambda frame: pack(frame), "block_row int, block_col int, data binary")
    packed.write.mode("errorifexists").partitionBy("block_row").parquet(path + "/blocks")
    size = cells.agg(F.max("row").alias("r"), F.max("col").alias("c")).first()
    write_document(cells.sparkSession, {"rows": (size.r + 1) if size.r is not None else 0, "cols": (size.c + 1) if size.c is not None else 0, "nodata": nodata, "kind": kind, "tags": tags}, path + "/raster.json")


def read_raster(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """row, col, value of the pixels in window (row, col, rows, cols), nodata left out; only blocks that it touches are read."""
    facts = read_document(spark, path + "/raster.json")
    r0, c0, nr, nc = window or (0, 0, facts["rows"], facts["cols"])
    blocks = spark.read.schema("block_row int, block_col int, data binary").parquet(path + "/blocks")
    blocks = blocks.filter(F.col("block_row").between(r0 // BLOCK, (r0 + nr - 1) // BLOCK) & F.col("block_col").between(c0 // BLOCK, (c0 + nc - 1) // BLOCK))

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for br, bc, data in zip(frame["block_row"], frame["block_col"], frame["data"], strict=True):
                block = np.frombuffer(zlib.decompress(data), facts["kind"]).reshape(BLOCK, BLOCK)
                r, c = np.nonzero(block != facts["nodata"])
                row, col = r + br * BLOCK, c + bc * BLOCK
                keep = (row >= r0) & (row < r0 + nr) & (col >= c0) & (col < c0 + nc)
                yield pd.DataFrame({"row": row[keep].astype(np.int32), "col": col[keep].astype(np.int32), "value": block[r[keep], c[keep]].astype(float)})

    return blocks.mapInPandas(each, "row int, col int, value double")
