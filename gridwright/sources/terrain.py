"""Acquisition of one-degree terrain tiles: every tile is fetched in a task, checked against its sidecar, and listed.

The folder must be one that driver and executors share (a mounted path). Nothing is listed before all tiles
of the envelope are there and right; a repeated call continues what an earlier one left.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import dem_tile_ids
from .download import DownloadError, fetch, md5_of
from .geotiff import read_headers, read_sidecars, tile_violations
from .writers import write_document

#: Nodata value of the tiles, and how far the bounds of a header and its sidecar may differ in degrees (fixed values).
NODATA, BOUNDS_DIFFER = -32767, 0.001
SIDES = ("west", "south", "east", "north")


def fetch_tiles(tiles: DataFrame, address: str, folder: str, most_bytes: int) -> DataFrame:
    """tile_id, bytes, md5 of tiles(tile_id) under the folder, and their XML; address holds {tile} and {kind}."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for tile in frame["tile_id"]:
                got = [fetch(address.format(tile=tile, kind=kind), Path(folder) / f"{tile}.{kind}", most_bytes) for kind in ("tif", "xml")]
                rows.append((tile, got[0].stat().st_size, md5_of(got[0])))
            yield pd.DataFrame(rows, columns=["tile_id", "bytes", "md5"])

    return tiles.select("tile_id").mapInPandas(each, "tile_id string, bytes long, md5 string")


def tile_problems(spark: SparkSession, fetched: DataFrame, folder: str) -> DataFrame:
    """tile_id, problem: broken headers, sidecars that are missing or say other bounds, another nodata value."""
    name = F.regexp_extract("path", r"([^/]+)\.\w+$", 1).alias("tile_id")
    headers = read_headers(spark, f"file://{folder}/*.tif")
    sides = read_sidecars(spark, f"file://{folder}/*.xml").select(name, "invalid_value", *(F.col(c).alias("x" + c) for c in SIDES))
    near = F.lit(True)
    for c in SIDES:
        near = near & (F.abs(F.col(c) - F.col("x" + c)) <= BOUNDS_DIFFER)
    both = fetched.select("tile_id").join(headers.select(name, *SIDES), "tile_id", "left").join(sides, "tile_id", "left")
    bad = F.when(~F.coalesce(near, F.lit(False)), "bounds").when(~F.coalesce(F.col("invalid_value") == NODATA, F.lit(False)), "nodata")
    wrong = tile_violations(headers).select(name, "problem").join(fetched.select("tile_id"), "tile_id", "left_semi")
    return wrong.union(both.select("tile_id", bad.alias("problem")).filter("problem is not null"))


def acquire_tiles(spark: SparkSession, envelope: tuple[float, float, float, float], folder: str, address: str, source_id: str, most_tiles: int = 16, most_bytes: int = 300_000_000) -> dict:
    """The header of a complete set of terrain tiles, written beside the tiles and their list; DownloadError if a rule is broken."""
    if most_tiles <= 0 or most_bytes <= 0:
        raise ValueError("limits must be positive")
    wanted = dem_tile_ids(spark.createDataFrame([tuple(map(float, envelope))], "west double, south double, east double, north double"))
    n = wanted.count()
    if not 0 < n <= most_tiles:
        raise DownloadError(f"{n} tiles, at most {most_tiles}")
    Path(folder).mkdir(parents=True, exist_ok=True)
    listing = f"file://{folder}/tiles.parquet"
    at = wanted.select("tile_id", "lat", "lon")
    fetch_tiles(at.repartition(n, "tile_id"), address, folder, most_bytes).join(at, "tile_id").write.mode("overwrite").parquet(listing)
    tiles = spark.read.parquet(listing)
    problem = tile_problems(spark, tiles, folder).orderBy("tile_id", "problem").first()
    if problem:
        raise DownloadError(f"{problem.tile_id}: {problem.problem}")
    sums = tiles.agg(F.sum("bytes").alias("bytes"), F.min("lon").alias("west"), F.min("lat").alias("south"), (F.max("lon") + 1).alias("east"), (F.max("lat") + 1).alias("north")).first()
    if sums["bytes"] > most_bytes:
        raise DownloadError(f"{sums['bytes']} bytes, at most {most_bytes}")
    now = spark.range(1).select(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")).first()[0]
    header = {
        "source_id": source_id, "artifact_type": "raster-tile-set", "artifact_path": "tiles.parquet", "bounds": {c: float(sums[c]) for c in SIDES}, "bounds_crs_epsg": 4326, "crs_epsg": 4326, "resolution_m": 30.0,
        "nodata_defined": True, "nodata_value": NODATA, "coverage_status": "complete", "acquired_at_utc": now, "tile_count": n, "tile_bytes": sums["bytes"], "requested_envelope": dict(zip(SIDES, map(float, envelope), strict=True)),
    }
    write_document(spark, header, f"file://{folder}/terrain_manifest.json")
    return header
