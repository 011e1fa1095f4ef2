"""Headers of GeoTIFF files, read in ranges, and their XML sidecars, read as text files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ranges, tiff

HEADER = "path string, width int, height int, bits int, samples int, tiled boolean, pixel_x double, pixel_y double, west double, south double, east double, north double, crs_epsg int, nodata string, error string"
#: Tags that a header must hold (fixed values): size, bits, compression, samples, tile size, pixel scale, tie point, geo keys.
REQUIRED = [256, 257, 258, 259, 277, 322, 323, 33550, 33922, 34735]


def parse_header(data) -> dict:
    """Values of HEADER without path and error, from bytes or a seekable file; ValueError for what is no GeoTIFF with the tags."""
    _, tags = tiff.read_tags(pa.BufferReader(data) if isinstance(data, bytes) else data)
    if missing := [t for t in REQUIRED if t not in tags]:
        raise ValueError(f"tags are missing: {missing}")
    sx, sy = tags[33550][:2]
    tie = tags[33922]
    west, north = tie[3] - tie[0] * sx, tie[4] + tie[1] * sy
    keys = tags[34735]
    crs = next((keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k] in tiff.CRS_KEYS), None)
    width, height = tags[256][0], tags[257][0]
    nodata = tags[42113][0].rstrip(b"\0 ").decode("ascii", "replace") if 42113 in tags else None
    return {"width": width, "height": height, "bits": tags[258][0], "samples": tags[277][0], "tiled": True, "pixel_x": sx, "pixel_y": sy, "west": west, "south": north - height * sy, "east": west + width * sx, "north": north, "crs_epsg": crs, "nodata": nodata}


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """HEADER of every file under the path; a file that is no GeoTIFF has only path and error. Of a file, its directory is read."""
    files = spark.read.format("binaryFile").load(path).select("path")
    names = [p.split()[0] for p in HEADER.split(", ")]

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name in frame["path"]:
                try:
                    with ranges.open_file(name) as file:
                        rows.append(parse_header(file) | {"path": name, "error": None})
                except ValueError as e:
                    rows.append({"path": name, "error": str(e)})
            yield pd.DataFrame(rows, columns=names, dtype=object).astype({c: "Int32" for c in ("width", "height", "bits", "samples", "crs_epsg")} | {"tiled": "boolean"} | dict.fromkeys(("pixel_x", "pixel_y", "west", "south", "east", "north"), "float64"))

    return files.mapInPandas(each, HEADER)


def tile_violations(headers: DataFrame) -> DataFrame:
    """path, problem of headers that are no one-degree tile of 3600 x 3600 32-bit heights in EPSG:4326."""
    step = lambda c: F.abs(F.col(c) - 1 / 3600) <= 1e-12
    rules: list[tuple[Column, str]] = [(F.col("error").isNull(), "header"), (F.col("crs_epsg") == 4326, "crs"), ((F.col("width") == 3600) & (F.col("height") == 3600), "size"), ((F.col("bits") == 32) & (F.col("samples") == 1), "band"), (F.col("tiled"), "tiling"), (step("pixel_x") & step("pixel_y"), "resolution")]
    bad = F.coalesce(*(F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.lit(name)) for ok, name in rules))
    return headers.select("path", bad.alias("problem")).filter("problem is not null")


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """path, west, south, east, north, resolution, invalid_value, invalid_pixels of XML sidecars; names are matched without their prefix."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", r"(</?)[A-Za-z_][\w.-]*:", "$1").alias("x"))
    plain = F.regexp_replace("x", r"\sxmlns(:\w+)?=(\"[^\"]*\"|'[^']*')|\s\w+:\w+=(\"[^\"]*\"|'[^']*')", "")
    number = lambda name: F.regexp_extract("x", rf"<{name}\b[^>]*>(?:\s|<(?!/{name}\b)[^>]*>)*([-+0-9.eE]+)", 1).try_cast("double")
    attribute = lambda name: F.regexp_extract("x", rf"<nrInvalidPixels\b[^>]*\b{name}=[\"']([^\"']*)", 1).try_cast("double")
    return files.withColumn("x", plain).select("path", number("westBoundLongitude").alias("west"), number("southBoundLatitude").alias("south"), number("eastBoundLongitude").alias("east"), number("northBoundLatitude").alias("north"), number("resolution").alias("resolution"), attribute("valueInvalidPixels").alias("invalid_value"), number("nrInvalidPixels").cast("long").alias("invalid_pixels"))


def identity_violations(spark: SparkSession, path: str, release: str, crs: int, nodata: int) -> DataFrame:
    """path, problem of raster metadata XML that does not name the release, the system's code and the nodata value."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", r"(</?)[A-Za-z_][\w.-]*:", "$1").alias("x"))
    text = F.regexp_replace("x", "<[^>]*>", " ")
    rules = {"release": F.contains(text, F.lit(release)), "crs": F.col("x").rlike(rf"<identCode\b[^>]*\bcode=[\"']{crs}[\"']"), "nodata": F.col("x").rlike(rf"<NoDataValue\b[^>]*>\s*{nodata}\s*</NoDataValue>")}
    bad = F.filter(F.array(*(F.when(ok, F.lit(None).cast("string")).otherwise(F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())
    return files.select("path", F.explode(bad).alias("problem"))
