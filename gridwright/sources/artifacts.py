"""Acquired artifacts: sidecars, reports, service metadata, endpoint manifests, stale storage.

Checks give the rows that break a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checks import box_contains

_BOX = "struct<west:double,south:double,east:double,north:double>"
TERRAIN = f"source_id string, artifact_type string, artifact_path string, crs_epsg int, bounds_crs_epsg int, resolution_m double, bounds {_BOX}, nodata_defined boolean, coverage_status string, acquired_at_utc string"
REPORT = f"representation string, coverage_status string, coverage_scope string, geometry_type string, crs_epsg int, raster_width int, raster_height int, resolution_m double, nodata_value int, value_table_fields array<string>, fields array<string>, feature_count int, unique_id_count int, duplicate_id_count int, rest_count_reconciled string, bounds {_BOX}"
#: Geographic systems whose degrees count as the same for bounds (fixed values).
DEGREES = [4326, 7844]
SAFE_PREFIX = ".staging-"


def read_terrain(spark: SparkSession, path: str) -> DataFrame:
    """TERRAIN of each sidecar, artifact paths resolved against the sidecar's folder, and whether the artifact is there."""
    rows = spark.read.schema(TERRAIN).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("sidecar", F.input_file_name())
    folder = F.regexp_replace("sidecar", "[^/]*$", "")
    full = F.when(F.col("artifact_path").rlike("^([a-z]+:/)?/"), F.col("artifact_path")).otherwise(F.concat(folder, "artifact_path"))
    rows = rows.withColumn("artifact", full)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").option("recursiveFileLookup", True).load(path.rsplit("/", 1)[0] if path.endswith(".json") else path).select(F.regexp_replace("path", "^file:/+", "/").alias("found"))
    return rows.join(files, F.regexp_replace("artifact", "^file:/+", "/") == F.col("found"), "left").withColumn("exists", F.col("found").isNotNull()).drop("found")


def zoned_time(text: Column) -> Column:
    """A timestamp from ISO text with a zone; null without one."""
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(text))


def _broken(rules: dict[str, Column]) -> Column:
    return F.filter(F.array(*(F.when(F.coalesce(ok, F.lit(False)), F.lit(None).cast("string")).otherwise(F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())


def terrain_violations(artifacts: DataFrame, sources: list[str], envelope: tuple[float, float, float, float]) -> DataFrame:
    """source_id, problem of terrain sidecars that a route must not rest on."""
    b = "bounds."
    box = tuple(F.col(b + c) for c in ("west", "south", "east", "north"))
    rules = {
        "source": F.col("source_id").isin(*sources), "type": F.col("artifact_type") == "raster", "file": F.col("exists"), "crs": F.col("crs_epsg").isNotNull(), "bounds crs": F.col("bounds_crs_epsg").isin(*DEGREES),
        "resolution": F.col("resolution_m") > 0, "nodata": F.col("nodata_defined"), "coverage": F.col("coverage_status") == "complete", "time": zoned_time(F.col("acquired_at_utc")).isNotNull(), "bounds": box_contains(box, tuple(map(F.lit, envelope))),
    }
    return artifacts.select("source_id", F.explode(_broken(rules)).alias("problem"))


def select_terrain(artifacts: DataFrame, priority: list[str], sources: list[str], envelope: tuple[float, float, float, float]) -> DataFrame:
    """The first source of the priority list without a violation, at most one row."""
    bad = terrain_violations(artifacts, sources, envelope).select("source_id").distinct()
    place = F.array_position(F.array(*map(F.lit, priority)), F.col("source_id"))
    return artifacts.join(bad, "source_id", "left_anti").filter(place > 0).orderBy(place).limit(1)


def report_violations(reports: DataFrame, required: list[str], crs: int) -> DataFrame:
    """representation, problem of content reports; rasters and vectors have rules of their own. Bounds are judged in the report's system."""
    vector = F.col("representation") == "vector"
    names = lambda c: F.transform(F.col(c), F.lower)
    missing = lambda c: F.size(F.array_except(F.array(*(F.lit(x.lower()) for x in required)), F.coalesce(names(c), F.array().cast("array<string>")))) == 0
    rules = {
        "representation": F.col("representation").isin("vector", "raster"), "coverage": F.col("coverage_status") == "complete", "crs": F.col("crs_epsg") == crs,
        "fields": F.when(vector, missing("fields")).otherwise(missing("value_table_fields")),
        "ids": ~vector | ((F.col("feature_count") > 0) & (F.col("unique_id_count") == F.col("feature_count")) & (F.col("duplicate_id_count") == 0)),
        "count": ~vector | (F.col("rest_count_reconciled") == "true"),
        "size": vector | ((F.col("raster_width") > 0) & (F.col("raster_height") > 0) & (F.col("resolution_m") > 0)),
        "nodata": vector | F.col("nodata_value").isNotNull(),
        "bounds": (F.col("bounds.west") < F.col("bounds.east")) & (F.col("bounds.south") < F.col("bounds.north")),
    }
    return reports.select("representation", F.explode(_broken(rules)).alias("problem"))


def metadata_summary(services: DataFrame) -> DataFrame:
    """url, crs, layers of service metadata: the newest system id, the list of layers or the single one."""
    wkid = F.coalesce("spatialReference.latestWkid", "spatialReference.wkid", "extent.spatialReference.latestWkid", "extent.spatialReference.wkid")
    single = F.array(F.struct(F.col("id"), F.col("name"), F.col("geometryType").alias("kind")))
    many = F.transform("layers", lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"), x["geometryType"].alias("kind")))
    return services.select("url", wkid.alias("crs"), F.coalesce(many, single).alias("layers"))


def probe_status(sources: DataFrame) -> DataFrame:
    """source_id, status: deferred and context-only sources are not asked, others are validated or failed."""
    status = F.when(F.col("role") == "context", "context-only").when(F.col("deferred"), "deferred").when(F.col("error").isNotNull() | (F.col("crs") != F.col("expected_crs")), "failed").otherwise("validated")
    return sources.select("source_id", status.alias("status"))


def endpoint_manifest(configured: DataFrame, features: DataFrame) -> DataFrame:
    """role, id, name, lat, lon of the configured endpoints as the service has them, and when that was asked."""
    f = features.select("id", F.col("name").alias("found_name"), F.col("lat").alias("found_lat"), F.col("lon").alias("found_lon"))
    return configured.join(f, "id").select("role", "id", F.col("found_name").alias("name"), F.col("found_lat").alias("lat"), F.col("found_lon").alias("lon"), F.current_timestamp().alias("asked_at"))


def stale_files(spark: SparkSession, folder: str, older_than_hours: float, prefix: str = SAFE_PREFIX) -> DataFrame:
    """path, modificationTime, length of staging files past an age, in order: what a cleanup may delete."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "modificationTime", "length")
    age = (F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("modificationTime")) / 3600
    return files.filter(F.col("path").contains("/" + prefix) & (age >= older_than_hours)).orderBy("path")


def delete_stale(spark: SparkSession, stale: DataFrame, dry_run: bool = True) -> list[str]:
    """Delete the listed files with the store's own client; a dry run only lists them."""
    paths = [r.path for r in stale.select("path").toLocalIterator()]
    if not dry_run:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for p in paths:
            target = jvm.org.apache.hadoop.fs.Path(p)
            target.getFileSystem(conf).delete(target, False)
    return paths
