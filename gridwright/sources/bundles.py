"""Grid bundles: JSON documents of nested component grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cost import COMPONENTS

SCHEMA_VERSION = 1
_CELL = "struct<row:int,col:int>"
SCHEMA = f"schema_version int, format string, scenario string, analysis_crs_epsg int, cell_size_m double, endpoints struct<origin:{_CELL},destination:{_CELL}>, unavailable_cells array<{_CELL}>, component_grids struct<{','.join(f'{c}:array<array<double>>' for c in COMPONENTS)}>, provenance map<string,string>"


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """One row a bundle; documents that do not fit the schema fail the read."""
    return spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)


def explode_grids(grids: DataFrame) -> DataFrame:
    """component, row, col, value of grids(component, grid: array of rows)."""
    rows = grids.select("component", F.posexplode("grid").alias("row", "line"))
    return rows.select("component", "row", F.posexplode("line").alias("col", "value"))


def bundle_layers(bundle: DataFrame) -> DataFrame:
    """component, row, col, value of a bundle's component grids."""
    parts = F.array(*(F.struct(F.lit(c).alias("component"), F.col(f"component_grids.{c}").alias("grid")) for c in COMPONENTS))
    return explode_grids(bundle.select(F.explode(parts).alias("x")).select("x.*").filter("grid is not null"))


def bundle_violations(bundle: DataFrame, scenario: str, crs: int, cell_size: float) -> DataFrame:
    """problem: header fields, components, endpoints and unavailable cells that a bundle must not have."""
    rows, cols = F.size(f"component_grids.{COMPONENTS[0]}"), F.size(F.get(f"component_grids.{COMPONENTS[0]}", F.lit(0)))
    inside = lambda c: c["row"].between(0, rows - 1) & c["col"].between(0, cols - 1)
    at = lambda c: F.coalesce(F.exists("unavailable_cells", lambda u: u == c), F.lit(False))
    ends = [F.col("endpoints.origin"), F.col("endpoints.destination")]
    rules = {
        "version": F.col("schema_version") == SCHEMA_VERSION,
        "scenario": F.col("scenario") == scenario,
        "crs": F.col("analysis_crs_epsg") == crs,
        "cell size": F.col("cell_size_m") == cell_size,
        "components": ~F.greatest(*(F.col(f"component_grids.{c}").isNull() for c in COMPONENTS)),
        "ragged": F.forall(F.array(*(F.coalesce(F.forall(f"component_grids.{c}", lambda line: F.size(line) == cols) & (F.size(f"component_grids.{c}") == rows), F.lit(True)) for c in COMPONENTS)), lambda x: x),
        "endpoints": inside(ends[0]) & inside(ends[1]),
        "unavailable cells": F.forall("unavailable_cells", inside),
        "endpoint unavailable": ~(at(ends[0]) | at(ends[1])),
    }
    checks = F.array(*(F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.lit(name)) for name, ok in rules.items()))
    return bundle.select(F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("problem"))
