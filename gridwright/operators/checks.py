"""Checks: every one returns the rows that break a rule, so no rows means all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class CheckFailed(ValueError):
    """A check found rows."""


def require_none(violations: DataFrame, what: str, shown: int = 5) -> None:
    """Raise with the first rows if there are any."""
    rows = violations.limit(shown).collect()
    if rows:
        raise CheckFailed(f"{what}: {[r.asDict() for r in rows]}")


def missing_and_unexpected(expected: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """key, problem of keys on one side only; a null key is on no other side.

    One grouping of both sides: neither is made unique, sorted or joined by itself."""
    sides = expected.select(key, F.lit(1).alias("side")).unionByName(seen.select(key, F.lit(2).alias("side")))
    found = sides.groupBy(key).agg(F.bit_or("side").alias("sides")).filter(F.col(key).isNull() | (F.col("sides") != 3))
    problems = F.when(F.col("sides") == 1, F.array(F.lit("missing"))).when(F.col("sides") == 2, F.array(F.lit("unexpected"))).otherwise(F.array(F.lit("missing"), F.lit("unexpected")))
    return found.select(key, F.explode(problems).alias("problem"))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def id_set_equality(expected: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """key, problem: ids must be equal as sets, and seen ones unique."""
    again = duplicates(seen, key).select(key, F.lit("duplicate").alias("problem"))
    return missing_and_unexpected(expected, seen, key).unionByName(again)


def expected_layers(expected: DataFrame, available: DataFrame) -> DataFrame:
    """id, problem for layers(id, name, kind) that are absent, or have another name or kind; a null kind asks for none."""
    found = available.select("id", F.col("name").alias("found"), F.col("kind").alias("found_kind"), F.lit(True).alias("there"))
    x = expected.join(found, "id", "left")
    bad = F.when(F.col("there").isNull(), "missing").when(F.col("found") != F.col("name"), "name").when(F.col("kind").isNotNull() & ~F.col("kind").eqNullSafe(F.col("found_kind")), "kind")
    return x.select("id", bad.alias("problem")).filter("problem is not null")


def endpoint_violations(configured: DataFrame, features: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """id, problem of configured(id, name, state, lat, lon) against features of the same columns."""
    f = features.select("id", *(F.col(c).alias(f"f_{c}") for c in ("name", "state", "lat", "lon")))
    far = (F.abs(F.col("lat") - F.col("f_lat")) > tolerance) | (F.abs(F.col("lon") - F.col("f_lon")) > tolerance)
    bad = F.when(F.col("f_name").isNull(), "missing").when((F.col("name") != F.col("f_name")) | (F.col("state") != F.col("f_state")), "identity").when(far, "place")
    rows = configured.join(f, "id", "left").select("id", bad.alias("problem")).filter("problem is not null")
    return rows.unionByName(duplicates(features, "id").select("id", F.lit("duplicate").alias("problem")))


def geometry_members(kind: Column, paths: Column, rings: Column, x: Column, y: Column) -> Column:
    """Does a geometry hold what its kind requires?"""
    return F.when(kind == "polyline", paths.isNotNull()).when(kind == "polygon", rings.isNotNull()).when(kind == "point", x.isNotNull() & y.isNotNull()).otherwise(F.lit(False))


def box_contains(outer: tuple[Column, ...], inner: tuple[Column, ...]) -> Column:
    """Does (west, south, east, north) hold another box?"""
    return (outer[0] <= inner[0]) & (outer[1] <= inner[1]) & (outer[2] >= inner[2]) & (outer[3] >= inner[3])


def choose_first_valid(candidates: DataFrame, group: str) -> DataFrame:
    """The valid candidate of each group with the lowest priority number, and how many were tried until it."""
    valid = candidates.filter("valid").groupBy(group).agg(F.min_by("source", "priority").alias("source"), F.min("priority").alias("chosen"))
    tried = F.count_if(F.col("chosen").isNull() | (F.col("priority") <= F.col("chosen")))
    return candidates.select(group, "priority").join(valid, group, "left").groupBy(group, "source").agg(tried.alias("attempts"))


def outside_domain(values: DataFrame, domain: DataFrame, nodata: int = 65535) -> DataFrame:
    """Distinct values that neither the domain nor nodata explains."""
    return values.filter(F.col("value") != nodata).select("value").distinct().join(domain.select("value"), "value", "left_anti")


def manifest_violations(manifest: DataFrame, artifacts: DataFrame) -> DataFrame:
    """layer, problem of manifest(layer, declared, unique_ids) against artifacts(layer, features, ids)."""
    x = manifest.join(artifacts, "layer", "full_outer")
    bad = F.when(F.col("features").isNull(), "no artifact").when(F.col("declared").isNull(), "no manifest").when(F.col("declared") != F.col("features"), "count").when(F.col("unique_ids") != F.col("ids"), "ids")
    return x.select("layer", bad.alias("problem")).filter("problem is not null")


def over_limits(sums: DataFrame, limits: dict[str, int]) -> DataFrame:
    """name, value, most for one-row sums that exceed their limit."""
    for name, most in limits.items():
        if isinstance(most, bool) or not isinstance(most, int) or most <= 0:
            raise ValueError(f"limit {name} must be a positive whole number")
    rows = F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("long").alias("value"), F.lit(m).cast("long").alias("most")) for n, m in limits.items()))
    return sums.select(F.explode(rows).alias("x")).select("x.*").filter("value > most")


def running_total(rows: DataFrame, order: str, value: str, group: str, cap: int) -> DataFrame:
    """rows with the running sum of value within the group, and whether it is past the cap."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(value).over(w)).withColumn("over_cap", F.col("running") > cap)
