"""Scalar column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def clamp_unit(value: Column, lower: float, upper: float) -> Column:
    """(value - lower) / (upper - lower) held within 0 and 1. A value that is not finite fails the query."""
    if not (-float("inf") < lower < upper < float("inf")):
        raise ValueError("bounds must be finite and ascending")
    held = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - lower) / (upper - lower)))
    return F.when(is_finite(value), held).otherwise(F.raise_error(F.lit("value is not finite")).cast("double"))


def fold_keys(attributes: Column) -> Column:
    """A map with lower-cased keys; of keys that differ in case only, the last stays."""
    return F.map_from_entries(F.array_distinct(F.transform(F.map_keys(attributes), lambda k: F.struct(F.lower(k).alias("key"), F.element_at(F.map_values(attributes), F.array_position(F.map_keys(attributes), k).cast("int")).alias("value")))))


def integer_id(text: Column) -> Column:
    """A whole number from text, null otherwise."""
    return F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(text).try_cast("bigint"))


def display_name(*names: Column) -> Column:
    """The first name that is not blank, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(n), F.lit("")) for n in names))


def is_major_road(hierarchy: Column, at_most: int = 4) -> Column:
    return F.coalesce(hierarchy.try_cast("int") <= at_most, F.lit(False))


def near(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """Numbers within the tolerance; two nulls are near."""
    return F.coalesce(F.abs(a - b) <= tolerance, a.isNull() & b.isNull())


def arrays_near(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """Equal lengths, and near numbers at every place."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: near(x, y, tolerance)), lambda ok: ok)


def csv_field(text: Column) -> Column:
    """Quoted with doubled quotes where the text holds a quote, comma or line break."""
    return F.when(text.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def shown_number(value: Column, digits: int = 1) -> Column:
    """A number with thousands separators, a dash for null."""
    return F.coalesce(F.format_number(value, digits), F.lit("—"))
