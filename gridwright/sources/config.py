"""Model settings: one JSON object on the driver, and small tables from it."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators.cost import COMPONENTS


class ConfigError(ValueError):
    """The settings are no JSON object, or presets do not fit the components."""


def load(path: str | Path) -> dict:
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8"))
    except json.JSONDecodeError as e:
        raise ConfigError(f"{path}: {e}") from e
    if not isinstance(found, dict):
        raise ConfigError(f"{path}: not a JSON object")
    return found


def weight_table(spark: SparkSession, presets: dict[str, dict[str, float]]) -> DataFrame:
    """preset, component, weight; every preset must weigh just the known components."""
    for name, weights in presets.items():
        if set(weights) != set(COMPONENTS):
            raise ConfigError(f"preset {name}: {sorted(set(weights) ^ set(COMPONENTS))}")
    return spark.createDataFrame([(p, c, float(w)) for p, ws in presets.items() for c, w in ws.items()], "preset string, component string, weight double")
