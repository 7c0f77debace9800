"""All registries of the core package."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from frameloom.plans.registry import Registry

MODULES = ["data_quality", "media", "sequences", "runs", "scores", "scalars", "streams", "tables", "extras", "heads", "files"]


def core() -> Registry:
    registry = Registry()
    for name in MODULES:
        registry.merge(importlib.import_module(f"frameloom.plans.{name}").R)
    return registry


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of the media rows: exact quantiles, totals and means of four columns in one aggregation."""
    return core().queries["a01_numeric_profile"](spark, sf_dir)
