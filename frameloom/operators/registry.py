"""Plug-in points: metric heads, preprocessing steps and their registries."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]


class Plugins:
    """Named functions. ``strict`` refuses a second registration of a name, else the first one stays."""

    def __init__(self, strict: bool = False) -> None:
        self.strict = strict
        self.items: dict[str, Callable] = {}

    def register(self, name: str) -> Callable[[Callable], Callable]:
        def wrap(fn: Callable) -> Callable:
            if name in self.items and self.strict:
                raise KeyError(f"{name} is registered already")
            self.items.setdefault(name, fn)
            return fn

        return wrap

    def build(self, config: Mapping) -> Callable:
        """The function of ``config["type"]`` with its other entries as keyword arguments."""
        name = config["type"]
        if name not in self.items:
            raise KeyError(f"{name} is none of {sorted(self.items)}")
        options = {k: v for k, v in config.items() if k != "type"}
        return lambda df: self.items[name](df, **options)


def parse_stages(text: str) -> list[list[str]]:
    """``a+b,c``: stages follow each other at commas, steps joined by plus are fused into one stage."""
    return [[s.strip() for s in stage.split("+") if s.strip()] for stage in text.split(",") if stage.strip()]


def run_stages(df: DataFrame, text: str, plugins: Plugins, options: Mapping[str, Mapping] | None = None) -> DataFrame:
    """Runs the stages as one chain of transformations; Catalyst fuses their projections."""
    for stage in parse_stages(text):
        for name in stage:
            df = df.transform(plugins.build({"type": name, **(options or {}).get(name, {})}))
    return df


def evaluate_heads(df: DataFrame, heads: Mapping[str, tuple[Iterable[str], Step | None]], provided: Iterable[str]) -> DataFrame:
    """``head, status, metric, value``: each head whose required capabilities are provided is evaluated; one without a
    function is not_implemented, the others are skipped."""
    have, out = set(provided), None
    spark = df.sparkSession
    for name, (required, fn) in sorted(heads.items()):
        status = "skipped" if set(required) - have else "not_implemented" if fn is None else "evaluated"
        if status == "evaluated":
            rows = fn(df).select(F.lit(name).alias("head"), F.lit(status).alias("status"), "metric", F.col("value").cast("double"))
        else:
            rows = spark.createDataFrame([(name, status, None, None)], "head STRING, status STRING, metric STRING, value DOUBLE")
        out = rows if out is None else out.unionByName(rows)
    return out


def selection(options: Mapping, allowed: Mapping[str, type]) -> dict:
    """Known options with their types, in canonical order; unknown names and wrong types are errors."""
    unknown = set(options) - set(allowed)
    if unknown:
        raise ValueError(f"unknown options: {sorted(unknown)}")
    out = {}
    for name in sorted(options):
        value = options[name]
        if value is None:
            continue
        if not isinstance(value, allowed[name]) or isinstance(value, bool) != (allowed[name] is bool):
            raise ValueError(f"{name} must be {allowed[name].__name__}")
        out[name] = value
    return out
