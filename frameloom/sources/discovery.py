"""Finding and reading what lies in folders: dataset roots, labels, probes, caches, frame references, adapters."""

from __future__ import annotations

import json
import shutil
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def cached_scan(spark: SparkSession, root: str, cache: str, scan: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """The inventory of a root from its cache table, and whether it came from there; a cache of another root is not used
    and is left as it is. The cache holds the root it was made for in every row."""
    if exists(spark, f"{cache}/_SUCCESS"):
        held = spark.read.parquet(cache).filter(F.col("input_root") == root)
        if not held.isEmpty():
            return held.drop("input_root"), True
        return scan(), False
    scan().withColumn("input_root", F.lit(root)).write.parquet(cache)
    return spark.read.parquet(cache).drop("input_root"), False


def cached_component(spark: SparkSession, cache: str, dataset: str, part: str, signature: str, build: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """A component of a dataset under its signature: read back where a finished table with the same signature lies, else
    built and written. Another signature is another folder, so nothing stale is ever read."""
    place = f"{cache}/{dataset}/{part}/{signature}"
    if exists(spark, f"{place}/_SUCCESS"):
        return spark.read.parquet(place), True
    build().write.mode("overwrite").option("compression", "zstd").parquet(place)  # an unfinished write is replaced
    return spark.read.parquet(place), False


def probe(files: DataFrame, path: str, prober: Callable[[str], dict], schema: str, columns: list[str]) -> DataFrame:
    """One row for each file: ``path, ok, error`` and the columns that the prober finds; a prober that raises gives a row
    that isn't ok instead of a failed job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p in b[path]:
                try:
                    rows.append({"path": p, "ok": True, "error": None, **prober(p)})
                except Exception as e:
                    rows.append({"path": p, "ok": False, "error": f"{type(e).__name__}: {e}"[:500]})
            yield pd.DataFrame(rows, columns=["path", "ok", "error", *columns])

    return files.select(path).mapInPandas(run, f"path STRING, ok BOOLEAN, error STRING, {schema}")


def ffprobe(path: str, timeout: float = 30.0) -> dict:
    """Streams and format of a media file by the external program; raises where it is missing, fails or takes too long."""
    program = shutil.which("ffprobe")
    if program is None:
        raise FileNotFoundError("ffprobe is not installed")
    got = subprocess.run([program, "-v", "error", "-print_format", "json", "-show_format", "-show_streams", path], capture_output=True, timeout=timeout, check=True)
    found = json.loads(got.stdout)
    return {"duration_sec": float(found.get("format", {}).get("duration", "nan")), "streams": len(found.get("streams", []))}


def dataset_roots(files: DataFrame, path: str) -> DataFrame:
    """``root`` of every folder that holds ``meta/info.json`` and something below ``data/``; roots inside roots are left
    out. From a listing of files, which may be a table or an inventory."""
    meta = files.select(F.regexp_extract(path, r"^(.*)/meta/info\.json$", 1).alias("root")).filter("root <> ''").distinct()
    data = files.select(F.regexp_extract(path, r"^(.*?)/data/[^/]", 1).alias("root")).filter("root <> ''").distinct()
    nested = files.select(F.explode(_prefixes(path, "/data/")).alias("root")).distinct()
    roots = meta.join(data.unionByName(nested).distinct(), "root")
    above = roots.select(F.col("root").alias("inner"), F.explode(_parents("root")).alias("root")).join(roots, "root").select(F.col("inner").alias("root"))
    return roots.join(above.distinct(), "root", "left_anti")


def _prefixes(path: str, mark: str) -> Column:
    """Everything before each occurrence of a mark."""
    parts = F.split(path, mark)
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), mark)) if mark else parts


def _parents(path: str) -> Column:
    parts = F.split(path, "/")
    return F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/")), lambda p: (p != F.col(path)) & (p != ""))


def json_or_lines(df: DataFrame, text: str, entry: str) -> DataFrame:
    """Adds ``entry``, a row for each object of a text that is a JSON array, one JSON object, or JSON lines; lines and
    texts that don't parse give none."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    one = F.from_json(F.col("_line"), f"{entry}, _bad STRING", options)
    many = F.from_json(F.trim(text), f"ARRAY<STRUCT<{entry}>>")
    lines = F.when(F.trim(text).startswith("["), F.array().cast("array<string>")).otherwise(F.filter(F.split(text, "\r\n|\r|\n"), lambda s: F.trim(s) != ""))
    whole = df.filter(F.trim(text).startswith("[")).withColumn("entry", F.explode(many))
    names = [c.strip().split(" ")[0] for c in entry.split(",")]
    each = df.filter(~F.trim(text).startswith("[")).withColumn("_line", F.explode(lines)).withColumn("_e", one).filter("_e IS NOT NULL AND _e._bad IS NULL AND trim(_line) LIKE '{%}'")
    return whole.unionByName(each.withColumn("entry", F.struct(*[F.col(f"_e.{n}").alias(n) for n in names])).drop("_line", "_e"))


def load_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A manifest table with all columns of ``schema``; columns that an older writer left out are null, a missing
    table is empty."""
    empty = spark.createDataFrame([], schema)
    try:
        held = spark.read.parquet(path)
    except AnalysisException:
        return empty
    return empty.unionByName(held.select(*[c for c in held.columns if c in empty.columns]), allowMissingColumns=True)


#: Resource samples: time, processor share, memory, and the busy share of each device.
RESOURCES = "t DOUBLE, cpu DOUBLE, mem STRUCT<used_mib: DOUBLE, total_mib: DOUBLE, percent: DOUBLE>, workers MAP<STRING, BIGINT>, gpus ARRAY<STRUCT<id: INT, util: DOUBLE>>"


def row_numbered_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames of a layout without a frame column: a row's place in its Parquet file is the frame."""
    df = spark.read.parquet(path)
    return df.select("*", F.col("_metadata.row_index").alias("frame_index"), F.col("_metadata.file_name").alias("file_name"))


def bundles(files: DataFrame, path: str, key: Column) -> DataFrame:
    """``key, path`` of the result to load for each key: the cleaned or rewritten one where there is one, else the raw one."""
    revision = F.coalesce(F.regexp_extract(path, r"-r(\d+)\.", 1).try_cast("int"), F.lit(0))
    return files.groupBy(key.alias("key")).agg(F.max_by(path, F.struct(revision.alias("r"), F.col(path).alias("p"))).alias("path"))


def frame_references(files: DataFrame, path: str, first: str, last: str, fps: float = 30.0) -> DataFrame:
    """``path, frame, seconds`` of every frame of every video; nothing is decoded, a reader opens a file when it is asked."""
    return files.filter(F.col(last) >= F.col(first)).select(path, F.explode(F.sequence(first, last)).alias("frame")).withColumn("seconds", F.round(F.col("frame") / fps, 6))


def canonical_options(options: dict, allowed: dict[str, type]) -> dict:
    """Selection options in canonical form: names in order, texts trimmed, lists sorted and distinct, numbers of the
    allowed type; unknown names, wrong types and empty ranges raise."""
    unknown = sorted(set(options) - set(allowed))
    if unknown:
        raise ValueError(f"unknown options: {unknown}")
    out = {}
    for name in sorted(options):
        value, kind = options[name], allowed[name]
        if value is None:
            continue
        if kind is list:
            value = sorted({str(v).strip() for v in ([value] if isinstance(value, str) else value)} - {""})
        elif kind is str:
            value = str(value).strip()
        elif isinstance(value, bool) or kind(value) != value:
            raise ValueError(f"{name} must be of type {kind.__name__}")
        else:
            value = kind(value)
        out[name] = value
    if out.get("start", 0) < 0 or ("end" in out and out["end"] <= out.get("start", 0)):
        raise ValueError("the range is empty")
    return out


def micro_batches(df: DataFrame, size: str, budget: int) -> DataFrame:
    """``batch, items, bytes``: rows as they come, in batches of at most ``budget`` bytes inside each task; a row larger
    than the budget is a batch of its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, held, number = 0, 0, 0
        for b in batches:
            for v in b[size].fillna(0).astype("int64").tolist():
                if n and held + v > budget:
                    yield pd.DataFrame([(number, n, held)], columns=["batch", "items", "bytes"])
                    n, held, number = 0, 0, number + 1
                n, held = n + 1, held + v
        if n:
            yield pd.DataFrame([(number, n, held)], columns=["batch", "items", "bytes"])

    return df.select(size).mapInPandas(run, "batch BIGINT, items BIGINT, bytes BIGINT")


def safe_root(source: Column, target: Column) -> Column:
    """Whether an output folder is neither the input folder nor inside it nor around it."""
    clean = lambda c: F.concat(F.regexp_replace(c, "/+$", ""), F.lit("/"))
    return ~clean(target).startswith(clean(source)) & ~clean(source).startswith(clean(target))


def environment(spark: SparkSession, modules: list[str]) -> DataFrame:
    """``name, ok, detail`` of what a run needs: Python modules, the session, a shared folder for checkpoints."""
    import importlib.util

    rows = [(f"module {m}", importlib.util.find_spec(m) is not None, None) for m in modules]
    rows.append(("session", spark.range(3).count() == 3, spark.version))
    local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
    rows.append(("checkpoint folder", local or spark.conf.get("spark.checkpoint.dir", None) is not None, None))
    return spark.createDataFrame(rows, "name STRING, ok BOOLEAN, detail STRING")
