"""Sources: file inventories, list files, JSON lines, text pose tables, binary cameras, dataset layouts."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File name endings of videos.
VIDEO_EXTENSIONS = [".mp4", ".mov", ".m4v", ".avi", ".mkv", ".webm", ".flv", ".wmv", ".mpg", ".mpeg", ".ts", ".mts", ".m2ts", ".3gp", ".ogv"]


def inventory(spark: SparkSession, root: str, glob: str = "*.mp4") -> DataFrame:
    """``path, length, modificationTime`` of all files below a root; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", "length", "modificationTime")


def list_file(spark: SparkSession, path: str) -> DataFrame:
    """``path`` of each line of a list file that is neither blank nor a comment, once, in order."""
    lines = spark.read.text(path).select(F.trim("value").alias("path"))
    return lines.filter((F.col("path") != "") & ~F.col("path").startswith("#")).distinct().orderBy("path")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def preferred_videos(files: DataFrame, root: str, path: str) -> DataFrame:
    """Of each root its .mp4 files; only a root without any gives its other videos."""
    ext = extension(F.col(path))
    videos = files.filter(ext.isin(VIDEO_EXTENSIONS))
    has = videos.groupBy(root).agg(F.bool_or(ext == ".mp4").alias("_mp4"))
    return videos.join(has, root).filter(~F.col("_mp4") | (ext == ".mp4")).drop("_mp4")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; broken lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def pose_table(spark: SparkSession, path: str) -> DataFrame:
    """Text pose table: time, translation, quaternion x y z w, separated by spaces, # comments."""
    return spark.read.schema("ts DOUBLE, tx DOUBLE, ty DOUBLE, tz DOUBLE, qx DOUBLE, qy DOUBLE, qz DOUBLE, qw DOUBLE").option("sep", " ").option("comment", "#").csv(path)


def camera_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, intrinsics[9], extrinsics[12]`` of binary camera files: a float tag, then 9 and 12 doubles, little-endian."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *_camera(c)) for p, c in zip(b["path"], b["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "intrinsics", "extrinsics", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.cam").load(root)
    return files.select("path", "content").mapInPandas(parse, "path STRING, intrinsics ARRAY<DOUBLE>, extrinsics ARRAY<DOUBLE>, error STRING")


#: Fixed value: the tag that begins a binary camera file.
CAMERA_TAG = 202021.25


def _camera(content: bytes) -> tuple[list[float] | None, list[float] | None, str | None]:
    if len(content) != 4 + 21 * 8:
        return None, None, f"{len(content)} bytes"
    if struct.unpack("<f", content[:4])[0] != CAMERA_TAG:
        return None, None, "wrong tag"
    values = np.frombuffer(content, "<f8", 21, 4).tolist()
    return values[:9], values[9:], None


def frame_layout(df: DataFrame) -> DataFrame:
    """One canonical projection of two physical layouts of frame tables, chosen by their columns: field of view from
    ``cam_fov`` or ``fov``, validity from ``hand_kept`` or ``state_mask``."""
    have = set(df.columns)
    need = {"episode_index", "frame_index"}
    if need - have:
        raise ValueError(f"missing columns: {sorted(need - have)}")
    fov = next((c for c in ("cam_fov", "fov") if c in have), None)
    valid = next((c for c in ("hand_kept", "state_mask") if c in have), None)
    none = lambda t: F.lit(None).cast(t)
    return df.select("episode_index", "frame_index", (F.col(fov) if fov else none("array<double>")).alias("fov"), (F.col(valid) if valid else none("array<boolean>")).alias("valid"))


def task_dictionary(df: DataFrame) -> DataFrame:
    """``task_index, task`` of either writer's dictionary."""
    names = [c for c in ("task", "__index_level_0__") if c in df.columns]
    return df.select("task_index", F.coalesce(*[F.col(f"`{c}`") for c in names]).alias("task"))


def nearest_root(paths: DataFrame, path: str, roots: list[str]) -> DataFrame:
    """Adds ``root``: the longest of a few dataset roots that encloses the path, else null."""
    hits = F.array_compact(F.array(*[F.when(F.col(path).startswith(r.rstrip("/") + "/"), F.struct(F.lit(len(r)).alias("n"), F.lit(r).alias("r"))) for r in roots]))
    return paths.withColumn("root", F.array_max(hits)["r"])


def candidate_paths(folders: list[str], names: list[str]) -> list[tuple[int, str]]:
    """Ordered distinct candidates, folder by folder."""
    return list(enumerate(dict.fromkeys(f"{f}/{n}" for f in folders for n in names)))
