"""Scalar functions on names, paths and task texts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def relative_to(path: Column, root: str) -> Column:
    """Path below a root in POSIX form; a path outside it stays."""
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    start = root.rstrip("/") + "/"
    return F.when(clean.startswith(start), F.substring(clean, len(start) + 1, 1 << 30)).otherwise(clean)


def without_suffix(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]+$", "")


def stem(path: Column) -> Column:
    return without_suffix(F.element_at(F.split(path, "/"), -1))


def clip_key(i: Column) -> Column:
    return F.format_string("clip_%03d", i)


def truncate(c: Column, size: int = 2000, mark: str = "...[truncated]") -> Column:
    return F.when(F.length(c) > size, F.concat(F.left(c, F.lit(size)), F.lit(mark))).otherwise(c)


def part_number(name: Column) -> Column:
    """Number of ``<stem>_part_<n>`` or ``<stem>_part<n>``, null for other names."""
    return F.regexp_extract(name, r"_part_?(\d{1,9})$", 1).try_cast("int")


def hand_side(c: Column) -> Column:
    """left, right or none from free text: left/l/0, right/r/1, else by what it contains."""
    t = F.lower(F.trim(c))
    return F.when(t.isin("left", "l", "0"), "left").when(t.isin("right", "r", "1"), "right").when(t.contains("left"), "left").when(t.contains("right"), "right").otherwise("none")


def task_text(c: Column) -> Column:
    """Lower case, what stands after the last colon marker, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(c, r"^[A-Za-z]+-\d+:\s*", "")), r"[\s_]+", " "))


def words_only(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9_.-]+", "-"), r"^-+|-+$", "")


def side_suffix(c: Column) -> Column:
    """left or right after the last ``#``, else null."""
    last = F.element_at(F.split(c, "#"), -1)
    return F.when(c.contains("#") & last.isin("left", "right"), last)


def sampling_group(name: Column) -> Column:
    """Name without its trailing number."""
    return F.regexp_replace(name, r"[-_]?\d+$", "")


def split_list(c: Column, sep: str = ",") -> Column:
    """Trimmed, lower-cased, non-empty members of a separated list, each once and in order."""
    return F.array_distinct(F.filter(F.transform(F.split(c, sep), lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def container_label(names: Column) -> Column:
    """Preferred of a comma list of container names: mp4, then mov, then matroska, then the first."""
    parts = F.split(names, ",")
    label = F.element_at(parts, 1)
    for name in ("matroska", "mov", "mp4"):
        label = F.when(F.array_contains(parts, name), F.lit(name)).otherwise(label)
    return label


def data_path(chunk: Column, file: Column, kind: str = "data", ext: str = "parquet") -> Column:
    return F.format_string(f"{kind}/chunk-%03d/file-%03d.{ext}", chunk, file)
