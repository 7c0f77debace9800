"""Rules on rows of media metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code of each rule and its severity.
SEVERITY = {
    "missing_duration": "warning", "zero_duration": "error", "very_long": "warning", "missing_fps": "warning", "suspicious_fps": "warning", "vfr": "info",
    "missing_frame_count": "info", "invalid_resolution": "error", "low_resolution": "info", "unusual_aspect_ratio": "warning", "missing_codec": "warning",
    "missing_bitrate": "info", "duration_mismatch": "warning", "frame_count_mismatch": "warning", "no_audio": "info",
}


def frame_rate_mode(avg: Column, nominal: Column) -> Column:
    return F.when(avg.isNull() | nominal.isNull(), "unknown").when(F.abs(avg - nominal) > F.greatest(F.lit(0.05), avg * 0.005), "variable").otherwise("constant")


def anomalies() -> Column:
    """Codes of the rules that a row of media metadata breaks, as a list in the rules' order."""
    c = F.col
    w, h, d, fps = c("width"), c("height"), c("duration_sec"), c("fps")
    no_size = F.coalesce(w, F.lit(0)) * F.coalesce(h, F.lit(0)) == 0
    aspect = F.coalesce(c("display_aspect_ratio"), F.try_divide(w.cast("double"), h.cast("double")))
    expected = d * fps
    rules = [
        ("missing_duration", d.isNull()),
        ("zero_duration", d < 0.1),
        ("very_long", d > 4 * 3600),
        ("missing_fps", fps.isNull()),
        ("suspicious_fps", (fps < 5) | (fps > 240)),
        ("vfr", frame_rate_mode(fps, c("nominal_fps")) == "variable"),
        ("missing_frame_count", c("frame_count").isNull()),
        ("invalid_resolution", no_size),
        ("low_resolution", ~no_size & (F.least(w, h) < 360)),
        ("unusual_aspect_ratio", ~no_size & ((aspect < 0.45) | (aspect > 3.0))),
        ("missing_codec", F.coalesce(c("codec"), F.lit("")) == ""),
        ("missing_bitrate", F.coalesce(c("bitrate_bps"), F.lit(0)) == 0),
        ("no_audio", ~c("has_audio")),
        ("duration_mismatch", (c("stream_duration_sec") > 0) & (d > 0) & (F.abs(c("stream_duration_sec") - d) > F.greatest(F.lit(0.5), F.greatest(c("stream_duration_sec"), d) * 0.01))),
        ("frame_count_mismatch", (d > 0) & (fps > 0) & (F.abs(c("frame_count") - expected) > F.greatest(F.lit(2.0), expected * 0.02))),
    ]
    return F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules]))


def anomaly_counts(df: DataFrame) -> DataFrame:
    """``code, severity, files``, with ``probe_failed`` for rows that aren't ok."""
    codes = F.when(F.col("ok"), F.col("anomalies")).otherwise(F.array(F.lit("probe_failed")))
    severity = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    counts = df.select(F.explode(codes).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("files"))
    return counts.select("code", F.coalesce(F.try_element_at(severity, F.col("code")), F.lit("error")).alias("severity"), "files")


def browse(df: DataFrame, text: str = "", anomaly: str = "", equal: dict[str, str] | None = None) -> DataFrame:
    """Rows whose searched fields contain a text, with the anomaly mode failed, clean, any or a code, and equal fields."""
    fields = ["relative_path", "codec", "resolution", "container", "source", "folder"]
    where = F.lit(True)
    if text:
        where &= F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(text.lower()))
    some = F.size("anomalies") > 0
    modes = {"": F.lit(True), "failed": ~F.col("ok"), "clean": F.col("ok") & ~some, "any": ~F.col("ok") | some}
    where &= modes.get(anomaly, F.array_contains("anomalies", F.lit(anomaly)))
    for name, value in (equal or {}).items():
        where &= F.col(name) == value
    return df.filter(where)


def page(df: DataFrame, order: str, descending: bool, number: int, size: int, key: str) -> DataFrame:
    """One page in an order with nulls last in both directions; sizes are held to 10..500 and pages to at least 1."""
    size, number = min(500, max(10, size)), max(1, number)
    c = F.lower(order) if dict(df.dtypes)[order] == "string" else F.col(order)
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col(key)).offset((number - 1) * size).limit(size)


def duplicate_candidates(df: DataFrame, paths: int = 200, groups: int = 500) -> DataFrame:
    """Files that agree in size, duration to a millisecond, resolution and codec: ``n`` and the first paths of each group.

    A group lists at most ``paths`` of its paths and the report at most ``groups`` groups; ``n`` counts all.
    """
    fit = df.filter(F.col("ok") & (F.col("size_bytes") > 0) & F.col("duration_sec").isNotNull())
    keys = ["size_bytes", F.bround("duration_sec", 3).alias("duration"), "width", "height", "codec"]
    sized = fit.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy(F.desc("n"), "size_bytes", "duration", "width", "height", "codec").limit(groups)
    # Only the reported groups gather paths, and of those at most the first ones by rank.
    ranked = fit.withColumn("duration", F.bround("duration_sec", 3)).join(F.broadcast(sized), ["size_bytes", "duration", "width", "height", "codec"])
    first = ranked.groupBy("size_bytes", "duration", "width", "height", "codec", "n", F.pmod(F.xxhash64("relative_path"), F.lit(32)).alias("part")).agg(F.slice(F.sort_array(F.collect_list("relative_path")), 1, paths).alias("some"))
    return first.groupBy("size_bytes", "duration", "width", "height", "codec", "n").agg(F.slice(F.sort_array(F.flatten(F.collect_list("some"))), 1, paths).alias("paths"))
