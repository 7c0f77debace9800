"""Queries on media metadata: rules, profiles, distributions, browsing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.functions import numbers, text
from frameloom.operators import media, profile
from frameloom.plans import base
from frameloom.plans.registry import Registry
from frameloom.session import table

R = Registry()
M = base.sql("MEDIA")

#: Edges of the distributions.
DURATION_EDGES = [10, 30, 60, 120, 300, 600]
SIZE_EDGES = [10, 50, 100, 500, 1024, 5120]
BITRATE_EDGES = [0.5, 1, 2, 5, 10, 25, 50]
FOV_EDGES = [30, 45, 60, 75, 90, 105, 120, 150]


def _media(spark, d: str) -> DataFrame:
    return base.load(spark, d, "MEDIA").withColumn("anomalies", media.anomalies())


RULES = """
SELECT *, list_filter([
  CASE WHEN duration_sec IS NULL THEN 'missing_duration' END, CASE WHEN duration_sec < 0.1 THEN 'zero_duration' END, CASE WHEN duration_sec > 14400 THEN 'very_long' END,
  CASE WHEN fps IS NULL THEN 'missing_fps' END, CASE WHEN fps < 5 OR fps > 240 THEN 'suspicious_fps' END,
  CASE WHEN abs(fps - nominal_fps) > greatest(0.05, fps * 0.005) THEN 'vfr' END, CASE WHEN frame_count IS NULL THEN 'missing_frame_count' END,
  CASE WHEN width * height = 0 THEN 'invalid_resolution' END, CASE WHEN width * height > 0 AND least(width, height) < 360 THEN 'low_resolution' END,
  CASE WHEN width * height > 0 AND (width / height < 0.45 OR width / height > 3) THEN 'unusual_aspect_ratio' END,
  CASE WHEN codec = '' THEN 'missing_codec' END, CASE WHEN coalesce(bitrate_bps, 0) = 0 THEN 'missing_bitrate' END, CASE WHEN NOT has_audio THEN 'no_audio' END,
  CASE WHEN stream_duration_sec > 0 AND duration_sec > 0 AND abs(stream_duration_sec - duration_sec) > greatest(0.5, 0.01 * greatest(stream_duration_sec, duration_sec)) THEN 'duration_mismatch' END,
  CASE WHEN duration_sec > 0 AND fps > 0 AND abs(frame_count - duration_sec * fps) > greatest(2, duration_sec * fps * 0.02) THEN 'frame_count_mismatch' END
], lambda x: x IS NOT NULL) AS anomalies FROM """ + M


@R.add("f05_anomaly_codes", f"SELECT media_id, array_to_string(anomalies, ';') AS anomalies FROM ({RULES})")
def f05_anomaly_codes(spark, d):
    return _media(spark, d).select("media_id", F.array_join("anomalies", ";").alias("anomalies"))


@R.add("f06_frame_rate_mode", f"SELECT media_id, CASE WHEN fps IS NULL THEN 'unknown' WHEN abs(fps - nominal_fps) > greatest(0.05, 0.005 * fps) THEN 'variable' ELSE 'constant' END AS mode FROM {M}")
def f06_frame_rate_mode(spark, d):
    return base.load(spark, d, "MEDIA").select("media_id", media.frame_rate_mode(F.col("fps"), F.col("nominal_fps")).alias("mode"))


PROFILE_SQL = """SELECT '{c}' AS "column", count({c}) AS count, round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS median,
  round(quantile_cont({c}, 0.75), 6) AS p75, round(quantile_cont({c}, 0.9), 6) AS p90, round(quantile_cont({c}, 0.95), 6) AS p95, round(max({c}), 6) AS max, round(avg({c}), 6) AS mean, round(sum({c}), 3) AS total
  FROM (SELECT duration_sec::DOUBLE AS duration_sec, fps::DOUBLE AS fps, size_bytes::DOUBLE AS size_bytes, bitrate_bps::DOUBLE AS bitrate_bps FROM """ + M + ")"


@R.add("a01_numeric_profile", " UNION ALL ".join(PROFILE_SQL.replace("{c}", c) for c in ("duration_sec", "fps", "size_bytes", "bitrate_bps")))
def a01_numeric_profile(spark, d):
    return profile.numeric_profile(base.load(spark, d, "MEDIA"), ["duration_sec", "fps", "size_bytes", "bitrate_bps"])


@R.add("a02_quantiles", f"SELECT source, count(duration_sec) AS n, round(quantile_cont(duration_sec::DOUBLE, 0.05), 6) AS p5, round(quantile_cont(duration_sec::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(duration_sec::DOUBLE, 0.95), 6) AS p95 FROM {M} GROUP BY source")
def a02_quantiles(spark, d):
    return profile.quantiles(base.load(spark, d, "MEDIA"), "duration_sec", [0.05, 0.5, 0.95], ["source"])


def _histogram_sql(value: str, edges: list[float], source: str) -> str:
    rows = ", ".join(f"({i}, '{label}')" for i, label in enumerate(profile.edge_labels(edges)))
    bucket = " + ".join(f"(v >= {e})::INT" for e in edges)
    return f"""WITH c AS (SELECT {bucket} AS bucket, count(*) AS files FROM (SELECT {value} AS v FROM {source}) WHERE v IS NOT NULL GROUP BY 1)
SELECT l.bucket, label, coalesce(files, 0) AS files, round(coalesce(files, 0) * 100.0 / (SELECT sum(files) FROM c), 4) AS pct FROM (VALUES {rows}) l(bucket, label) LEFT JOIN c ON c.bucket = l.bucket"""


@R.add("a03_duration_histogram", _histogram_sql("duration_sec::DOUBLE", DURATION_EDGES, M))
def a03_duration_histogram(spark, d):
    return profile.histogram(base.load(spark, d, "MEDIA"), "duration_sec", DURATION_EDGES)


@R.add("a03_bitrate_histogram", _histogram_sql("bitrate_bps / 1e6", BITRATE_EDGES, M))
def a03_bitrate_histogram(spark, d):
    return profile.histogram(base.load(spark, d, "MEDIA").withColumn("mbps", F.col("bitrate_bps") / 1e6), "mbps", BITRATE_EDGES)


@R.add("a04_value_counts", f"SELECT coalesce(nullif(codec, ''), 'unknown') AS value, count(*) AS files, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS pct FROM {M} GROUP BY 1 ORDER BY files DESC, value LIMIT 3")
def a04_value_counts(spark, d):
    return profile.value_counts(base.load(spark, d, "MEDIA"), "codec", 3)


@R.add("a05_external_share", f"SELECT source, count(*) AS files, round(count(*) * 100.0 / (SELECT count(*) FROM orders), 6) AS pct FROM {M} GROUP BY source")
def a05_external_share(spark, d):
    orders = table(spark, d, "orders").agg(F.count(F.lit(1)).alias("denominator"))
    counts = base.load(spark, d, "MEDIA").groupBy("source").agg(F.count(F.lit(1)).alias("files"))
    return counts.crossJoin(F.broadcast(orders)).select("source", "files", F.round(F.col("files") * 100.0 / F.col("denominator"), 6).alias("pct"))


@R.add("a06_profile_groups", f"SELECT width, height, codec, pixel_format, count(*) AS files FROM {M} GROUP BY ALL ORDER BY files DESC, width, height, codec, pixel_format LIMIT 50")
def a06_profile_groups(spark, d):
    keys = ["width", "height", "codec", "pixel_format"]
    return base.load(spark, d, "MEDIA").groupBy(*keys).agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), *keys).limit(50)


@R.add("a07_folder_composition", f"SELECT split_part(folder, '/', 1) AS top, count(*) AS files, round(sum(duration_sec::DOUBLE), 3) AS duration, sum(size_bytes)::BIGINT AS bytes, count(*) FILTER (WHERE NOT ok) AS failed FROM {M} GROUP BY 1")
def a07_folder_composition(spark, d):
    top = F.split("folder", "/")[0].alias("top")
    return base.load(spark, d, "MEDIA").groupBy(top).agg(F.count(F.lit(1)).alias("files"), F.round(F.sum("duration_sec"), 3).alias("duration"), F.sum("size_bytes").alias("bytes"), F.count_if(~F.col("ok")).alias("failed"))


@R.add("a08_duplicate_candidates", f"""SELECT size_bytes, round_even(duration_sec::DOUBLE, 3) AS duration, width, height, codec, count(*) AS n, array_to_string(list_sort(list(relative_path))[1:200], ';') AS paths
FROM {M} WHERE ok AND size_bytes > 0 AND duration_sec IS NOT NULL GROUP BY ALL HAVING count(*) > 1 ORDER BY n DESC, size_bytes, duration, width, height, codec LIMIT 500""")
def a08_duplicate_candidates(spark, d):
    return media.duplicate_candidates(base.load(spark, d, "MEDIA")).withColumn("paths", F.array_join("paths", ";"))


@R.add("a09_anomaly_counts", f"""SELECT code, CASE WHEN code IN ('zero_duration', 'invalid_resolution', 'probe_failed') THEN 'error' WHEN code IN ('vfr', 'missing_frame_count', 'low_resolution', 'missing_bitrate', 'no_audio') THEN 'info' ELSE 'warning' END AS severity, count(*) AS files
FROM (SELECT unnest(CASE WHEN ok THEN anomalies ELSE ['probe_failed'] END) AS code FROM ({RULES})) GROUP BY code""")
def a09_anomaly_counts(spark, d):
    return media.anomaly_counts(_media(spark, d))


@R.add("a10_overview", f"""SELECT count(*) AS files, count(*) FILTER (WHERE ok) AS ok_files, count(duration_sec) AS with_duration, round(count(duration_sec) * 100.0 / count(*), 4) AS duration_pct,
  round(sum(duration_sec::DOUBLE), 3) AS total_duration, sum(size_bytes)::BIGINT AS bytes, count(*) FILTER (WHERE has_audio) AS with_audio, count(DISTINCT folder) AS folders, round(median(duration_sec::DOUBLE), 6) AS median_duration FROM {M}""")
def a10_overview(spark, d):
    n = F.count(F.lit(1))
    return base.load(spark, d, "MEDIA").agg(
        n.alias("files"), F.count_if("ok").alias("ok_files"), F.count("duration_sec").alias("with_duration"), F.round(F.count("duration_sec") * 100.0 / n, 4).alias("duration_pct"), F.round(F.sum("duration_sec"), 3).alias("total_duration"),
        F.sum("size_bytes").alias("bytes"), F.count_if("has_audio").alias("with_audio"), F.count_distinct("folder").alias("folders"), F.round(F.percentile("duration_sec", F.lit(0.5)), 6).alias("median_duration"),
    )


INTRINSICS = f"SELECT media_id, source, width, height, CASE WHEN media_id % 50 = 0 THEN 4.0 ELSE 0.3 + (media_id % 200) / 100.0 END AS fov_v, 0.4 + (media_id % 220) / 100.0 AS fov_h FROM {M} WHERE width > 0"


def _intrinsics(spark, d):
    m = base.load(spark, d, "MEDIA").filter("width > 0")
    k = F.col("media_id")
    return m.select("media_id", "source", "width", "height", F.when(k % 50 == 0, 4.0).otherwise(0.3 + (k % 200) / 100.0).alias("fov_v"), (0.4 + (k % 220) / 100.0).alias("fov_h"))


@R.add("f04_fov_validity", f"SELECT source, count(*) AS n, count(*) FILTER (WHERE fov_v > 0 AND fov_v < pi() AND fov_h > 0 AND fov_h < pi()) AS valid, count(*) FILTER (WHERE NOT (fov_v > 0 AND fov_v < pi() AND fov_h > 0 AND fov_h < pi())) AS invalid FROM ({INTRINSICS}) GROUP BY source")
def f04_fov_validity(spark, d):
    inside = lambda c: (F.col(c) > 0) & (F.col(c) < F.pi())
    ok = inside("fov_v") & inside("fov_h")
    return _intrinsics(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))


@R.add("a11_intrinsic_summary", f"""SELECT source, round(median(degrees(fov_v::DOUBLE)), 6) AS fov_v_deg, round(median(degrees(fov_h::DOUBLE)), 6) AS fov_h_deg, round(median(1 / (2 * tan(fov_h::DOUBLE / 2))), 6) AS fx_by_w, round(median(1 / (2 * tan(fov_v::DOUBLE / 2))), 6) AS fy_by_h,
  count(*) FILTER (WHERE degrees(fov_h) < 20 OR degrees(fov_h) > 160) AS extreme,
  count(*) FILTER (WHERE (width / (2 * tan(fov_h / 2))) / (height / (2 * tan(fov_v / 2))) NOT BETWEEN 0.95 AND 1.05) AS skewed
FROM ({INTRINSICS}) WHERE fov_v < pi() AND fov_h < pi() GROUP BY source""")
def a11_intrinsic_summary(spark, d):
    i = _intrinsics(spark, d).filter("fov_v < pi() AND fov_h < pi()")
    fx, fy = numbers.fov_to_focal(F.col("width"), F.col("fov_h")), numbers.fov_to_focal(F.col("height"), F.col("fov_v"))
    deg_h = F.degrees("fov_h")
    med = lambda c, n: F.round(F.percentile(c, F.lit(0.5)), 6).alias(n)
    return i.groupBy("source").agg(
        med(F.degrees("fov_v"), "fov_v_deg"), med(deg_h, "fov_h_deg"), med(fx / F.col("width"), "fx_by_w"), med(fy / F.col("height"), "fy_by_h"),
        F.count_if((deg_h < 20) | (deg_h > 160)).alias("extreme"), F.count_if(~(fx / fy).between(0.95, 1.05)).alias("skewed"),
    )


@R.add("a12_duration_deciles", f"SELECT folder, count(duration_sec) AS n, round(quantile_cont(duration_sec::DOUBLE, 0.1), 6) AS p10, round(quantile_cont(duration_sec::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(duration_sec::DOUBLE, 0.9), 6) AS p90, round(quantile_cont(duration_sec::DOUBLE, 0.99), 6) AS p99 FROM {M} GROUP BY folder")
def a12_duration_deciles(spark, d):
    return profile.quantiles(base.load(spark, d, "MEDIA"), "duration_sec", [0.1, 0.5, 0.9, 0.99], ["folder"])


@R.add("a13_entropy", f"""WITH c AS (SELECT source, folder, count(*) AS n FROM {M} GROUP BY ALL), p AS (SELECT source, n, n / sum(n) OVER (PARTITION BY source) AS p FROM c)
SELECT source, sum(n)::BIGINT AS total, count(*) AS categories, round(-sum(p * ln(p)), 6) AS entropy, round(CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0 END, 6) AS normalised, round(exp(-sum(p * ln(p))), 6) AS effective FROM p GROUP BY source""")
def a13_entropy(spark, d):
    return profile.entropy(base.load(spark, d, "MEDIA"), "folder", ["source"])


@R.add("a14_distinct_texts", """SELECT doc_type, count(*) AS texts, count(DISTINCT trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS distinct_texts, round(count(DISTINCT trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) / count(*), 6) AS ratio
FROM documents WHERE text IS NOT NULL GROUP BY doc_type""")
def a14_distinct_texts(spark, d):
    n, distinct = F.count(F.lit(1)), F.count_distinct(text.words_only(F.col("text")))
    return table(spark, d, "documents").filter("text IS NOT NULL").groupBy("doc_type").agg(n.alias("texts"), distinct.alias("distinct_texts"), F.round(distinct / n, 6).alias("ratio"))


#: Words without meaning for actions.
STOP_WORDS = ["the", "and", "with", "for", "near", "from", "using", "then", "that", "this"]


@R.add("a15_token_frequency", f"""SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(__index_level_0__), '[a-z]+')) AS token FROM tasks)
WHERE length(token) >= 3 AND token NOT IN ({", ".join(f"'{w}'" for w in STOP_WORDS)}) GROUP BY token ORDER BY n DESC, token LIMIT 16""")
def a15_token_frequency(spark, d):
    return profile.token_frequency(table(spark, d, "tasks"), "__index_level_0__", 16, STOP_WORDS)


@R.add("a19_rollup", f"SELECT source, folder, count(*) AS files, count(*) FILTER (WHERE ok) AS ok_files, round(sum(duration_sec::DOUBLE), 3) AS duration, grouping(source, folder)::BIGINT AS level FROM {M} GROUP BY ROLLUP (source, folder)")
def a19_rollup(spark, d):
    return base.load(spark, d, "MEDIA").rollup("source", "folder").agg(F.count(F.lit(1)).alias("files"), F.count_if("ok").alias("ok_files"), F.round(F.sum("duration_sec"), 3).alias("duration"), F.grouping_id().cast("long").alias("level"))


@R.add("f24_browse_text", f"SELECT media_id, relative_path FROM ({RULES}) WHERE contains(lower(concat_ws(' ', relative_path, codec, resolution, container, source, folder)), 'a/f/3') AND list_contains(anomalies, 'vfr') AND codec = 'hevc'")
def f24_browse_text(spark, d):
    return media.browse(_media(spark, d), "A/F/3", "vfr", {"codec": "hevc"}).select("media_id", "relative_path")


@R.add("f24_browse_modes", f"""SELECT 'failed' AS mode, count(*) FILTER (WHERE NOT ok) AS files FROM ({RULES}) UNION ALL SELECT 'clean', count(*) FILTER (WHERE ok AND len(anomalies) = 0) FROM ({RULES}) UNION ALL SELECT 'any', count(*) FILTER (WHERE NOT ok OR len(anomalies) > 0) FROM ({RULES})""")
def f24_browse_modes(spark, d):
    m = _media(spark, d)
    some = F.size("anomalies") > 0
    modes = {"failed": ~F.col("ok"), "clean": F.col("ok") & ~some, "any": ~F.col("ok") | some}
    one = m.agg(*[F.count_if(c).alias(k) for k, c in modes.items()])  # all modes in one scan
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("mode"), F.col(k).alias("files")) for k in modes])))


@R.add("o01_nulls_last", f"SELECT media_id, duration_sec::DOUBLE AS duration_sec FROM {M} ORDER BY duration_sec ASC NULLS LAST, media_id OFFSET 100 LIMIT 50")
def o01_nulls_last(spark, d):
    return media.page(base.load(spark, d, "MEDIA"), "duration_sec", False, 3, 50, "media_id").select("media_id", "duration_sec")


@R.add("o02_page", f"SELECT media_id, relative_path FROM {M} ORDER BY lower(relative_path) DESC NULLS LAST, media_id LIMIT 10")
def o02_page(spark, d):
    return media.page(base.load(spark, d, "MEDIA"), "relative_path", True, 0, 3, "media_id").select("media_id", "relative_path")


@R.add("o03_top_k", f"SELECT folder, count(*) AS files FROM {M} GROUP BY folder ORDER BY files DESC, folder LIMIT 5")
def o03_top_k(spark, d):
    return base.load(spark, d, "MEDIA").groupBy("folder").agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "folder").limit(5)


@R.add("g20_report_limits", f"SELECT source, array_to_string(list_sort(list(DISTINCT folder))[1:20], ';') AS folders FROM {M} GROUP BY source")
def g20_report_limits(spark, d):
    folders = base.load(spark, d, "MEDIA").select("source", "folder").distinct()
    return folders.groupBy("source").agg(F.array_join(F.slice(F.sort_array(F.collect_list("folder")), 1, 20), ";").alias("folders"))


@R.add("k06_report_rows", f"SELECT relative_path, ok, duration_sec::DOUBLE AS duration_sec, array_to_string(anomalies, ';') AS anomalies FROM ({RULES})")
def k06_report_rows(spark, d):
    from frameloom.sinks.reports import write_and_read_csv

    rows = _media(spark, d).select("relative_path", "ok", "duration_sec", F.array_join("anomalies", ";").alias("anomalies"))
    return write_and_read_csv(rows)
