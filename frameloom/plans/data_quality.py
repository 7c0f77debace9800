"""Queries of the general data-quality operators: compaction and interval coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.operators import compaction, coverage, spikes
from frameloom.plans.registry import Registry
from frameloom.session import checkpoint, table
from frameloom.sinks.reports import scratch

R = Registry()


@R.add("p1_found")
def p1_found(spark, d: str) -> DataFrame:
    return p1_readings(spark, d).select("seq_id", "frame", "field").distinct()


@R.add("p1_readings")
def p1_readings(spark, d: str) -> DataFrame:
    return spikes.implausible(table(spark, d, "prediction"), table(spark, d, "gtsequence"))


P2_SQL = r"""
WITH lines AS (
  SELECT kind, trim(unnest(regexp_split_to_array(payload, '\r\n|\r|\n'))) AS line FROM data_files)
SELECT DISTINCT kind,
  CASE WHEN kind = 'parquet' THEN CAST(json_extract_string(line, '$.episode_index') AS BIGINT) ELSE CAST(split_part(line, ',', 1) AS BIGINT) END AS episode_index,
  CASE WHEN kind = 'parquet' THEN CAST(json_extract_string(line, '$.frame_index') AS BIGINT) ELSE CAST(split_part(line, ',', 2) AS BIGINT) END AS frame_index
FROM lines
WHERE (kind = 'parquet' AND line LIKE '{%}' AND json_valid(line)) OR (kind = 'video' AND regexp_matches(line, '^-?[0-9]+,-?[0-9]+,-?[0-9]+,[KP]$'))
"""


@R.add("p2_found", P2_SQL)
def p2_found(spark, d: str) -> DataFrame:
    blobs = compaction.compact(table(spark, d, "data_files"))
    return compaction.read_keys(blobs)


@R.add("p2_compacted")
def p2_compacted(spark, d: str) -> DataFrame:
    return compaction.compact(table(spark, d, "data_files"))


_P2_LINES = r"""
lines AS (SELECT file_id, kind, written_at, trim(unnest(regexp_split_to_array(payload, '\r\n|\r|\n'))) AS line FROM data_files),
records AS (SELECT file_id, kind, written_at, line,
    CASE WHEN kind = 'parquet' THEN CAST(json_extract_string(line, '$.episode_index') AS BIGINT) ELSE CAST(split_part(line, ',', 1) AS BIGINT) END AS e,
    CASE WHEN kind = 'parquet' THEN CAST(json_extract_string(line, '$.frame_index') AS BIGINT) ELSE CAST(split_part(line, ',', 2) AS BIGINT) END AS f
  FROM lines WHERE (kind = 'parquet' AND line LIKE '{%}' AND json_valid(line)) OR (kind = 'video' AND regexp_matches(line, '^-?[0-9]+,-?[0-9]+,-?[0-9]+,[KP]$')))"""


@R.add("p2_audit", f"""
WITH {_P2_LINES},
n AS (SELECT file_id, count(*) AS records FROM records GROUP BY file_id)
SELECT kind, count(*) AS files, count(*) FILTER (WHERE payload IS NULL) AS missing, count(*) FILTER (WHERE payload IS NOT NULL AND strlen(payload) IS DISTINCT FROM size_bytes) AS wrong_size,
  count(*) FILTER (WHERE payload IS NOT NULL AND (content_hash IS NULL OR content_hash = '' OR NOT starts_with(sha256(payload), content_hash))) AS wrong_hash,
  count(*) FILTER (WHERE payload IS NOT NULL AND coalesce(records, 0) IS DISTINCT FROM n_records) AS wrong_records, coalesce(sum(records), 0)::BIGINT AS records
FROM data_files LEFT JOIN n USING (file_id) GROUP BY kind""")
def p2_audit(spark, d: str) -> DataFrame:
    return compaction.audit(table(spark, d, "data_files"))


@R.add("p2_written", f"""
WITH {_P2_LINES},
once AS (SELECT kind, e, f, max_by(line, struct_pack(a := coalesce(written_at, '-infinity'::TIMESTAMP), i := file_id)) AS line FROM records GROUP BY kind, e, f)
SELECT kind, count(*) AS records, sum(strlen(line) + 1)::BIGINT AS raw_bytes, bit_xor(hash_) AS keys FROM (SELECT *, e * 1000003 + f AS hash_ FROM once) GROUP BY kind""")
def p2_written(spark, d: str) -> DataFrame:
    """What is read back from files of 16 KB that were written, joined frame by frame to larger ones and written again."""
    first, second = (f"{scratch(spark)}/{name}" for name in ("small", "large"))
    compaction.write_compacted(compaction.compact(table(spark, d, "data_files"), target_bytes=1 << 14), first)
    compaction.write_compacted(compaction.merge_blobs(spark.read.parquet(first)), second)
    blobs = spark.read.parquet(second)
    sizes = blobs.groupBy("kind").agg(F.sum("n_records").alias("records"), F.sum("raw_bytes").alias("raw_bytes"))
    keys = compaction.read_keys(blobs).groupBy("kind").agg(F.bit_xor(F.col("episode_index") * 1000003 + F.col("frame_index")).alias("keys"))
    return sizes.join(keys, "kind")


@R.add("p2_report")
def p2_report(spark, d: str) -> DataFrame:
    files = table(spark, d, "data_files")
    return compaction.size_report(files, checkpoint(compaction.compact(files).drop("payload")))


P3_SQL = """
WITH v AS (
  SELECT DISTINCT lower(trim(source)) AS source, source_dataset_index AS i, source_frame_start AS a, source_frame_stop AS b FROM sample_manifest
  WHERE source IS NOT NULL AND source_dataset_index IS NOT NULL AND source_frame_stop > source_frame_start),
m AS (SELECT *, max(b) OVER (PARTITION BY source, i ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM v),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR a > p THEN 1 ELSE 0 END) OVER (PARTITION BY source, i ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM m),
q AS (SELECT source, i, k, min(a) AS a, max(b) AS b FROM g GROUP BY source, i, k),
z AS (SELECT *, lead(a) OVER (PARTITION BY source, i ORDER BY a) AS n FROM q)
SELECT 'period' AS kind, source, i AS source_dataset_index, a AS frame_start, b AS frame_stop FROM z
UNION ALL SELECT 'gap', source, i, b, n FROM z WHERE n IS NOT NULL
"""


def _recordings(spark, d: str) -> DataFrame:
    return table(spark, d, "sample_manifest").withColumn("source", F.regexp_replace(F.lower("source"), r"^\s+|\s+$", ""))


@R.add("p3_found", P3_SQL)
def p3_found(spark, d: str) -> DataFrame:
    found = coverage.coverage(_recordings(spark, d), ["source", "source_dataset_index"], "source_frame_start", "source_frame_stop")
    return found.withColumnsRenamed({"start": "frame_start", "stop": "frame_stop"})


@R.add("p3_summary", f"""
SELECT source, count(*) FILTER (WHERE kind = 'period') AS periods, count(*) FILTER (WHERE kind = 'gap') AS gaps,
  coalesce(sum(frame_stop - frame_start) FILTER (WHERE kind = 'period'), 0)::BIGINT AS covered, coalesce(sum(frame_stop - frame_start) FILTER (WHERE kind = 'gap'), 0)::BIGINT AS missing
FROM ({P3_SQL}) GROUP BY source""")
def p3_summary(spark, d: str) -> DataFrame:
    size, is_period = F.col("frame_stop") - F.col("frame_start"), F.col("kind") == "period"
    total = lambda c: F.coalesce(F.sum(F.when(c, size)), F.lit(0))
    return p3_found(spark, d).groupBy("source").agg(F.count_if(is_period).alias("periods"), F.count_if(~is_period).alias("gaps"), total(is_period).alias("covered"), total(~is_period).alias("missing"))
