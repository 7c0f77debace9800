"""Canonical inputs of the queries: the same derivation as SQL text for Spark and for DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.session import table

#: Media-metadata rows derived from order lines.
MEDIA = """
SELECT l_orderkey * 8 + l_linenumber AS media_id,
  concat(l_returnflag, '/', l_linestatus, '/', cast(l_suppkey % 7 AS STRING), '/clip_', cast(l_orderkey AS STRING), '_', cast(l_linenumber AS STRING), '.mp4') AS relative_path,
  l_returnflag AS source, concat(l_returnflag, '/', l_linestatus, '/', cast(l_suppkey % 7 AS STRING)) AS folder, 'mp4' AS extension,
  l_linenumber <> 7 AS ok,
  CASE WHEN l_linenumber = 7 OR l_partkey % 97 = 0 THEN NULL WHEN l_partkey % 89 = 0 THEN 0.05 ELSE l_extendedprice / 5 END AS duration_sec,
  CASE WHEN l_partkey % 83 = 0 THEN NULL ELSE (CASE l_partkey % 6 WHEN 0 THEN 30.0 WHEN 1 THEN 25.0 WHEN 2 THEN 60.0 WHEN 3 THEN 24.0 WHEN 4 THEN 50.0 ELSE 4.0 END) + CASE WHEN l_discount > 0.08 THEN 0.5 ELSE 0 END END AS fps,
  CASE l_partkey % 6 WHEN 0 THEN 30.0 WHEN 1 THEN 25.0 WHEN 2 THEN 60.0 WHEN 3 THEN 24.0 WHEN 4 THEN 50.0 ELSE 4.0 END AS nominal_fps,
  CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE cast(floor(l_extendedprice / 5 * 25 + l_quantity) AS BIGINT) END AS frame_count,
  CASE l_suppkey % 5 WHEN 0 THEN 1920 WHEN 1 THEN 1280 WHEN 2 THEN 320 WHEN 3 THEN 480 ELSE 0 END AS width,
  CASE l_suppkey % 5 WHEN 0 THEN 1080 WHEN 1 THEN 720 WHEN 2 THEN 90 WHEN 3 THEN 854 ELSE 0 END AS height,
  cast(NULL AS DOUBLE) AS display_aspect_ratio,
  CASE WHEN l_suppkey % 13 = 0 THEN '' WHEN l_suppkey % 3 = 0 THEN 'h264' WHEN l_suppkey % 3 = 1 THEN 'hevc' ELSE 'av1' END AS codec,
  CASE WHEN l_suppkey % 2 = 0 THEN 'yuv420p' ELSE 'yuv420p10le' END AS pixel_format,
  concat(cast(l_suppkey % 5 AS STRING), 'x') AS resolution, 'mov' AS container,
  CASE WHEN l_quantity < 3 THEN NULL ELSE cast(l_quantity * 100000 AS BIGINT) END AS bitrate_bps,
  cast(floor(l_quantity) * 1000 AS BIGINT) AS size_bytes, l_tax > 0.01 AS has_audio,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice / 5 + CASE WHEN l_tax > 0.07 THEN l_quantity * 20 ELSE 0 END END AS stream_duration_sec
FROM lineitem
"""

#: Camera positions, one row for each frame: the row ingested last, finite and in reach.
FRAMES = """
SELECT seq_id, frame, source, ts, CAST(e[3] AS DOUBLE) AS x, CAST(e[7] AS DOUBLE) AS y, CAST(e[11] AS DOUBLE) AS z, left_on, right_on
FROM (SELECT seq_id, frame, source, ts, extrinsic_c2w AS e, hand_presence_logits[0] >= 0 AS left_on, hand_presence_logits[1] >= 0 AS right_on,
        row_number() OVER (PARTITION BY seq_id, frame ORDER BY ingested_at DESC) AS rn FROM prediction)
WHERE rn = 1 AND abs(e[3]) < 1000 AND abs(e[7]) < 1000 AND abs(e[11]) < 1000
"""

#: Stage events of a run, derived from the event table.
STAGES = """
SELECT concat('scene_', cast(user_id AS STRING)) AS scene, cast(event_id % 3 AS INT) AS clip_idx,
  CASE event_type WHEN 'view' THEN 'geo' WHEN 'click' THEN 'depth' WHEN 'purchase' THEN 'hands' WHEN 'signup' THEN 'slam' ELSE 'final' END AS stage,
  CASE WHEN value < 2 THEN 'failed' WHEN value < 12 THEN 'running' WHEN value < 14 THEN 'skipped' ELSE 'done' END AS status,
  CASE WHEN value < 2 THEN props END AS error, ts, event_id
FROM events
"""

#: Scores of sequences in long form: head, dataset, sequence, metric, value.
SCORES = """
SELECT concat('head_', l_returnflag) AS head, concat('set_', l_linestatus) AS dataset,
  concat('seq', cast(l_orderkey AS STRING), CASE l_linenumber % 3 WHEN 0 THEN '#left' WHEN 1 THEN '#right' ELSE '' END) AS seq_id,
  CASE WHEN l_linenumber = 7 THEN 'error' WHEN l_linenumber = 6 THEN 'skipped' ELSE 'evaluated' END AS status,
  l_quantity AS ate, CASE WHEN l_discount > 0.09 THEN NULL ELSE l_extendedprice / 1000 END AS rpe, l_tax * 10 AS recall,
  cast(l_partkey % 50 + 1 AS BIGINT) AS frames, l_suppkey % 10 + 0.5 AS seconds, l_orderkey, l_linenumber
FROM lineitem
"""

TABLES = {"MEDIA": MEDIA, "FRAMES": FRAMES, "STAGES": STAGES, "SCORES": SCORES}
_FROM = re.compile(r"\bFROM (lineitem|prediction|events)\b")


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A canonical input for Spark."""
    text = TABLES[name]
    used = set(_FROM.findall(text))
    return spark.sql(_FROM.sub(r"FROM {\1}", text), **{t: table(spark, d, t) for t in used})


def sql(name: str) -> str:
    """The same input as a subquery for DuckDB, where list indexes begin at 1 and STRING is VARCHAR."""
    text = re.sub(r"\b(e|hand_presence_logits)\[(\d+)\]", lambda m: f"{m[1]}[{int(m[2]) + 1}]", TABLES[name])
    return f"({text.strip()})".replace("AS STRING", "AS VARCHAR")


#: Of each frame of the prediction table the row ingested last, for DuckDB.
NEWEST = "(SELECT * FROM prediction QUALIFY row_number() OVER (PARTITION BY seq_id, frame ORDER BY ingested_at DESC) = 1)"


def newest(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """``seq_id, frame`` and columns of the counting rows of the prediction table."""
    rows = table(spark, d, "prediction").groupBy("seq_id", "frame").agg(F.max_by(F.struct(*columns), "ingested_at").alias("m"))
    return rows.select("seq_id", "frame", "m.*")
