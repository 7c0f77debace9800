"""Queries of the training-data operators and the SQL that states their results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm import events, leaks, mixing, mojibake, splits, terms, tokens
from frameloom.plans.registry import Registry
from frameloom.session import checkpoint, collect_small, table

R = Registry()

# Problem 4: terms

P4_COUNTS = r"""
WITH once AS (SELECT DISTINCT task_index, __index_level_0__ AS text FROM tasks WHERE task_index IS NOT NULL),
words AS (SELECT task_index, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM once),
counts AS (SELECT term, count(*) AS occurrences, count(DISTINCT task_index) AS records FROM words GROUP BY term),
marked AS (SELECT term, occurrences, records, records / n AS share, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.15 * n THEN 'common' END AS mark
  FROM counts, (SELECT count(DISTINCT task_index) AS n FROM tasks))
"""


@R.add("p4_found", P4_COUNTS + "SELECT term, mark FROM marked WHERE mark IS NOT NULL")
def p4_found(spark, d: str) -> DataFrame:
    return p4_terms(spark, d).filter("mark IS NOT NULL").select("term", "mark")


@R.add("p4_terms", P4_COUNTS + "SELECT * FROM marked")
def p4_terms(spark, d: str) -> DataFrame:
    return terms.term_frequencies(table(spark, d, "tasks"), "task_index", "__index_level_0__")


# Problem 5: runs

P5_SQL = """
WITH p AS (SELECT * FROM prediction QUALIFY row_number() OVER (PARTITION BY seq_id, frame ORDER BY ingested_at DESC NULLS LAST) = 1),
g AS (SELECT * FROM gtsequence QUALIFY row_number() OVER (PARTITION BY seq_id, frame ORDER BY ingested_at DESC NULLS LAST) = 1),
s AS (
  SELECT 'pred_left' AS track, seq_id, frame, hand_presence_logits[1] >= 0 AS on_ FROM p WHERE NOT isnan(hand_presence_logits[1])
  UNION ALL SELECT 'pred_right', seq_id, frame, hand_presence_logits[2] >= 0 FROM p WHERE NOT isnan(hand_presence_logits[2])
  UNION ALL SELECT 'gt', seq_id, frame, hand_valid FROM g WHERE hand_valid IS NOT NULL),
k AS (SELECT *, frame - row_number() OVER (PARTITION BY track, seq_id, on_ ORDER BY frame) AS isle FROM s)
"""


def _tracks(spark, d: str, **more) -> DataFrame:
    logit = lambda i: F.when(~F.isnan(F.get("hand_presence_logits", F.lit(i))), (F.get("hand_presence_logits", F.lit(i)) >= 0).cast("int"))
    pred = table(spark, d, "prediction").select("seq_id", "frame", "ingested_at", logit(0).alias("pred_left"), logit(1).alias("pred_right"))
    gt = table(spark, d, "gtsequence").select("seq_id", "frame", "ingested_at", F.col("hand_valid").cast("int").alias("gt"))
    left = events.collapse_runs(pred, "seq_id", "frame", ["pred_left", "pred_right"], order="ingested_at", **more)
    return left.unionByName(events.collapse_runs(gt, "seq_id", "frame", ["gt"], order="ingested_at", **more))


@R.add("p5_found", P5_SQL + "SELECT track, seq_id, min(frame) AS frame_first, max(frame) AS frame_last FROM k GROUP BY track, seq_id, on_, isle")
def p5_found(spark, d: str) -> DataFrame:
    return _tracks(spark, d).select("track", F.col("entity").alias("seq_id"), F.col("first").alias("frame_first"), F.col("last").alias("frame_last"))


def _with_duration(spark, d: str, runs: DataFrame) -> DataFrame:
    spf = (F.max("ts") - F.min("ts")) / F.nullif(F.max("frame") - F.min("frame"), F.lit(0))
    counting = table(spark, d, "prediction").groupBy("seq_id", "frame").agg(F.max_by("ts", F.struct("ingested_at")).alias("ts"))
    rate = counting.filter(~F.isnan("ts") & (F.abs("ts") < float("inf"))).groupBy("seq_id").agg(spf.alias("spf"))
    return runs.join(rate, "seq_id", "left").withColumn("duration_sec", F.round(F.col("n_frames") * F.col("spf"), 6)).drop("spf")


@R.add("p5_events", P5_SQL + """, r AS (SELECT seq_id, (max(ts) - min(ts)) / nullif(max(frame) - min(frame), 0) AS spf FROM p WHERE isfinite(ts) GROUP BY seq_id)
SELECT track, k.seq_id, CASE WHEN on_ THEN 'present' ELSE 'absent' END AS state, min(frame) AS frame_first, max(frame) AS frame_last, count(*) AS n_frames,
  round(count(*) * any_value(spf), 6) AS duration_sec
FROM k LEFT JOIN r ON r.seq_id = k.seq_id GROUP BY track, k.seq_id, on_, isle""")
def p5_events(spark, d: str) -> DataFrame:
    """A frame lasts what one lasts on average in its sequence; null where the sequence has no usable time."""
    n = F.col("last") - F.col("first") + 1
    runs = _tracks(spark, d).select("track", F.col("entity").alias("seq_id"), F.when(F.col("state") == 1, "present").otherwise("absent").alias("state"), F.col("first").alias("frame_first"), F.col("last").alias("frame_last"), n.alias("n_frames"))
    return _with_duration(spark, d, runs)


P5_SMOOTHED = P5_SQL.replace("WITH p AS", "WITH RECURSIVE p AS") + """,
runs AS (SELECT track, seq_id, on_::INT AS state, min(frame) AS a, max(frame) AS b, count(*) AS n FROM k GROUP BY track, seq_id, on_, isle),
apart AS (SELECT *, lag(b) OVER (PARTITION BY track, seq_id ORDER BY a) IS DISTINCT FROM a - 1 AS cut FROM runs),
numbered AS (SELECT *, sum(cut::INT) OVER (PARTITION BY track, seq_id ORDER BY a) AS stretch FROM apart),
r AS (SELECT *, row_number() OVER (PARTITION BY track, seq_id, stretch ORDER BY a) AS i, count(*) OVER (PARTITION BY track, seq_id, stretch) AS last_i FROM numbered),
way(track, seq_id, stretch, i, last_i, c0, c1, w0, w1) AS (
  SELECT track, seq_id, stretch, i, last_i, n * state::DOUBLE, n * (1 - state)::DOUBLE, '0', '1' FROM r WHERE i = 1
  UNION ALL SELECT r.track, r.seq_id, r.stretch, r.i, r.last_i, least(c0, c1 + 2.5) + n * state, least(c1, c0 + 2.5) + n * (1 - state),
    CASE WHEN c0 > c1 + 2.5 THEN w1 ELSE w0 END || '0', CASE WHEN c1 > c0 + 2.5 THEN w0 ELSE w1 END || '1'
  FROM way JOIN r ON r.track = way.track AND r.seq_id = way.seq_id AND r.stretch = way.stretch AND r.i = way.i + 1),
labelled AS (SELECT r.*, substr(CASE WHEN c1 < c0 THEN w1 ELSE w0 END, r.i::INT, 1)::INT AS label FROM way JOIN r USING (track, seq_id, stretch) WHERE way.i = way.last_i),
steps AS (SELECT *, lag(label) OVER (PARTITION BY track, seq_id, stretch ORDER BY i) IS DISTINCT FROM label AS new FROM labelled),
segments AS (SELECT *, sum(new::INT) OVER (PARTITION BY track, seq_id, stretch ORDER BY i) AS segment FROM steps),
t AS (SELECT seq_id, (max(ts) - min(ts)) / nullif(max(frame) - min(frame), 0) AS spf FROM p WHERE isfinite(ts) GROUP BY seq_id)
SELECT track, segments.seq_id, label AS state, min(a) AS frame_first, max(b) AS frame_last, (max(b) - min(a) + 1)::BIGINT AS n_frames, sum(n * (state <> label)::INT)::DOUBLE AS frames_changed,
  round((max(b) - min(a) + 1) * any_value(spf), 6) AS duration_sec
FROM segments LEFT JOIN t ON t.seq_id = segments.seq_id GROUP BY track, segments.seq_id, stretch, segment, label"""


@R.add("p5_smoothed", P5_SMOOTHED)
def p5_smoothed(spark, d: str) -> DataFrame:
    """Near-identical events: flickers that cost less than two boundaries of 2.5 frames each join the run around them."""
    n = F.col("last") - F.col("first") + 1
    runs = _tracks(spark, d, penalty=2.5).select("track", F.col("entity").alias("seq_id"), "state", F.col("first").alias("frame_first"), F.col("last").alias("frame_last"), n.alias("n_frames"), F.col("cost").alias("frames_changed"))
    return _with_duration(spark, d, runs)


# Problem 6: mixing


def _mix(spark, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(table(spark, d, "sample_manifest"), "source", "frames", ["episode_index", "source_dataset_index", "source_frame_start", "source_frame_stop"], table(spark, d, "mix_targets"))


@R.add("p6_mixed")
def p6_mixed(spark, d: str) -> DataFrame:
    return _mix(spark, d)[0]


@R.add("p6_shares")
def p6_shares(spark, d: str) -> DataFrame:
    return _mix(spark, d)[1]


# Problem 7: splits


def _groups(spark, d: str) -> DataFrame:
    manifest = table(spark, d, "sample_manifest").withColumn("source", F.regexp_replace(F.lower("source"), r"^\s+|\s+$", ""))
    return splits.related_groups(manifest, "episode_index", ["source", "source_dataset_index"])


P7_SQL = """
WITH RECURSIVE m AS (SELECT DISTINCT episode_index AS e, lower(trim(source)) AS s, source_dataset_index AS i FROM sample_manifest WHERE episode_index IS NOT NULL),
low AS (SELECT s, i, min(e) AS low FROM m WHERE s IS NOT NULL AND i IS NOT NULL GROUP BY s, i),
l AS (SELECT DISTINCT m.e, low.low FROM m JOIN low ON low.s = m.s AND low.i = m.i),
links AS (SELECT DISTINCT a.low AS x, b.low AS y FROM l a JOIN l b ON a.e = b.e AND a.low <> b.low),
reach(x, y) AS (SELECT DISTINCT low, low FROM l UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
root AS (SELECT x AS low, min(y) AS root FROM reach GROUP BY x)
SELECT n.e AS episode_index, coalesce(min(root.root), n.e) AS group_episode FROM (SELECT DISTINCT e FROM m) n LEFT JOIN l ON l.e = n.e LEFT JOIN root ON root.low = l.low GROUP BY n.e
"""


@R.add("p7_found", P7_SQL)
def p7_found(spark, d: str) -> DataFrame:
    return _groups(spark, d).select(F.col("record").alias("episode_index"), F.col("root").alias("group_episode"))


def _split_targets(spark, d: str) -> dict[str, float]:
    return {r["split_name"]: r["target_share"] for r in collect_small(table(spark, d, "split_targets").dropna())}


@R.add("p7_splits")
def p7_splits(spark, d: str) -> DataFrame:
    groups = checkpoint(_groups(spark, d))
    return splits.assign_splits(groups, _split_targets(spark, d)).select(F.col("record").alias("episode_index"), F.col("root").alias("group_episode"), "split")


@R.add("p7_report")
def p7_report(spark, d: str) -> DataFrame:
    targets = _split_targets(spark, d)
    return splits.split_report(checkpoint(splits.assign_splits(checkpoint(_groups(spark, d)), targets)), targets)


# Problem 8: token ids


@R.add("p8_ids")
def p8_ids(spark, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text")


# Problem 9: leaks of evaluation texts


def _leaks(spark, d: str, least_run: int = 0) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text", least_run=least_run)


@R.add("p9_found")
def p9_found(spark, d: str) -> DataFrame:
    return _leaks(spark, d, leaks.RUN).select("doc_id", "item_id")


@R.add("p9_leaks")
def p9_leaks(spark, d: str) -> DataFrame:
    return _leaks(spark, d)


# Problem 10: wrong decodings


@R.add("p10_found")
def p10_found(spark, d: str) -> DataFrame:
    return mojibake.garbled_chunks(table(spark, d, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id")).distinct()


@R.add("p10_restored")
def p10_restored(spark, d: str) -> DataFrame:
    return mojibake.restore(table(spark, d, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "text", "restored", F.array_join("channels", "; ").alias("channels"))
