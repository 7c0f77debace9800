"""Queries of discovery, caches, probes and growing sinks."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.operators.sampling import dataset_seed
from frameloom.plans import base
from frameloom.plans.base import NEWEST, newest
from frameloom.plans.registry import Registry
from frameloom.session import checkpoint, collect_small, table
from frameloom.sinks import stores
from frameloom.sinks.reports import scratch, write_control_file
from frameloom.sources import discovery
from frameloom.sources.files import CAMERA_TAG, camera_files
from frameloom.streaming import streams

R = Registry()
FR = base.sql("FRAMES")


@R.add("s05_scan_cache", "SELECT file_path, true AS cached FROM data_files UNION ALL SELECT DISTINCT 'another root', false FROM data_files")
def s05_scan_cache(spark, d) -> DataFrame:
    """A second scan of the same root reads the cache; another root doesn't."""
    place = scratch(spark)
    scan = lambda: table(spark, d, "data_files").select("file_path")
    discovery.cached_scan(spark, d, place, scan)
    again, hit = discovery.cached_scan(spark, d, place, scan)
    _, other = discovery.cached_scan(spark, d + "/other", place, scan)
    return again.withColumn("cached", F.lit(hit)).unionByName(spark.createDataFrame([("another root", other)], "file_path STRING, cached BOOLEAN"))


def _head(payload: str | None) -> dict:
    """Prober of a stored payload: its first line must be complete."""
    if not payload:
        raise ValueError("no content")
    if "\n" not in payload:
        raise ValueError("no complete line")
    return {"lines": payload.count("\n"), "bytes": len(payload.encode())}


@R.add("s06_probe", r"""SELECT ok, error, count(*) AS files, sum(lines)::BIGINT AS lines, sum(bytes)::BIGINT AS bytes FROM (
SELECT payload IS NOT NULL AND contains(payload, chr(10)) AS ok, CASE WHEN payload IS NULL OR payload = '' THEN 'ValueError: no content' WHEN NOT contains(payload, chr(10)) THEN 'ValueError: no complete line' END AS error,
  CASE WHEN contains(payload, chr(10)) THEN length(payload) - length(replace(payload, chr(10), '')) END AS lines, CASE WHEN contains(payload, chr(10)) THEN strlen(payload) END AS bytes FROM data_files) GROUP BY ok, error""")
def s06_probe(spark, d) -> DataFrame:
    """A file that can't be probed is a row that isn't ok."""
    p = discovery.probe(table(spark, d, "data_files"), "payload", _head, "lines BIGINT, bytes BIGINT", ["lines", "bytes"])
    return p.groupBy("ok", "error").agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"))


@R.add("s10_row_frames", "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS frame_index FROM customer")
def s10_row_frames(spark, d) -> DataFrame:
    """Frames of a table without a frame column, written as one sorted file: the row number in the file."""
    place = scratch(spark)
    table(spark, d, "customer").select("c_custkey").repartition(1).sortWithinPartitions("c_custkey").write.parquet(place)  # one file is the feature
    return discovery.row_numbered_frames(spark, place).select("c_custkey", "frame_index")


_LISTING = "SELECT concat('disk/set_', o_custkey % 40, CASE WHEN o_orderkey % 3 = 0 THEN '/part/inner_' || o_orderkey % 4 ELSE '' END, CASE o_orderkey % 5 WHEN 0 THEN '/meta/info.json' WHEN 1 THEN '/data/chunk-0/file.parquet' WHEN 2 THEN '/videos/a.mp4' ELSE '/notes.txt' END) AS path FROM orders WHERE o_custkey % 7 <> 0 OR o_orderkey % 5 <> 0"


@R.add("s13_roots", f"""WITH f AS ({_LISTING}), m AS (SELECT DISTINCT left(path, length(path) - 15) AS root FROM f WHERE path LIKE '%/meta/info.json'),
r AS (SELECT root FROM m WHERE EXISTS (SELECT 1 FROM f WHERE starts_with(path, concat(root, '/data/'))))
SELECT root FROM r WHERE NOT EXISTS (SELECT 1 FROM r o WHERE starts_with(r.root, concat(o.root, '/')))""")
def s13_roots(spark, d) -> DataFrame:
    """Dataset roots of a listing; roots inside others are left out."""
    return discovery.dataset_roots(spark.sql(_LISTING.replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders")), "path")


@R.add("s15_labels", r"""WITH l AS (SELECT file_id AS id, trim(unnest(regexp_split_to_array(payload, '\r\n|\r|\n'))) AS line FROM data_files WHERE kind = 'parquet')
SELECT 'lines' AS form, count(*) AS entries, sum(CAST(json_extract(line, '$.frame_index') AS BIGINT))::BIGINT AS total FROM l WHERE line LIKE '{%}' AND json_valid(line)
UNION ALL SELECT 'array', 2 * count(*), 2 * sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT FROM events""")
def s15_labels(spark, d) -> DataFrame:
    """Labels stored as JSON lines and as JSON arrays, through one reader."""
    lines = discovery.json_or_lines(table(spark, d, "data_files").filter("kind = 'parquet'").select(F.lit("lines").alias("form"), "payload"), "payload", "frame_index BIGINT")
    twice = table(spark, d, "events").select(F.lit("array").alias("form"), F.concat(F.lit("["), "props", F.lit(","), "props", F.lit("]")).alias("payload"))
    arrays = discovery.json_or_lines(twice, "payload", "k BIGINT")
    both = lines.select("form", F.col("entry.frame_index").alias("v")).unionByName(arrays.select("form", F.col("entry.k").alias("v")))
    return both.groupBy("form").agg(F.count(F.lit(1)).alias("entries"), F.sum("v").alias("total"))


@R.add("s17_manifest", "SELECT DISTINCT concat('scene_', user_id) AS key, NULL::VARCHAR AS status, NULL::INT AS attempts FROM events")
def s17_manifest(spark, d) -> DataFrame:
    """A manifest of an older writer: missing columns are null; no table is an empty manifest."""
    place, schema = scratch(spark), "key STRING, status STRING, attempts INT"
    table(spark, d, "events").select(F.concat(F.lit("scene_"), F.col("user_id").cast("string")).alias("key")).distinct().write.parquet(place)
    return discovery.load_manifest(spark, place, schema).unionByName(discovery.load_manifest(spark, place + "-none", schema))


@R.add("s18_resources", "SELECT user_id % 4 AS gpu, count(*) AS samples, round(avg(value), 6) AS util, round(max(value * 2), 6) AS used FROM events GROUP BY 1")
def s18_resources(spark, d) -> DataFrame:
    """Resource samples written as JSON lines and read with their fixed schema."""
    place = scratch(spark)
    gpu = F.struct((F.col("user_id") % 4).cast("int").alias("id"), F.col("value").alias("util"))
    table(spark, d, "events").select(F.col("event_id").cast("double").alias("t"), "value", F.struct((F.col("value") * 2).alias("used_mib")).alias("mem"), F.array(gpu).alias("gpus")).write.json(place)
    read = spark.read.schema(discovery.RESOURCES).json(place).select("mem.used_mib", F.explode("gpus").alias("g"))
    return read.groupBy(F.col("g.id").cast("long").alias("gpu")).agg(F.count(F.lit(1)).alias("samples"), F.round(F.avg("g.util"), 6).alias("util"), F.round(F.max("used_mib"), 6).alias("used"))


@R.add("s20_cameras", "SELECT n_nationkey::DOUBLE AS first, 9 AS intrinsics, 12 AS extrinsics, NULL::VARCHAR AS error FROM nation UNION ALL SELECT NULL, NULL, NULL, '3 bytes'")
def s20_cameras(spark, d) -> DataFrame:
    """Binary camera files, a broken one among them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(scratch(spark))
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    contents = [(r["n_nationkey"], struct.pack("<f21d", CAMERA_TAG, r["n_nationkey"], *range(20))) for r in collect_small(table(spark, d, "nation"))]
    for name, content in [*contents, ("broken", b"abc")]:  # as many small files as there are nations
        out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(where, f"{name}.cam"))
        out.write(bytearray(content))
        out.close()
    c = camera_files(spark, where.toString())
    return c.select(F.get("intrinsics", F.lit(0)).alias("first"), F.when(F.col("error").isNull(), F.size("intrinsics")).alias("intrinsics"), F.when(F.col("error").isNull(), F.size("extrinsics")).alias("extrinsics"), "error")


@R.add("s21_bundles", r"SELECT regexp_replace(file_path, '-r[0-9]+\.', '.') AS key, arg_max(file_path, (coalesce(TRY_CAST(regexp_extract(file_path, '-r([0-9]+)\.', 1) AS INT), 0), file_path)) AS path FROM data_files GROUP BY 1")
def s21_bundles(spark, d) -> DataFrame:
    return discovery.bundles(table(spark, d, "data_files"), "file_path", F.regexp_replace("file_path", r"-r[0-9]+\.", "."))


@R.add("s23_frame_references", "SELECT file_path, frame, round(frame / 30.0, 6) AS seconds FROM (SELECT file_path, unnest(generate_series(frame_from, frame_to)) AS frame FROM data_files WHERE kind = 'video' AND frame_to >= frame_from)")
def s23_frame_references(spark, d) -> DataFrame:
    return discovery.frame_references(table(spark, d, "data_files").filter("kind = 'video'"), "file_path", "frame_from", "frame_to")


@R.add("s25_adapters", f"""SELECT 'predicted' AS dataset, seq_id, count(*) AS frames FROM {NEWEST} GROUP BY seq_id
UNION ALL SELECT 'annotated', seq_id, count(DISTINCT frame) FROM gtsequence GROUP BY seq_id UNION ALL SELECT 'recorded', concat(lower(trim(source)), '-', source_dataset_index), count(*) FROM sample_manifest WHERE source IS NOT NULL AND source_dataset_index IS NOT NULL GROUP BY 2""")
def s25_adapters(spark, d) -> DataFrame:
    """Loaders of three datasets behind one contract: ``dataset, seq_id, frame``."""
    adapters = {
        "predicted": lambda: newest(spark, d, "source").select("seq_id", "frame"),
        "annotated": lambda: table(spark, d, "gtsequence").select("seq_id", "frame").distinct(),
        "recorded": lambda: table(spark, d, "sample_manifest").dropna(subset=["source", "source_dataset_index"]).select(F.concat(F.lower(F.trim("source")), F.lit("-"), F.col("source_dataset_index").cast("string")).alias("seq_id"), F.col("source_frame_start").alias("frame")),
    }
    out = None
    for name, load in adapters.items():
        rows = load().select(F.lit(name).alias("dataset"), "seq_id", "frame")
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("dataset", "seq_id").agg(F.count(F.lit(1)).alias("frames"))


@R.add("s30_adapter_status", "SELECT unnest(['annotated', 'predicted', 'recorded', 'depth_maps', 'stereo']) AS dataset, unnest([true, true, true, false, false]) AS implemented")
def s30_adapter_status(spark, d) -> DataFrame:
    """Datasets that are known but have no loader yet are listed as not implemented."""
    known = {"annotated": True, "predicted": True, "recorded": True, "depth_maps": False, "stereo": False}
    return spark.createDataFrame(list(known.items()), "dataset STRING, implemented BOOLEAN")


@R.add("k02_bounded_append", """WITH a AS (SELECT kind, size_bytes, CASE WHEN file_id % 2 = 0 THEN 0 ELSE 1 END AS turn, sum(size_bytes) OVER (PARTITION BY kind ORDER BY CASE WHEN file_id % 2 = 0 THEN 0 ELSE 1 END, file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM data_files WHERE size_bytes IS NOT NULL AND kind IS NOT NULL)
SELECT kind, coalesce(before, 0)::BIGINT // 20000 AS file_no, count(*) AS rows, sum(size_bytes)::BIGINT AS bytes FROM a GROUP BY 1, 2""")
def k02_bounded_append(spark, d) -> DataFrame:
    """Two appends to files of 20,000 bytes; the second goes on in the room that the first left."""
    place = scratch(spark)
    f = table(spark, d, "data_files").filter("size_bytes IS NOT NULL AND kind IS NOT NULL").select("kind", "file_id", "size_bytes")
    for turn in (0, 1):
        stores.append_bounded(f.filter(F.col("file_id") % 2 == turn), place, "kind", "size_bytes", ["file_id"], 20_000)
    return spark.read.parquet(place).groupBy("kind", "file_no").agg(F.count(F.lit(1)).alias("rows"), F.sum("size_bytes").alias("bytes"))


@R.add("k03_control_file", "SELECT event_type AS name, count(*) AS n FROM events GROUP BY 1")
def k03_control_file(spark, d) -> DataFrame:
    """Counts as a small control file of the driver, written aside and renamed, and read back."""
    import json
    import os
    import tempfile

    counts = {r["event_type"]: r["n"] for r in collect_small(table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")))}
    with tempfile.TemporaryDirectory() as place:  # the driver's own control file, not data of the cluster
        path = os.path.join(place, "state.json")
        write_control_file(path, {})
        write_control_file(path, counts)
        with open(path, encoding="utf-8") as f:
            return spark.createDataFrame(list(json.load(f).items()), "name STRING, n BIGINT")


@R.add("k09_sidecars", "SELECT episode_index, length, coalesce(len(tasks), -1) AS tasks, coalesce(len(atomic_segments), -1) AS segments FROM episodes")
def k09_sidecars(spark, d) -> DataFrame:
    place = scratch(spark)
    stores.write_sidecars(table(spark, d, "episodes").select("episode_index", "length", "tasks", "atomic_segments"), "episode_index", place)
    e = F.from_json("json", "length BIGINT, tasks ARRAY<STRING>, atomic_segments ARRAY<STRUCT<start_frame: BIGINT>>")
    return spark.read.parquet(place).select("episode_index", e.alias("e")).select("episode_index", "e.length", F.coalesce(F.size("e.tasks"), F.lit(-1)).alias("tasks"), F.coalesce(F.size("e.atomic_segments"), F.lit(-1)).alias("segments"))


@R.add("k12_arrays", f"SELECT seq_id, frame // 500 AS piece, count(*) AS n, round(sum(x), 3) + 0.0 AS x, round(arg_min(x, frame), 6) AS first FROM {FR} GROUP BY 1, 2")
def k12_arrays(spark, d) -> DataFrame:
    place = scratch(spark)
    stores.write_arrays(base.load(spark, d, "FRAMES").select("seq_id", "frame", "x"), ["seq_id"], "frame", ["x"], 500, place)
    return spark.read.parquet(place).select("seq_id", "piece", F.size("x").cast("long").alias("n"), (F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v), 3) + 0.0).alias("x"), F.round(F.get("x", F.lit(0)), 6).alias("first"))


@R.add("f28_options", "SELECT unnest(['datasets', 'end', 'start']) AS name, unnest(['a,b', '90', '10']) AS value")
def f28_options(spark, d) -> DataFrame:
    given = {"start": 10.0, "datasets": [" b", "a", "b"], "end": 90}
    canonical = discovery.canonical_options(given, {"start": int, "end": int, "datasets": list, "split": str})
    return spark.createDataFrame([(k, ",".join(v) if isinstance(v, list) else str(v)) for k, v in canonical.items()], "name STRING, value STRING")


@R.add("f29_micro_batches", "SELECT count(*) AS items, sum(size_bytes)::BIGINT AS bytes, true AS within FROM data_files WHERE size_bytes IS NOT NULL")
def f29_micro_batches(spark, d) -> DataFrame:
    b = discovery.micro_batches(table(spark, d, "data_files").filter("size_bytes IS NOT NULL"), "size_bytes", 50_000)
    return b.agg(F.sum("items").alias("items"), F.sum("bytes").alias("bytes"), F.bool_and((F.col("bytes") <= 50_000) | (F.col("items") == 1)).alias("within"))


@R.add("g06_merged_paths", "SELECT episode_index, n, concat(folder, '/', name, '_', episode_index, '.json') AS path FROM episodes, (SELECT row_number() OVER () - 1 AS n, folder, name FROM (SELECT unnest(['merged', 'labels']) AS folder) CROSS JOIN (SELECT unnest(['merged', 'actions', 'tasks']) AS name) ORDER BY folder DESC, name = 'merged' DESC, name)")
def g06_merged_paths(spark, d) -> DataFrame:
    """Ordered candidates of each episode's merged labels."""
    names = [f"{f}/{n}" for f in ("merged", "labels") for n in ("merged", "actions", "tasks")]
    return table(spark, d, "episodes").select("episode_index", F.posexplode(F.array(*[F.concat(F.lit(n + "_"), F.col("episode_index").cast("string"), F.lit(".json")) for n in names])).alias("n", "path")).withColumn("n", F.col("n").cast("long"))


@R.add("g21_component_cache", "SELECT 'same' AS signature, true AS cached, count(*) AS n FROM episodes UNION ALL SELECT 'other', false, count(*) FROM episodes")
def g21_component_cache(spark, d) -> DataFrame:
    place, e = scratch(spark), table(spark, d, "episodes").select("episode_index")
    discovery.cached_component(spark, place, "set", "episodes", "same", lambda: e)
    out = None
    for signature in ("same", "other"):
        rows, hit = discovery.cached_component(spark, place, "set", "episodes", signature, lambda: e)
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(signature).alias("signature"), F.lit(hit).alias("cached"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@R.add("g39_monitor_rates", """SELECT user_id, event_id, round(greatest(0, value - lag(value) OVER w) / nullif(epoch(ts) - epoch(lag(ts) OVER w), 0), 6) AS rate FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def g39_monitor_rates(spark, d) -> DataFrame:
    """Rates of a monitor's counters; a counter that fell was reset and gives zero."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / 1e6
    e = table(spark, d, "events").withColumn("s", seconds).withColumn("v", F.lag("value").over(w)).withColumn("b", F.lag("s").over(w))
    rate = F.when(F.col("v").isNotNull(), F.greatest(F.lit(0.0), F.col("value") - F.col("v")) / F.nullif(F.col("s") - F.col("b"), F.lit(0.0)))
    return e.select("user_id", "event_id", F.round(rate, 6).alias("rate"))


@R.add("g40_progress", "SELECT user_id, done, total, round(done / total::DOUBLE, 6) AS share, round(CASE WHEN done > 0 THEN elapsed / done * (total - done) END, 3) AS eta FROM (SELECT user_id, count(*) FILTER (WHERE value >= 12) AS done, count(*) AS total, epoch(max(ts)) - epoch(min(ts)) AS elapsed FROM events GROUP BY user_id)")
def g40_progress(spark, d) -> DataFrame:
    """Share done and time left at the pace so far."""
    s = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / 1e6
    g = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("value") >= 12).alias("done"), F.count(F.lit(1)).alias("total"), (F.max(s) - F.min(s)).alias("elapsed"))
    left = F.when(F.col("done") > 0, F.col("elapsed") / F.col("done") * (F.col("total") - F.col("done")))
    return g.select("user_id", "done", "total", F.round(F.col("done") / F.col("total"), 6).alias("share"), F.round(left, 3).alias("eta"))


_ROOTS = "SELECT o_orderkey, concat('/data/set_', o_custkey % 5) AS source, concat('/data/set_', o_orderkey % 5, CASE o_orderkey % 3 WHEN 0 THEN '/out' WHEN 1 THEN '/' ELSE '_out' END) AS target FROM orders"


@R.add("g41_safe_roots", f"SELECT o_orderkey, NOT starts_with(concat(rtrim(target, '/'), '/'), concat(source, '/')) AND NOT starts_with(concat(source, '/'), concat(rtrim(target, '/'), '/')) AS safe FROM ({_ROOTS})")
def g41_safe_roots(spark, d) -> DataFrame:
    r = spark.sql(_ROOTS.replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders"))
    return r.select("o_orderkey", discovery.safe_root(F.col("source"), F.col("target")).alias("safe"))


@R.add("g42_doctor", "SELECT unnest(['module numpy', 'module pyarrow', 'module no_such_module', 'session']) AS name, unnest([true, true, false, true]) AS ok")
def g42_doctor(spark, d) -> DataFrame:
    return discovery.environment(spark, ["numpy", "pyarrow", "no_such_module"]).filter("name <> 'checkpoint folder'").select("name", "ok")


@R.add("o08_dataset_seed", "SELECT n_name, ('0x' || substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::UBIGINT::VARCHAR AS seed FROM (SELECT n_name, sha256(concat('42:', n_name)) AS h FROM nation)")
def o08_dataset_seed(spark, d) -> DataFrame:
    """Seed of each dataset's name; the driver's helper and the column give the same numbers."""
    h = F.sha2(F.concat(F.lit("42:"), "n_name"), 256)
    seed = F.conv(F.concat(*[F.substring(h, i, 2) for i in range(15, 0, -2)]), 16, 10)
    n = table(spark, d, "nation").select("n_name", seed.alias("seed"))
    first = n.first()
    if first is not None and str(dataset_seed(42, first["n_name"])) != first["seed"]:
        raise ValueError("the two forms of the seed differ")
    return n


@R.add("m16_camera_moving", f"SELECT seq_id, round(avg(step), 6) AS flow, avg(step) >= 0.01 AS moving FROM (SELECT seq_id, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2) AS step FROM {FR} WINDOW w AS (PARTITION BY seq_id ORDER BY frame)) GROUP BY seq_id HAVING count(step) > 0")
def m16_camera_moving(spark, d) -> DataFrame:
    """Whether a camera moves: mean way of its position from frame to frame against a threshold."""
    from pyspark.sql import Window

    w = Window.partitionBy("seq_id").orderBy("frame")
    step = F.sqrt(sum((F.pow(F.col(c) - F.lag(c).over(w), 2) for c in "xyz"), F.lit(0.0)))
    s = base.load(spark, d, "FRAMES").select("seq_id", step.alias("step")).groupBy("seq_id").agg(F.avg("step").alias("flow"))
    return s.filter("flow IS NOT NULL").select("seq_id", F.round("flow", 6).alias("flow"), (F.col("flow") >= 0.01).alias("moving"))


def _arrivals(spark, d, files: int = 4) -> tuple[str, DataFrame]:
    place, e = scratch(spark), table(spark, d, "events")
    e.repartitionByRange(files, "event_id").write.parquet(place)
    return place, e


@R.add("t09_back_pressure", "SELECT count(*) AS n, true AS in_several FROM events")
def t09_back_pressure(spark, d) -> DataFrame:
    """A batch takes one file at most, whatever lies in the folder."""
    place, e = _arrivals(spark, d)
    sizes = []
    streams.run_to_end(streams.watch(spark, place, e.schema, files_per_batch=1), each=lambda batch, number: sizes.append(batch.count()))
    return spark.createDataFrame([(sum(sizes), len(sizes) > 1)], "n BIGINT, in_several BOOLEAN")


@R.add("t11_end_of_stream", "SELECT count(*) AS n, true AS ended FROM events")
def t11_end_of_stream(spark, d) -> DataFrame:
    """A stream that ends by itself once everything that is there was processed."""
    place, e = _arrivals(spark, d, 2)
    out = streams.run_to_end(streams.watch(spark, place, e.schema).select("event_id"))
    return out.agg(F.count(F.lit(1)).alias("n")).withColumn("ended", F.lit(not spark.streams.active))


@R.add("t14_debounced_save", "SELECT user_id, max(event_id) AS event_id, true AS fewer FROM events GROUP BY user_id")
def t14_debounced_save(spark, d) -> DataFrame:
    """State of each user after every batch, saved once in a while and at the end."""
    place, e = _arrivals(spark, d)
    out, ticks, state = scratch(spark), iter(range(0, 1_000_000, 10)), {"batches": 0, "df": None}
    versions = []

    def save(df: DataFrame) -> None:
        versions.append(f"{out}/{len(versions)}")
        df.write.parquet(versions[-1])

    saver = stores.DebouncedSave(save, 30.0, lambda: next(ticks))

    def each(batch: DataFrame, number: int) -> None:
        new = batch.select("user_id", "event_id") if state["df"] is None else state["df"].unionByName(batch.select("user_id", "event_id"))
        state["df"] = checkpoint(new.groupBy("user_id").agg(F.max("event_id").alias("event_id")))
        state["batches"] += 1
        saver(state["df"])

    streams.run_to_end(streams.watch(spark, place, e.schema, files_per_batch=1), each=each)
    saver.flush()
    return spark.read.parquet(versions[-1]).withColumn("fewer", F.lit(saver.saves <= state["batches"]))


@R.add("t17_cancellation", "SELECT true AS cancelled, 3::BIGINT AS after")
def t17_cancellation(spark, d) -> DataFrame:
    """A running job is stopped through its tag; the session goes on."""
    import threading
    import time

    failed = []

    sc, tag = spark.sparkContext, "frameloom-cancel"

    def work() -> None:
        sc.addJobTag(tag)
        try:
            spark.range(0, 1 << 40, 1, 4).selectExpr("sum(pow(id, 1.5) % 7)").collect()  # would take hours
        except Exception:
            failed.append(True)
        finally:
            sc.clearJobTags()

    t = threading.Thread(target=work)
    t.start()
    for _ in range(100):
        time.sleep(0.2)
        sc.cancelJobsWithTag(tag)
        if not t.is_alive():
            break
    t.join(60)
    return spark.createDataFrame([(bool(failed), spark.range(3).count())], "cancelled BOOLEAN, after BIGINT")
