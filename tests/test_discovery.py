"""Folders on disk, broken inputs and clocks."""

import json
import os

import pytest
from pyspark.sql import functions as F

from frameloom.sinks import stores
from frameloom.sources import discovery, files


def test_roots_on_disk(spark, tmp_path):
    for root in ("a", "a/inner", "b", "deep/er/c"):
        os.makedirs(tmp_path / root / "meta")
        os.makedirs(tmp_path / root / "data" / "chunk-0")
        (tmp_path / root / "meta" / "info.json").write_text("{}")
        (tmp_path / root / "data" / "chunk-0" / "f.parquet").write_text("x")
    os.makedirs(tmp_path / "no_data" / "meta")
    (tmp_path / "no_data" / "meta" / "info.json").write_text("{}")
    listing = files.inventory(spark, str(tmp_path), "*")
    found = {r["root"].split(tmp_path.name + "/", 1)[1] for r in discovery.dataset_roots(listing, "path").collect()}
    assert found == {"a", "b", "deep/er/c"}
    assert discovery.dataset_roots(listing.limit(0), "path").count() == 0


def test_labels_in_all_forms(spark):
    rows = [(1, '[{"a": 1}, {"a": 2}]'), (2, '{"a": 3}\n{"a": 4}\r\n{"a": '), (3, '{"a": 5}'), (4, ""), (5, None), (6, "[{"), (7, "nonsense")]
    got = discovery.json_or_lines(spark.createDataFrame(rows, "id INT, t STRING"), "t", "a BIGINT").select("id", "entry.a").collect()
    assert sorted(map(tuple, got)) == [(1, 1), (1, 2), (2, 3), (2, 4), (3, 5)]


def test_probe_of_missing_programs_and_bad_files(spark):
    def prober(path):
        if path == "slow":
            raise TimeoutError("30 s")
        return {"n": len(path)}

    got = discovery.probe(spark.createDataFrame([("ab",), ("slow",), ("",)], "p STRING"), "p", prober, "n BIGINT", ["n"]).collect()
    assert sorted((r["path"], r["ok"], r["error"], r["n"]) for r in got) == [("", True, None, 0), ("ab", True, None, 2), ("slow", False, "TimeoutError: 30 s", None)]
    one = discovery.probe(spark.createDataFrame([("/no/such.mp4",)], "p STRING"), "p", discovery.ffprobe, "duration_sec DOUBLE, streams INT", ["duration_sec", "streams"]).first()
    assert not one["ok"] and one["error"]


@pytest.mark.parametrize("bad", [{"what": 1}, {"start": 5, "end": 5}, {"start": -1}, {"start": "x"}, {"start": 1.5}, {"start": True}])
def test_options_that_are_refused(bad):
    with pytest.raises((ValueError, TypeError)):
        discovery.canonical_options(bad, {"start": int, "end": int})


def test_debounced_save(spark):
    now, saved = [0.0], []
    s = stores.DebouncedSave(saved.append, 30, lambda: now[0])
    a, b, c = (spark.range(i) for i in (1, 2, 3))
    assert s(a) and not s(b)
    now[0] = 29.0
    assert not s(c)
    now[0] = 31.0
    assert s(b)
    s.flush()
    assert saved == [a, b] and s.saves == 2
    assert not s(c)
    s.flush()
    assert saved[-1] is c


def test_bounded_append_continues_in_the_last_file(spark, tmp_path):
    place = str(tmp_path / "t")
    df = spark.range(10).select(F.lit("k").alias("kind"), "id", F.lit(10).alias("size"))
    stores.append_bounded(df.filter("id < 3"), place, "kind", "size", ["id"], 40)
    stores.append_bounded(df.filter("id >= 3"), place, "kind", "size", ["id"], 40)
    got = {r["id"]: r["file_no"] for r in spark.read.parquet(place).collect()}
    assert got == {i: i * 10 // 40 for i in range(10)}


def test_sidecar_keeps_nulls(spark, tmp_path):
    stores.write_sidecars(spark.createDataFrame([(1, None)], "id INT, tasks ARRAY<STRING>"), "id", str(tmp_path / "s"))
    assert json.loads(spark.read.parquet(str(tmp_path / "s")).first()["json"]) == {"id": 1, "tasks": None}


def test_safe_roots(spark):
    df = spark.createDataFrame([("/a", "/a/out"), ("/a", "/ab"), ("/a/", "/a"), ("/a/b", "/a"), ("/a", "/b")], "s STRING, t STRING")
    assert [r[0] for r in df.select(discovery.safe_root(F.col("s"), F.col("t"))).collect()] == [False, True, False, False, True]
