"""Duration labels of seconds, minutes and hours: brute force over all media rows."""

from collections import Counter

import duckdb
from compare import DATA

from frameloom.plans import base, catalogue

Q = catalogue.core().queries


def short_label(s):
    return f"{s:.1f}s" if s < 60 else f"{s / 60:.1f}m" if s < 3600 else f"{s / 3600:.1f}h"


def test_short_labels_of_all_durations(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{DATA}/lineitem.parquet'")
    rows = con.execute(f"SELECT media_id, floor(duration_sec * 2)::DOUBLE / 2 FROM {base.sql('MEDIA')} WHERE duration_sec IS NOT NULL").fetchall()
    got = Counter(map(tuple, Q["c09_short_duration"](spark, DATA).collect()))
    assert got == Counter((m, short_label(s)) for m, s in rows)
    assert {label[-1] for _, label in got} == set("smh")


def test_short_labels_on_every_half_second(spark, monkeypatch):
    halves = spark.range(0, 20000).selectExpr("id AS media_id", "id / 2D AS duration_sec")
    monkeypatch.setattr(base, "load", lambda *_: halves)
    got = {r["media_id"]: r["label"] for r in Q["c09_short_duration"](spark, DATA).collect()}
    assert got == {k: short_label(k / 2) for k in range(20000)}
