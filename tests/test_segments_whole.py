"""Queries whose SQL states a part of the rows only: brute force over all rows."""

import math

import duckdb
from compare import DATA

from frameloom.plans import base, catalogue

Q = catalogue.core().queries


def media():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{DATA}/lineitem.parquet'")
    return con.execute(f"SELECT media_id, max(duration_sec)::DOUBLE FROM {base.sql('MEDIA')} GROUP BY media_id").fetchall()


def brute_segments(duration):
    if duration is None or duration <= 0:
        return []
    full = math.floor((duration + 0.5) / 600)
    n = full + (duration - full * 600 >= 1 or full == 0)
    return [(k, k * 600.0, min((k + 1) * 600.0, duration)) for k in range(n)]


def brute_status(media_id, duration):
    want = brute_segments(duration)
    k = media_id % 23
    got = [s for s in want if k != 1 and (k != 2 or s[0] > 0)]
    if media_id % 101 == 0 or not want:
        return "probe_src"
    if not got:
        return "miss"
    if len(got) < len(want):
        return "seg_miss"
    if k == 8:
        return "probe_out"
    frames = math.floor(duration * 30)
    if abs(sum(math.floor((b - a) * 30) + 900 * (k == 4) for _, a, b in got) - frames) > max(5, frames * 0.01):
        return "frames"
    if abs(sum(b - a + 30 * (k == 5) for _, a, b in got) - duration) > max(1, duration * 0.01):
        return "duration"
    return {6: "fps", 7: "resolution"}.get(k, "ok")


def test_segments_of_all_media(spark):
    rows = media()
    want = sorted((m, k, a, round(b, 6)) for m, d in rows for k, a, b in brute_segments(d))
    got = sorted((r["media_id"], r["segment"], r["start"], r["stop"]) for r in Q["c30_expected_segments"](spark, DATA).collect())
    assert got == want
    assert len({m % 7 for m, *_ in got}) == 7 and any(d is not None and d <= 100 for _, d in rows)


def test_every_media_row_gets_a_status(spark):
    got = {r["media_id"]: r["status"] for r in Q["f15_verify_segments"](spark, DATA).collect()}
    assert got == {m: brute_status(m, d) for m, d in media()}
