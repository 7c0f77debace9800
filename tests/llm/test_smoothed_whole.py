"""Near-identical events of all tracks, with their durations."""

from compare import DATA

from frameloom.llm import queries


def test_smoothed_covers_what_the_exact_events_cover(spark):
    exact, smooth = (queries.R.queries[q](spark, DATA).toPandas() for q in ("p5_events", "p5_smoothed"))
    assert set(smooth["track"]) == {"pred_left", "pred_right", "gt"}
    assert (smooth.groupby("track")["n_frames"].sum() == exact.groupby("track")["n_frames"].sum()).all()
    assert 0 < len(smooth) < len(exact)
    spf = (exact["duration_sec"] / exact["n_frames"]).groupby(exact["seq_id"]).median()
    timed = smooth[smooth["duration_sec"].notna()]
    assert len(timed) and (timed["duration_sec"] - timed["n_frames"] * timed["seq_id"].map(spf)).abs().max() < 1e-3
