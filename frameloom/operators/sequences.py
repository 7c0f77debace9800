"""Clips, runs, gaps, differences and outliers of frame sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tumbling_clips(df: DataFrame, keys: list[str], fps: str, total: str, duration: float, overlap: float = 0.0, short_tail: float = 0.0) -> DataFrame:
    """``keys, clip_idx, start, stop`` of clips of ``duration`` seconds with an overlap, over [0, total) frames.

    Bounds are whole frames, truncated; no clip begins after one has reached the end. A last clip shorter than
    ``short_tail`` seconds is left out unless it is the only one. Rows without frames or rate give no clip.
    """
    size = F.greatest(F.lit(1), F.floor(F.col(fps) * duration)).cast("long")
    stride = F.greatest(F.lit(1), size - F.floor(F.col(fps) * overlap)).cast("long")
    n = F.col(total).cast("long")
    last = F.greatest(F.lit(0), F.ceil((n - size) / stride)).cast("long")
    plan = df.filter((n > 0) & (F.col(fps) > 0)).select(*keys, n.alias("_n"), size.alias("_size"), stride.alias("_stride"), F.col(fps).alias("_fps"), last.alias("_last"))
    clips = plan.select("*", F.explode(F.sequence(F.lit(0).cast("long"), "_last")).alias("clip_idx"))
    start = F.col("clip_idx") * F.col("_stride")
    stop = F.least(start + F.col("_size"), F.col("_n"))
    keep = (F.col("clip_idx") == 0) | (F.col("clip_idx") < F.col("_last")) | ((stop - start) >= F.col("_fps") * short_tail)
    return clips.filter(keep).select(*keys, "clip_idx", start.alias("start"), stop.alias("stop"))


def training_clips(df: DataFrame, keys: list[str], length: str, clip: int, stride: int) -> DataFrame:
    """Starts 0, stride, ... of whole clips; the tail is dropped and no clip crosses an episode."""
    whole = df.filter(F.col(length) >= clip)
    return whole.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col(length).cast("long") - clip, F.lit(stride).cast("long"))).alias("start")).withColumn("stop", F.col("start") + clip)


def covering_windows(df: DataFrame, keys: list[str], length: str, size: int, overlap: int) -> DataFrame:
    """Windows that cover every frame; the last is moved left so that it is full where the sequence allows it."""
    n, step = F.col(length).cast("long"), size - overlap
    last = F.greatest(F.lit(0).cast("long"), n - size)
    starts = F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), F.ceil(last / step).cast("long")), lambda i: F.least(i * step, last)))
    return df.filter(n > 0).select(*keys, n.alias("_n"), F.explode(starts).alias("start")).select(*keys, "start", F.least(F.col("start") + size, F.col("_n")).alias("stop"))


def islands(df: DataFrame, keys: list[str], position: str, state: list[str] | None = None) -> DataFrame:
    """``keys, state, first, last, n`` of maximal runs of consecutive positions with equal state.

    Positions must be distinct inside ``keys``. The sort is by key; an entity of any size is streamed with spilling.
    """
    state = state or []
    w = Window.partitionBy(*keys, *state).orderBy(position)
    marked = df.withColumn("_isle", F.col(position) - F.row_number().over(w))
    return marked.groupBy(*keys, *state, "_isle").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count(F.lit(1)).alias("n")).drop("_isle")


def keep_segments(df: DataFrame, keys: list[str], position: str, cut: Column, fps: float, min_absent: float, min_segment: float) -> DataFrame:
    """Seconds [start, stop) to keep: the complement of cuts, each a run of cut samples of at least ``min_absent`` seconds.

    Kept pieces shorter than ``min_segment`` seconds are left out, also where nothing was cut.
    """
    least = max(1, int(min_absent * fps))
    runs = islands(df.withColumn("_cut", cut), keys, position, ["_cut"]).filter(F.col("_cut") & (F.col("n") >= least))
    ends = df.groupBy(*keys).agg((F.max(position) + 1).alias("_total"))
    edges = runs.select(*keys, F.col("first").alias("a"), (F.col("last") + 1).alias("b")).unionByName(ends.select(*keys, F.col("_total").alias("a"), F.col("_total").alias("b")))
    before = F.coalesce(F.lag("b").over(Window.partitionBy(*keys).orderBy("a", "b")), F.lit(0))
    kept = edges.withColumn("start", before).select(*keys, (F.col("start") / fps).alias("start"), (F.col("a") / fps).alias("stop"))
    return kept.filter((F.col("stop") - F.col("start") >= min_segment) & (F.col("stop") > F.col("start")))


def steps(df: DataFrame, keys: list[str], position: str, columns: list[str]) -> DataFrame:
    """Adds ``gap`` to the previous row and ``speed``: the Euclidean step of the columns divided by the gap."""
    w = Window.partitionBy(*keys).orderBy(position)
    gap = F.col(position) - F.lag(position).over(w)
    square = sum((F.pow(F.col(c) - F.lag(c).over(w), 2) for c in columns), F.lit(0.0))
    return df.withColumn("gap", gap).withColumn("speed", F.sqrt(square) / F.col("gap"))


def second_difference(column: str, w) -> Column:
    return F.lead(column).over(w) - 2 * F.col(column) + F.lag(column).over(w)


def robust_limits(df: DataFrame, keys: list[str], column: str, k: float, floor: float) -> DataFrame:
    """``keys, n, med, mad, limit``: limit = max(floor, median + k * 1.4826 * MAD)."""
    med = df.groupBy(*keys).agg(F.percentile(column, F.lit(0.5)).alias("med"), F.count(column).alias("n"))
    mad = df.join(med, keys).groupBy(*keys, "med", "n").agg(F.percentile(F.abs(F.col(column) - F.col("med")), F.lit(0.5)).alias("mad"))
    return mad.withColumn("limit", F.greatest(F.lit(floor), F.col("med") + k * 1.4826 * F.col("mad")))


def hampel(df: DataFrame, keys: list[str], position: str, columns: list[str], k: float = 3.0, floor: float = 0.1, least: int = 5) -> DataFrame:
    """Rows with ``speed`` and ``spike``. A row inside is a spike if both steps next to it are big; the first and last
    row if their one step is big and the next one isn't. Entities with fewer than ``least`` rows have none."""
    s = steps(df, keys, position, columns)
    limits = robust_limits(s.filter("speed IS NOT NULL"), keys, "speed", k, floor).select(*keys, "limit", "n")
    w = Window.partitionBy(*keys).orderBy(position)
    j = s.join(limits, keys, "left").withColumn("big", F.coalesce((F.col("speed") > F.col("limit")) & (F.col("n") + 1 >= least), F.lit(False)))
    nxt, nxt2, prev = F.lead("big").over(w), F.lead("big", 2).over(w), F.lag("big").over(w)
    first = F.lag(position).over(w).isNull()
    spike = F.when(first, nxt & ~F.coalesce(nxt2, F.lit(False))).when(nxt.isNull(), F.col("big") & ~F.coalesce(prev, F.lit(False))).otherwise(F.col("big") & nxt)
    return j.withColumn("spike", F.coalesce(spike, F.lit(False))).drop("big", "limit", "n")


def fill_gaps(df: DataFrame, keys: list[str], position: str, columns: list[str], max_gap: int) -> DataFrame:
    """Adds rows for missing positions between two rows that lack at most ``max_gap``, interpolated linearly; ``filled``
    marks them. Gaps at an entity's ends stay."""
    w = Window.partitionBy(*keys).orderBy(position)
    nxt = df.withColumn("_next", F.lead(position).over(w))
    for c in columns:
        nxt = nxt.withColumn(f"_n_{c}", F.lead(c).over(w))
    missing = F.col("_next") - F.col(position) - 1
    upto = F.when((missing > 0) & (missing <= max_gap), F.col("_next") - 1).otherwise(F.col(position))
    rows = nxt.withColumn("_p", F.explode(F.sequence(F.col(position), upto)))
    share = (F.col("_p") - F.col(position)) / (F.col("_next") - F.col(position))
    out = [F.when(F.col("_p") == F.col(position), F.col(c)).otherwise(F.col(c) + (F.col(f"_n_{c}") - F.col(c)) * share).alias(c) for c in columns]
    return rows.select(*keys, F.col("_p").alias(position), *out, (F.col("_p") != F.col(position)).alias("filled"))


def nearest_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, columns: list[str]) -> DataFrame:
    """Each left row with ``columns`` and ``gap`` of the right row of its key nearest in ``at``; on ties the earlier one.

    As-of both ways: one sort of the union by key carries the last right row forward and the next one back, so that no
    pairs are formed. ``at`` is a number. Left rows of a key without right rows get nulls.
    """
    r = right.select(*keys, F.col(at).alias("_at"), F.struct(F.col(at).alias("_at"), *columns).alias("_r")).withColumn("_side", F.lit(0))
    lrows = left.select(*keys, F.col(at).alias("_at"), F.struct(*[c for c in left.columns]).alias("_l")).withColumn("_side", F.lit(1))
    both = lrows.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_at", "_side")
    prev = F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    nxt = F.first("_r", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    found = both.withColumn("_prev", prev).withColumn("_nxt", nxt).filter("_side = 1")
    # rows at the very time of a right row come after it, so an exact match is always the previous one
    back, ahead = F.col("_at") - F.col("_prev._at"), F.col("_nxt._at") - F.col("_at")
    pick = F.when(F.col("_prev").isNull(), F.col("_nxt")).when(F.col("_nxt").isNull() | (back <= ahead), F.col("_prev")).otherwise(F.col("_nxt"))
    out = found.withColumn("_pick", pick)
    return out.select("_l.*", *[F.col(f"_pick.{c}").alias(c) for c in columns], F.abs(F.col("_pick._at") - F.col("_at")).alias("gap"))


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, stop: str, width: float) -> DataFrame:
    """Points inside intervals of their key, both ends included.

    Range join by buckets of ``width``: an interval is listed in each bucket it touches, a point in its own, so that
    the join is an equi-join on (key, bucket). Choose a width about as long as the usual interval.
    """
    bucket = lambda c: F.floor(c / width).cast("long")
    spread = intervals.filter(F.col(stop) >= F.col(start)).withColumn("_b", F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(stop)))))
    return points.withColumn("_b", bucket(F.col(at))).join(spread, [*keys, "_b"]).filter(F.col(at).between(F.col(start), F.col(stop))).drop("_b")


def block_spikes(df: DataFrame, key: str, order: str, pose: str, jump: float = 0.15, turn: float = 45.0, max_block: int = 15, recovery: float = 0.15) -> DataFrame:
    """``key, order`` of the readings between two neighbouring leaps, at most ``max_block``, where the second leads back to
    within ``recovery`` of where the first left; entities of fewer than four readings have none.

    ``pose`` is a row-major 4x4 matrix. A leap is a step of more than ``jump`` or a turn of more than ``turn`` degrees for
    each frame between. A greedy scan only ever goes from a leap to the next one, so neighbouring leaps are all it needs.
    """
    at = lambda c, i: F.get(c, F.lit(i)).cast("double")
    way = lambda a, b: F.sqrt(sum((F.pow(at(a, i) - at(b, i), 2) for i in (3, 7, 11)), F.lit(0.0)))
    s = df.select(F.col(key).alias("_k"), F.col(order).alias("_o"), F.col(pose).alias("_e"))
    v = Window.partitionBy("_k").orderBy("_o")
    s = s.withColumns({"_n": F.row_number().over(v), "_all": F.count(F.lit(1)).over(Window.partitionBy("_k")), "_b": F.lag("_e").over(v), "_gap": F.col("_o") - F.lag("_o").over(v)})
    trace = sum((at("_e", i) * at("_b", i) for i in (0, 1, 2, 4, 5, 6, 8, 9, 10)), F.lit(0.0))
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2))))
    leaps = s.filter("_b IS NOT NULL AND _all >= 4").filter((way("_e", "_b") / F.col("_gap") > jump) | (angle / F.col("_gap") > turn))
    pairs = leaps.withColumns({"_next": F.lead("_n").over(v), "_back": F.lead("_e").over(v)}).filter(F.col("_next") - F.col("_n") <= max_block).filter(way("_back", "_b") < recovery)
    bad = pairs.select(F.col("_k").alias("_key"), F.explode(F.sequence("_n", F.col("_next") - 1)).alias("_row")).distinct()
    return s.join(bad, (F.col("_k") == F.col("_key")) & (F.col("_n") == F.col("_row"))).select(F.col("_k").alias(key), F.col("_o").alias(order))
