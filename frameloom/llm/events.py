"""Runs of identical or near-identical consecutive events, collapsed by optimal segmentation.

A track of an entity is a sequence of states at whole positions; a missing position or a null state ends whatever run
is open. Inside a stretch without such a break, the segmentation minimises the dissimilarity of each event to the
label of its segment plus ``penalty`` for each boundary. The dynamic program keeps one cost for each label and drops
every label that costs more than the best one plus a switch.

A run of n equal states whose relabelling costs more than twice the penalty keeps its label in every optimal
segmentation whatever lies around it. Entities are cut into blocks of positions, and every stretch of a block is solved
by the dynamic program. Where a stretch reaches over a block's border, only what lies between the last such certain run
before it and the first one after it is still open. Each block then tells what its open part costs for every label
that may stand before it and at its end; the labels at the borders follow from those small tables, and each open part
is solved between the labels at its borders. So no part ever holds more than a block, with certain runs or without.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.session import checkpoint

#: Positions in a block of an entity.
BLOCK = 4096

RUNS = "entity STRING, track STRING, block BIGINT, piece INT, lo BIGINT, hi BIGINT, fixed BOOLEAN, state INT, first BIGINT, last BIGINT, cost DOUBLE, moves ARRAY<DOUBLE>"
SEGMENTS = "entity STRING, track STRING, chain BIGINT, edge BOOLEAN, state INT, first BIGINT, last BIGINT, cost DOUBLE"


def unlike(states: int) -> np.ndarray:
    """Dissimilarity 0 of equal states and 1 of different ones."""
    return 1.0 - np.eye(states)


def _forward(state: np.ndarray, n: np.ndarray, fixed: np.ndarray, dissimilarity: np.ndarray, penalty: float, cost: list[float]) -> tuple[list[float], list[list[int]]]:
    """Least cost for each label of the last run, beginning with ``cost``, and for each run the label before each label."""
    rows, labels, back = dissimilarity.tolist(), range(len(dissimilarity)), []
    for s, m, f in zip(state.tolist(), n.tolist(), fixed.tolist(), strict=True):
        best = min(labels, key=cost.__getitem__)
        limit = cost[best] + penalty  # a label beyond it can't be better than a switch from the best one
        back.append([j if cost[j] <= limit else best for j in labels])
        cost = [min(cost[j], limit) + m * rows[s][j] if not f or j == s else math.inf for j in labels]
    return cost, back


def best_labels(state: np.ndarray, n: np.ndarray, fixed: np.ndarray, dissimilarity: np.ndarray, penalty: float, entry: int | None = None, leave: int | None = None) -> np.ndarray:
    """Label of each run under the least total cost; a fixed run keeps its state. Ties prefer no boundary, then the lower
    label. ``entry`` is the label before the first run, where there is one, ``leave`` that of the last run, where it is given."""
    start = [0.0] * len(dissimilarity) if entry is None else [0.0 if j == entry else math.inf for j in range(len(dissimilarity))]
    cost, back = _forward(state, n, fixed, dissimilarity, penalty, start)
    out, now = np.empty(len(state), np.int64), min(range(len(cost)), key=cost.__getitem__) if leave is None else leave
    for i in range(len(state) - 1, -1, -1):
        out[i] = now
        now = back[i][now]
    return out


def move_costs(state: np.ndarray, n: np.ndarray, fixed: np.ndarray, dissimilarity: np.ndarray, penalty: float) -> list[float]:
    """Least cost for each label of the last run: without a label before the first run, then after each label."""
    k = len(dissimilarity)
    starts = [[0.0] * k, *[[0.0 if j == i else math.inf for j in range(k)] for i in range(k)]]
    return [c for start in starts for c in _forward(state, n, fixed, dissimilarity, penalty, start)[0]]


def border_labels(moves: list[np.ndarray], k: int) -> list[int]:
    """Label at the end of each part of a chain, from what each part costs (:func:`move_costs`)."""
    cost, back = np.asarray(moves[0])[:k], []
    for m in moves[1:]:
        ways = cost[:, None] + np.asarray(m)[k:].reshape(k, k)
        back.append(ways.argmin(0))
        cost = ways.min(0)
    out = [int(cost.argmin())]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return out[::-1]


def _segments(run: dict[str, np.ndarray], dissimilarity: np.ndarray, penalty: float, entry: int | None = None, leave: int | None = None) -> dict[str, np.ndarray]:
    """Runs of one stretch, in order, joined to the segments of the best labels."""
    n = run["last"] - run["first"] + 1
    label = best_labels(run["state"], n, run["fixed"], dissimilarity, penalty, entry, leave)
    cost = np.where(run["fixed"], run["cost"], n * dissimilarity[run["state"], label])
    start = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
    return {"state": label[start], "first": run["first"][start], "last": run["last"][np.r_[start[1:] - 1, len(label) - 1]], "cost": np.add.reduceat(cost, start)}


def _runs_of(entity: np.ndarray, block: np.ndarray, pos: np.ndarray, state: np.ndarray, size: int, dissimilarity: np.ndarray, penalty: float) -> pd.DataFrame | None:
    """Final segments (piece 0) of whole blocks sorted by position, and the pieces that reach over a border (1 left, 2 right, 3 both)."""
    if not len(pos):
        return None
    stretch = np.r_[True, (entity[1:] != entity[:-1]) | (block[1:] != block[:-1]) | (pos[1:] != pos[:-1] + 1)]
    start = np.flatnonzero(stretch | np.r_[True, state[1:] != state[:-1]])
    end = np.r_[start[1:] - 1, len(pos) - 1]
    of = np.cumsum(stretch)[start]
    run = {"entity": entity[start], "block": block[start], "state": state[start], "first": pos[start], "last": pos[end], "cost": np.zeros(len(start))}
    gain = np.where(np.eye(len(dissimilarity), dtype=bool), np.inf, dissimilarity).min(1) if len(dissimilarity) > 1 else np.array([np.inf])
    n = run["last"] - run["first"] + 1
    sure = n * gain[run["state"]] > 2 * penalty
    run["fixed"] = np.zeros(len(start), bool)
    lo, hi = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), np.r_[np.flatnonzero(of[1:] != of[:-1]) + 1, len(of)]
    parts: list[dict[str, np.ndarray]] = []

    def open_part(one: dict[str, np.ndarray], at: slice, piece: int) -> None:
        part = {k: v[at] for k, v in one.items()}
        if len(part["first"]):
            parts.append(part | {"piece": np.full(len(part["first"]), piece)})

    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        one = {k: v[a:b] for k, v in run.items()}
        on_left, on_right = bool(one["first"][0] == one["block"][0] * size - 1), bool(one["last"][-1] == (one["block"][0] + 1) * size - 2)
        firm = np.flatnonzero(sure[a:b]) if on_left or on_right else ()
        x = (int(firm[0]) if len(firm) else b - a) if on_left else 0
        y = (int(firm[-1]) + 1 if len(firm) else 0) if on_right else b - a
        if x >= y:  # no certain run between the borders
            open_part(one, slice(None), on_left + 2 * on_right)
            continue
        mid = {k: one[k][x:y] for k in ("state", "first", "last", "cost", "fixed")}
        mid["fixed"] = mid["fixed"].copy()
        mid["fixed"][0] |= on_left
        mid["fixed"][-1] |= on_right
        done = _segments(mid, dissimilarity, penalty)
        m = len(done["state"])
        piece = np.zeros(m, np.int64)
        piece[0] += on_left
        piece[-1] += 2 * on_right
        both = m == 1 and on_left and on_right
        open_part(one, slice(0, x), 3 if both else 1)
        parts.append(done | {"entity": one["entity"][:1].repeat(m), "block": one["block"][:1].repeat(m), "fixed": np.full(m, True), "piece": piece})
        open_part(one, slice(y, None), 3 if both else 2)
    return pd.DataFrame({k: np.concatenate([p[k] for p in parts]) for k in (*run, "piece")})


def _moves(got: pd.DataFrame, dissimilarity: np.ndarray, penalty: float) -> list[list[float] | None]:
    """``move_costs`` of each open part, at its first row."""
    out: list[list[float] | None] = [None] * len(got)
    piece, entity, block = (got[c].to_numpy() for c in ("piece", "entity", "block"))
    at = np.flatnonzero(piece > 0)
    new = np.r_[True, (piece[at[1:]] != piece[at[:-1]]) | (entity[at[1:]] != entity[at[:-1]]) | (block[at[1:]] != block[at[:-1]])] if len(at) else []
    state, fixed, n = got["state"].to_numpy(), got["fixed"].to_numpy(), (got["last"] - got["first"] + 1).to_numpy()
    for rows in np.split(at, np.flatnonzero(new)[1:]) if len(at) else []:
        out[rows[0]] = move_costs(state[rows], n[rows], fixed[rows], dissimilarity, penalty)
    return out


def _level_one(tracks: list[str], size: int, dissimilarity: np.ndarray, penalty: float):
    schema = pa.schema([("entity", pa.string()), ("track", pa.string()), ("block", pa.int64()), ("piece", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64()), ("fixed", pa.bool_()), ("state", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("cost", pa.float64()), ("moves", pa.list_(pa.float64()))])

    def rows(table: pa.Table) -> Iterator[pa.RecordBatch]:
        names = table["entity"].combine_chunks().dictionary_encode()
        entity, words = names.indices.to_numpy(zero_copy_only=False), names.dictionary
        block, pos = table["block"].to_numpy(), table["pos"].to_numpy()
        for track in tracks:
            state = table[track].fill_null(-1).to_numpy()
            on = state >= 0
            got = _runs_of(entity[on], block[on], pos[on], state[on].astype(np.int64), size, dissimilarity, penalty)
            if got is None:
                continue
            piece = got["piece"].to_numpy()
            lo = pa.array(got["block"].to_numpy(), mask=(piece & 1) == 0)
            hi = pa.array(got["block"].to_numpy() + 1, mask=(piece & 2) == 0)
            cols = [words.take(pa.array(got["entity"].to_numpy())), pa.array([track] * len(got)), got["block"], got["piece"].astype(np.int32), lo, hi, got["fixed"], got["state"].astype(np.int32), got["first"], got["last"], got["cost"], pa.array(_moves(got, dissimilarity, penalty), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.to_numpy()) for c in cols], schema=schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            now = pa.concat_tables([rest, now]) if rest is not None else now
            last = (now["entity"][-1], now["block"][-1])
            cut = now.num_rows  # the last block may go on in the next batch; it has at most ``size`` rows
            while cut and now["block"][cut - 1] == last[1] and now["entity"][cut - 1] == last[0]:
                cut -= 1
            rest = now.slice(cut)
            if cut:
                yield from rows(now.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield from rows(rest)

    return scan


def collapse_runs(df: DataFrame, entity: str, position: str, tracks: list[str], penalty: float = 0.25, dissimilarity: np.ndarray | None = None, order: str | None = None, block: int = BLOCK) -> DataFrame:
    """``entity, track, state, first, last, cost`` of every segment of every track.

    ``tracks`` are columns of small whole states from 0 up, the indexes of ``dissimilarity`` (two states by default);
    a null or negative state ends a run. With the default dissimilarity and a penalty below 0.5, segments are exactly
    the maximal runs. Of several rows of one position the one with the highest ``order`` counts (null lowest; on ties
    the highest states). Rows with a null entity or position take no part. An empty input gives an empty result.
    """
    d = unlike(2) if dissimilarity is None else dissimilarity
    cols = [f"t{i}" for i in range(len(tracks))]
    rank = F.col(f"`{order}`") if order else F.lit(0)
    rows = df.select(
        F.col(f"`{entity}`").cast("string").alias("entity"), F.col(f"`{position}`").cast("long").alias("pos"), rank.alias("_o"),
        *[F.when(F.col(f"`{t}`") >= 0, F.col(f"`{t}`").cast("byte")).alias(c) for t, c in zip(tracks, cols, strict=True)],
    ).filter("entity IS NOT NULL AND pos IS NOT NULL")
    placed = rows.withColumn("block", F.expr(f"(pos + 1 - pmod(pos + 1, {block})) div {block}"))
    kept = placed.groupBy("entity", "block", "pos").agg(F.max(F.struct("_o", *cols)).alias("m")).select("entity", "block", "pos", *[F.col(f"m.{c}").alias(t) for t, c in zip(tracks, cols, strict=True)])
    sorted_ = kept.repartition("entity", "block").sortWithinPartitions("entity", "block", "pos")
    runs = checkpoint(sorted_.mapInArrow(_level_one(tracks, block, d, penalty), RUNS))

    final = runs.filter("piece = 0").select("entity", "track", "state", "first", "last", "cost")
    open_ = runs.filter("piece > 0")
    per = Window.partitionBy("entity", "track").orderBy("first")  # two or three rows for each block of an entity
    pieces = open_.groupBy("entity", "track", "block", "piece").agg(F.min("first").alias("first"), F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.max("moves").alias("moves"))
    chained = pieces.withColumn("joins", F.lag("hi").over(per).eqNullSafe(F.col("lo")) & F.col("lo").isNotNull()).withColumn("chain", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(per))

    def borders(one: pd.DataFrame) -> pd.DataFrame:
        one = one.sort_values("first")
        leave = border_labels(one["moves"].tolist(), len(d))
        return one.assign(entry=[-1, *leave[:-1]], leave=leave)[["entity", "track", "block", "piece", "chain", "entry", "leave"]].astype({"entry": "int32", "leave": "int32"})

    labels = chained.select("entity", "track", "block", "piece", "chain", "first", "moves").groupBy("entity", "track", "chain").applyInPandas(borders, "entity STRING, track STRING, block BIGINT, piece INT, chain BIGINT, entry INT, leave INT")

    def solve(one: pd.DataFrame) -> pd.DataFrame:
        one = one.sort_values("first")
        about = one.iloc[0]
        run = {"state": one["state"].to_numpy(np.int64), "first": one["first"].to_numpy(), "last": one["last"].to_numpy(), "cost": one["cost"].to_numpy(), "fixed": one["fixed"].to_numpy(bool)}
        got = pd.DataFrame(_segments(run, d, penalty, None if about["entry"] < 0 else int(about["entry"]), int(about["leave"])))
        edge = np.zeros(len(got), bool)
        edge[[0, -1]] = True
        return got.assign(entity=about["entity"], track=about["track"], chain=about["chain"], edge=edge)[["entity", "track", "chain", "edge", "state", "first", "last", "cost"]].astype({"state": "int32"})

    solved = open_.drop("moves").join(labels, ["entity", "track", "block", "piece"]).groupBy("entity", "track", "block", "piece").applyInPandas(solve, SEGMENTS)
    solved = checkpoint(solved)
    along = Window.partitionBy("entity", "track", "chain").orderBy("first")
    new = ~F.coalesce(F.lag("state").over(along) == F.col("state"), F.lit(False))
    across = (
        solved.filter("edge").withColumn("new", new.cast("int")).withColumn("segment", F.sum("new").over(along))
        .groupBy("entity", "track", "chain", "segment").agg(F.first("state").alias("state"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("cost").alias("cost"))
    )
    columns = ["entity", "track", "state", "first", "last", "cost"]
    return final.unionByName(across.select(*columns)).unionByName(solved.filter("NOT edge").select(*columns))
