"""Splits that keep all records of a connected group together."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.operators.skew import all_not_null, salted_lookup, two_level_rank
from frameloom.session import checkpoint, collect_small


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of an undirected graph ``a, b`` of longs; root is the smallest node it reaches.

    Each round hooks the root of a node to the least root among its neighbours and halves all paths, so that chains
    take a logarithmic number of rounds. Every round is cut off by a reliable checkpoint; minima are combined before
    the shuffle, and lookups of hot nodes are salted.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = checkpoint(both)
    parent = checkpoint(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        up = parent.select(F.col("node").alias("root"), F.col("root").alias("grand"))
        flat = salted_lookup(parent, up, ["root"], ["node"]).select("node", "root", "grand")
        near = salted_lookup(both, parent.select(F.col("node").alias("b"), F.col("root").alias("r")), ["b"], ["a"]).groupBy("a").agg(F.min("r").alias("near")).withColumnRenamed("a", "node")
        now = checkpoint(flat.join(near, "node").select("node", "root", F.least("grand", "near").alias("best")))
        hooks = now.select(F.col("root").alias("node"), "best").unionByName(now.select("node", "best")).groupBy("node").agg(F.min("best").alias("best"))
        after = checkpoint(parent.join(hooks, "node").select("node", F.least("root", "best").alias("root"), (F.col("best") < F.col("root")).cast("int").alias("moved")))
        if not after.agg(F.max("moved")).first()[0]:
            return after.select("node", "root")
        parent = after.select("node", "root")


def related_groups(df: DataFrame, record: str, entity: list[str]) -> DataFrame:
    """``record, root`` of each non-null record id; root is the smallest record id that must stay with it.

    Rows with the same entity belong together, rows with the same record id too, and so on through any chain; a null
    in any entity column names no entity. Each entity shrinks to its smallest record before the graph is walked, so
    that the graph has only the links between entities, and no entity's rows meet in one task.
    """
    keys = [f"e{i}" for i in range(len(entity))]
    rows = df.select(F.col(f"`{record}`").cast("long").alias("id"), *[F.col(f"`{c}`").alias(k) for c, k in zip(entity, keys, strict=True)]).filter("id IS NOT NULL").distinct()
    rows = checkpoint(rows)
    named = rows.filter(all_not_null(keys))
    least = named.groupBy(*keys).agg(F.min("id").alias("low"))
    pairs = checkpoint(salted_lookup(named, least, keys, ["id"]).select("id", "low").distinct())
    home = pairs.groupBy("id").agg(F.min("low").alias("home"))
    links = pairs.join(home, "id").filter("low <> home").select(F.col("low").alias("a"), F.col("home").alias("b")).distinct()
    roots = components(links)
    led = salted_lookup(home, roots.select(F.col("node").alias("home"), "root"), ["home"], ["id"], how="left").select("id", F.coalesce("root", "home").alias("root"))
    alone = rows.select("id").distinct().join(led, "id", "left")
    return alone.select(F.col("id").alias("record"), F.coalesce("root", "id").alias("root"))


def balanced_bins(sizes: Mapping[int, int], bins: int, packs: int | None = None) -> list[Counter]:
    """Largest-differencing partition of groups into equal bins: for each bin, how many groups of each size it gets.

    ``sizes`` has the number of groups of each size. Extremes, the smallest group and the largest that still fits,
    are first combined into packs of bounded weight, all groups of equal size at once; the packs are then partitioned
    by repeatedly combining the two partial solutions of the widest spread, the heaviest bin of one with the lightest
    of the other.
    """
    total = sum(s * n for s, n in sizes.items())
    limit = max(1, total // (packs or 20 * bins))
    done: list[tuple[int, Counter, int]] = [(s, Counter({s: 1}), n) for s, n in sizes.items() if s > limit]
    small = {s: n for s, n in sizes.items() if s <= limit and n}
    order = sorted(small)
    i, j = 0, len(order) - 1
    while i <= j:
        low, high = order[i], order[j]
        room = limit // (low + high) if low != high else limit // low
        if low == high:
            each = max(1, room)
            full, rest = divmod(small[low], each)
            i += 1
            done += [(low * each, Counter({low: each}), full)] * bool(full) + [(low * rest, Counter({low: rest}), 1)] * bool(rest)
            continue
        each = max(1, min(room, small[low], small[high]))
        if low + high > limit:
            done.append((high, Counter({high: 1}), small[high]))
            j -= 1
            continue
        full = min(small[low], small[high]) // each
        done.append(((low + high) * each, Counter({low: each, high: each}), full))
        small[low] -= full * each
        small[high] -= full * each
        i += not small[low]
        j -= not small[high]
    tick, heap = 0, []
    for weight, what, n in done:
        for _ in range(n):
            heap.append((-weight, tick, [(0, Counter())] * (bins - 1) + [(weight, what)]))
            tick += 1
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, _, x), (_, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        joined = sorted(((a + b, p + q) for (a, p), (b, q) in zip(x, reversed(y), strict=True)), key=lambda z: z[0])
        heapq.heappush(heap, (joined[0][0] - joined[-1][0], tick, joined))
        tick += 1
    return [what for _, what in heap[0][2]] if heap else []


def allocate(bins: list[Counter], targets: Mapping[str, float]) -> dict[str, Counter]:
    """Whole bins to splits: each bin, heaviest first, to the split that is furthest below its target."""
    weigh = lambda c: sum(s * n for s, n in c.items())
    total, share = sum(map(weigh, bins)), sum(targets.values())
    want = {k: total * v / share for k, v in targets.items()}
    got: dict[str, Counter] = {k: Counter() for k in targets}
    for one in sorted(bins, key=weigh, reverse=True):
        to = max(sorted(want), key=lambda k: want[k])
        got[to] += one
        want[to] -= weigh(one)
    return got


def assign_splits(groups: DataFrame, targets: Mapping[str, float], bins: int = 100, seed: int = 42) -> DataFrame:
    """``record, root, split`` for the ``record, root`` of :func:`related_groups`.

    The driver sees only how many groups have each size: distinct sizes that sum to N are fewer than sqrt(2 N).
    Which groups of a size go where follows a seeded hash. An empty input gives an empty result.
    """
    sized = groups.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    sized = checkpoint(sized)
    sizes = {r["size"]: r["n"] for r in collect_small(sized.groupBy("size").agg(F.count(F.lit(1)).alias("n")), 1_000_000)}
    got = allocate(balanced_bins(sizes, bins), targets) if sizes else {}
    spans, at = [], Counter()
    for split in sorted(got):
        for s, n in sorted(got[split].items()):
            spans.append((s, at[s] + 1, at[s] + n, split))
            at[s] += n
    spark = groups.sparkSession
    plan = spark.createDataFrame(spans, "size BIGINT, lo BIGINT, hi BIGINT, split STRING")  # sizes x splits rows
    mixed = F.xxhash64(F.lit(seed), F.col("root"))
    ranked = two_level_rank(sized, ["size"], [mixed, F.col("root")], F.shiftrightunsigned(mixed, 54), "nth")
    placed = ranked.join(F.broadcast(plan), "size").filter("nth BETWEEN lo AND hi").select("root", "split")
    return salted_lookup(groups, placed, ["root"], ["record"]).select("record", "root", "split")


def split_report(assigned: DataFrame, targets: Mapping[str, float]) -> DataFrame:
    """Records and groups of each split, with the share reached and the target."""
    want = assigned.sparkSession.createDataFrame(sorted(targets.items()), "split STRING, target_share DOUBLE")
    got = assigned.groupBy("split", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("split").agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("groups"))
    share = F.col("records") / F.sum("records").over(Window.partitionBy(F.lit(1)))
    return want.join(got, "split", "left").fillna(0, ["records", "groups"]).withColumn("share", share)
