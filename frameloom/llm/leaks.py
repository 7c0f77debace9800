"""Evaluation texts that occur, whole, in part or edited, inside corpus documents."""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.session import checkpoint, collect_small, spread

#: Characters of a seed, and of the exact run that makes a pair a case of ``p9_found``.
SEED, RUN = 10, 60
#: Share of the items that may hold an n-gram which is still rare (two items always may); item characters that seeds must
#: cover before a place is aligned.
RARE_SHARE, COVER = 0.05, 2 * SEED
#: Smith-Waterman: match, mismatch, gap; the least score of a reported leak is that of so many matching characters.
MATCH, MISMATCH, GAP, LEAST = 2, -3, -3, 40
#: Characters of the evaluation texts whose index goes to every task at once; more are searched for in several passes.
PART_CHARS = 4_000_000

_OTHER = regex.compile(r"[^\p{L}\p{N}]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)

LEAKS = "doc_id BIGINT, item_id BIGINT, score INT, coverage DOUBLE, longest_run INT, doc_from INT, doc_to INT"


def normalised(text: str) -> str:
    """Letters and digits only: compatibility decomposition, lower case, everything else left out."""
    return _OTHER.sub("", unicodedata.normalize("NFKD", text).lower())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(c: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n codes from each position on; the last n - 1 positions have none."""
    if len(c) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(c) - n + 1, np.uint64)
    for j in range(n):
        out *= _BASE
        out += c[j : len(c) - n + 1 + j]
    return out ^ (out >> np.uint64(29))


class Hits:
    """Finds, in a batch of texts at once, the positions whose n-gram is one of the given hashes."""

    def __init__(self, wanted: np.ndarray, n: int) -> None:
        self.wanted, self.n = np.unique(wanted), n
        self.coarse = np.zeros(1 << 20, bool)
        self.coarse[(self.wanted >> np.uint64(44)).astype(np.int64)] = True

    def find(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text number, position in the text and index into ``wanted`` of each hit; all codes and the texts' starts."""
        sizes = np.array([len(t) for t in texts], np.int64)
        starts = np.r_[0, np.cumsum(sizes)]
        all_ = codes("".join(texts))
        h = gram_hashes(all_, self.n)
        at = np.flatnonzero(self.coarse[(h >> np.uint64(44)).astype(np.int64)])
        if len(self.wanted):
            which = np.minimum(np.searchsorted(self.wanted, h[at]), len(self.wanted) - 1)
            ok = self.wanted[which] == h[at]
            at, which = at[ok], which[ok]
        else:
            at = which = np.empty(0, np.int64)
        text = np.searchsorted(starts, at, "right") - 1
        ok = at + self.n <= starts[text + 1]
        return text[ok], (at - starts[text])[ok], which[ok], all_, starts


def _batches(batches: Iterator[pa.RecordBatch], chars: int = 4_000_000) -> Iterator[tuple[list[int], list[str]]]:
    """Normalised texts of a few million characters at a time; a longer text comes alone."""
    ids: list[int] = []
    texts: list[str] = []
    held = 0
    for batch in batches:
        for i, t in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            if not t:
                continue
            ids.append(i)
            texts.append(normalised(t))
            held += len(texts[-1])
            if held >= chars:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def smith_waterman(items: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Best local score of each padded item inside a band of diagonals (pads: 0 in items, 1 in windows).

    ``windows`` has the text from the band's lowest diagonal on: row i of the alignment meets its characters i to
    i + width - 1. Antidiagonals are taken one by one, all pairs side by side: a cell needs its own diagonal two steps
    before, and its neighbours' one step before, so that even and odd diagonals take turns.
    """
    n, size = items.shape
    half = (windows.shape[1] - size + 2) // 2
    kind = np.int16 if MATCH * size < 1 << 14 else np.int32
    match, mismatch, gap = kind(MATCH), kind(MISMATCH), kind(GAP)
    back = np.zeros((size + 2 * half, n), np.uint32)  # the items backwards, pads around them
    back[half : half + size] = items.T[::-1]
    along = np.ones((size + 2 * half + 1, n), np.uint32)
    along[: windows.shape[1]] = windows.T
    turns = [np.zeros((half + 1, n), kind) for _ in range(2)]  # odd ones hold diagonal 2q + 1 at q + 1
    best, step = (np.zeros((half, n), kind) for _ in range(2))
    for m in range(size + half - 1):
        for odd in (0, 1):
            np.multiply(back[size + half - 1 - m :][:half] == along[m + odd :][:half], match - mismatch, out=step)
            step += mismatch
            own, other = turns[odd][odd : half + odd], turns[1 - odd]
            step += own
            own[:] = np.maximum(other[1:], other[:-1])
            own += gap
            np.maximum(own, step, out=own)
            np.maximum(own, kind(0), out=own)
            np.maximum(best, own, out=best)
    return best.max(0).astype(np.int32) if size else np.zeros(n, np.int32)


def _align(jobs: list[tuple], cells: int = 1 << 15) -> np.ndarray:
    """Scores of all (item, text) or (item, text, lowest diagonal, highest diagonal), those of like sizes side by side;
    without diagonals all of them count. Bands are widened to whole multiples of 32 diagonals."""
    full = [j if len(j) == 4 else (*j, 1 - len(j[0]), len(j[1]) - 1) for j in jobs]
    out = np.zeros(len(jobs), np.int32)
    widths = [max(1, -(-(hi - lo + 1) // 32)) * 32 for _, _, lo, hi in full]
    order = sorted(range(len(full)), key=lambda k: (widths[k], len(full[k][0])))
    at = 0
    while at < len(order):
        width = widths[order[at]]
        some = list(itertools.takewhile(lambda k: widths[k] == width, order[at : at + max(1, cells // width)]))  # noqa: B023
        size = max(len(full[k][0]) for k in some)
        a, b = np.zeros((len(some), size), np.uint32), np.ones((len(some), size + width - 1), np.uint32)
        for r, k in enumerate(some):
            item, text, lo, _ = full[k]
            a[r, : len(item)] = item
            part = text[max(0, lo) : max(0, lo + width - 1 + len(item))]
            b[r, max(0, -lo) : max(0, -lo) + len(part)] = part
        out[some] = smith_waterman(a, b)
        at += len(some)
    return out


def _longest_true(same: np.ndarray) -> int:
    off = np.flatnonzero(~same)
    if not len(off):
        return len(same)
    return max(int(off[0]), len(same) - 1 - int(off[-1]), int((off[1:] - off[:-1]).max()) - 1 if len(off) > 1 else 0)


class Index:
    """Seeds of a set of items: for every seed its items and places, as arrays.

    A seed is an n-gram that at most ``rare`` items hold, and besides the rarest one of every stretch of ``window``
    characters, so that no exact run of that length is without a seed. Rarity is counted over the items, not over the
    documents: how often a passage leaked must not decide whether its edited copies are found.
    """

    def __init__(self, items: list[tuple[int, np.ndarray]], n: int, window: int, rare: int = 2) -> None:
        self.items, self.n = items, n
        grams = [gram_hashes(c, n) for _, c in items]
        held, count = np.unique(np.concatenate([np.unique(g) for g in grams]), return_counts=True) if grams else (np.empty(0, np.uint64), np.empty(0, np.int64))
        seeds, owners, places = [], [], []
        for number, g in enumerate(grams):
            if not len(g):
                continue
            often = count[np.searchsorted(held, g)]
            use = often <= rare
            width = max(1, min(window - n + 1, len(g)))
            rarest = np.lib.stride_tricks.sliding_window_view(often, width).argmin(1) + np.arange(len(g) - width + 1)
            use[rarest] = True
            at = np.flatnonzero(use)
            seeds.append(g[at])
            owners.append(np.full(len(at), number))
            places.append(at)
        seed = np.concatenate(seeds) if seeds else np.empty(0, np.uint64)
        self.hits = Hits(seed, n)
        which = np.searchsorted(self.hits.wanted, seed)
        order = np.argsort(which, kind="stable")
        self.count = np.bincount(which, minlength=len(self.hits.wanted))
        self.first = np.r_[0, np.cumsum(self.count)]
        self.owner, self.place = (np.concatenate(x)[order] if x else np.empty(0, np.int64) for x in (owners, places))


def _cover(group: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Item characters under the seeds of each group; rows are sorted by group and place."""
    same = np.r_[group[1:] == group[:-1], False]
    step = np.where(same, np.minimum(n, np.r_[place[1:] - place[:-1], 0]), n)
    return np.bincount(group, step)


def _search(index: Index, least_run: int, least: int, cover: int):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.int32()), ("coverage", pa.float64()), ("longest_run", pa.int32()), ("doc_from", pa.int32()), ("doc_to", pa.int32())])
    items = index.items
    item_len = np.array([len(c) for _, c in items])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _batches(batches):
            text, pos, which, all_, starts = index.hits.find(texts)
            if not len(text):
                continue
            # One row for each (hit, item position with that seed), then one for each diagonal of a document and item.
            n = index.count[which]
            k = np.repeat(np.arange(len(which)), n)
            own = np.repeat(index.first[which], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            doc_, item_, place, shift = text[k], index.owner[own], index.place[own], pos[k] - index.place[own]
            order = np.lexsort((shift, item_, doc_))
            doc_, item_, place, shift = doc_[order], item_[order], place[order], shift[order]
            new = np.r_[True, (doc_[1:] != doc_[:-1]) | (item_[1:] != item_[:-1]) | (shift[1:] - shift[:-1] > item_len[item_[1:]])]  # places far apart are aligned apart
            begin = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            by_place = np.lexsort((place, group))
            covered = _cover(group[by_place], place[by_place], index.n)
            found: list[list] = []
            jobs: list[tuple[np.ndarray, np.ndarray]] = []
            for g, (lo, hi) in enumerate(zip(begin, np.r_[begin[1:], len(group)], strict=True)):
                doc, it = int(doc_[lo]), int(item_[lo])
                item = items[it][1]
                a0, a1 = int(starts[doc]), int(starts[doc + 1])
                longest = 0
                for by in np.unique(shift[lo:hi]).tolist():
                    i0, i1 = max(0, -by), min(len(item), a1 - a0 - by)
                    longest = max(longest, _longest_true(item[i0:i1] == all_[a0 + by + i0 : a0 + by + i1]))
                if longest < least_run or (covered[g] < cover and longest < cover):
                    continue
                pad = len(item) // 8 + 8
                low, high = int(shift[lo]) - pad, int(shift[hi - 1]) + pad
                jobs.append((item, all_[a0:a1], low, high))
                found.append([ids[doc], items[it][0], longest, max(0, low), min(a1 - a0, high + len(item)), len(item)])
            score = _align(jobs)
            best: dict[tuple, list] = {}
            for (doc_id, item_id, longest, w0, w1, size), s in zip(found, score.tolist(), strict=True):
                now = best.setdefault((doc_id, item_id), [s, size, longest, w0, w1])
                now[2] = max(now[2], longest)
                if s > now[0]:
                    now[0], now[3], now[4] = s, w0, w1
            rows = [(d, i, s, s / (MATCH * size), longest, w0, w1) for (d, i), (s, size, longest, w0, w1) in best.items() if s >= MATCH * least]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return run


def find_leaks(documents: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, seed: int = SEED, least_run: int = 0, least: int = LEAST, cover: int = COVER, rare_share: float = RARE_SHARE, part_chars: int = PART_CHARS) -> DataFrame:
    """``LEAKS``: every pair of a document and an evaluation item that share a passage, with the alignment's score.

    Both texts are reduced to letters and digits. Seeds are the n-grams of the items that are rare among the items
    (:class:`Index`), and the rarest of every ``cover`` characters, so that no exact run of that length is missed.
    Around the seeds that a document has, the item is aligned by Smith-Waterman, in a band that allows an eighth of the
    item more or less at least, wherever they cover ``cover`` of its characters or lie in an exact run as long; pairs scoring at
    least ``MATCH * least`` come out, exact runs of ``least`` characters among them always. ``longest_run`` is the longest exact run through a seed; with
    ``least_run`` only places with one that long are aligned and come out.

    Documents are read once and never shuffled, once for each ``part_chars`` characters of items; the driver holds one
    part of the items at a time. Null and empty texts, null ids, and items shorter than a seed match nothing. Repeated
    document ids give a row for each batch they lie in at most.
    """
    known = items.select(F.col(f"`{item}`").cast("long").alias("id"), F.col(f"`{item_text}`").alias("text")).dropna().distinct()
    size = known.agg(F.sum(F.length("text")).alias("chars"), F.count_distinct("id").alias("n")).first()
    parts, n_items = -(-int(size["chars"] or 0) // part_chars), size["n"]
    docs = spread(documents.select(F.col(f"`{doc}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL"))
    found = []
    for part in range(parts):
        mine = known.filter(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part)
        index = Index([(r["id"], codes(normalised(r["text"]))) for r in collect_small(mine, 2 * part_chars)], seed, least_run or cover, max(2, int(rare_share * n_items)))
        one = docs.mapInArrow(_search(index, least_run, least, cover), LEAKS)
        found.append(one if parts == 1 else checkpoint(one))
    if not found:
        return docs.sparkSession.createDataFrame([], LEAKS)
    if parts == 1:
        return found[0]
    # Two texts of one item id may lie in different parts.
    best = F.max(F.struct("score", "coverage", "longest_run", "doc_from", "doc_to")).alias("b")
    return reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(best, F.max("longest_run").alias("run")).select("doc_id", "item_id", "b.score", "b.coverage", F.col("run").alias("longest_run"), "b.doc_from", "b.doc_to")
