"""Implausible readings in pose tracks: impossible values, frozen stretches and excursions, judged by each source's normal.

A track is one entity's sequence of readings: the camera, one hand, or the joints of a hand. Each entity is cut into
blocks of frames with a halo, so that one entity may hold any part of all rows; the readings of a block travel packed,
column by column and compressed. Blocks are read twice. The first time they tell how their source moves and repeats:
the Gram matrix of its motion over the frames of a profile, and histograms. The sums over all blocks of a source give
its patterns of motion and its usual steps and repeats. The second time every profile is split into a mixture of the
source's patterns, the low-rank part, and a sparse rest, and what stands out in the rest is held against the source's
limits. No threshold or pattern depends on which blocks a task works on at once.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.operators.skew import salted_lookup
from frameloom.session import checkpoint, collect_small

#: Frames in a block and in the halo on either side; a halo holds half a profile of the wider kind.
BLOCK, HALO = 4096, 96
#: Frames of a profile (a row of the matrix that is split into low-rank motion and sparse spikes), the patterns besides
#: the level, and the strides of frames: the wider profiles are for excursions of a quarter of a narrow one and more.
PROFILE, RANK, STRIDES = 24, 3, (1, 8)
#: Readings that are worked on at once, and readings of a partition.
CHUNK, PARTITION = 40_000, 250_000
#: A stretch is frozen beyond 2 x the run length that covers 90 % of the source's readings, plus this.
FROZEN_SLACK = 4
#: An excursion lies more than this many times off the low-rank motion as the source usually moves in a frame.
FAR = 3.0
#: Physical limits: metres from the camera, metres from the origin, error of a rotation, bone length.
HAND_REACH, CAMERA_REACH, ROTATION_ERROR, BONE_LONGEST = 20.0, 1e5, 0.02, 0.5

_BINS = 8  # bins of a histogram for each doubling


@dataclass(frozen=True)
class Part:
    """A group of columns that moves together, and the deviation below which it is never an excursion."""

    name: str
    columns: slice
    floor: float


@dataclass(frozen=True)
class Track:
    field: str
    parts: list[Part]
    frozen: list[str] = field(default_factory=list)  # names of the hashes that are tested for frozen stretches


CAMERA = Track("extrinsic_c2w", [Part("position", slice(0, 3), 0.05), Part("rotation", slice(3, 12), 0.05)], ["all", "position"])
HAND = Track("hand", [Part("position", slice(0, 3), 0.008), Part("orientation", slice(3, 9), 0.1), Part("pose", slice(9, 99), 0.2), Part("shape", slice(99, 109), 0.5)], ["all", "position"])
JOINTS = Track("hand_joints_3d", [Part("wrist", slice(0, 3), 0.008), *[Part(f"finger{i}", slice(3 + 12 * i, 15 + 12 * i), 0.015) for i in range(5)]], ["all", *[f"joint{i}" for i in range(21)]])
TRACKS = {"camera": CAMERA, "left": HAND, "right": HAND, "joints": JOINTS}

#: Parent of each of the 21 joints, the wrist first and then five fingers from base to tip.
PARENT = [0, 0, 1, 2, 3, 0, 5, 6, 7, 0, 9, 10, 11, 0, 13, 14, 15, 0, 17, 18, 19]

#: Numbers of a reading as it is stored.
WIDTH = {"camera": 16, "left": 109, "right": 109, "joints": 63}

PACKS = "track STRING, seq_id STRING, block BIGINT, n INT, pack BINARY"
OUT = "row STRING, track STRING, test STRING, part STRING, source STRING, seq_id STRING, frames ARRAY<BIGINT>, value DOUBLE, bin INT, n BIGINT, gram BINARY"


def _matrix(column: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of the rows with lists of ``width``, which rows those are, and which are neither so nor null or empty."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    ok = size == width
    flat = pc.list_flatten(column.filter(pa.array(ok)))
    return flat.cast(pa.float32()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, width), ok, (size != 0) & ~ok


def _hash(x: np.ndarray) -> np.ndarray:
    """A number for the exact bits of each row."""
    bits = np.ascontiguousarray(x).view(np.uint32).astype(np.uint64)
    h = np.zeros(len(x), np.uint64)
    for j in range(bits.shape[1]):
        h = (h ^ bits[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return (h & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def _six(x: np.ndarray) -> np.ndarray:
    """Largest error of rotations given as two rows of three: unit length and right angle."""
    v = x.reshape(len(x), x.shape[1] // 6, 2, 3)
    unit = np.abs(np.sqrt((v * v).sum(3)) - 1).max((1, 2))
    return np.maximum(unit, np.abs((v[:, :, 0] * v[:, :, 1]).sum(2)).max(1))


def _camera(m: np.ndarray) -> np.ndarray:
    """Which 4x4 poses are possible."""
    with np.errstate(all="ignore"):
        p = m.astype(np.float64).reshape(-1, 4, 4)
        r = p[:, :3, :3]
        error = np.abs(np.einsum("nij,nkj->nik", r, r) - np.eye(3)).max((1, 2))
        det = np.einsum("ni,ni->n", r[:, 0], np.cross(r[:, 1], r[:, 2]))
        return np.isfinite(m).all(1) & (error < ROTATION_ERROR) & (det > 0) & (np.abs(p[:, 3] - [0, 0, 0, 1]).max(1) < 1e-3) & (np.abs(p[:, :3, 3]).max(1) < CAMERA_REACH)


def _hand(h: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.isfinite(h).all(1) & (np.abs(h[:, :3]).max(1) < HAND_REACH) & (h[:, 2] > 0) & (np.abs(h[:, 99:]).max(1) < 1e3) & (_six(h[:, 3:99]) < 2 * ROTATION_ERROR)


def _joints(j: np.ndarray) -> np.ndarray:
    p = j.reshape(-1, 21, 3)
    with np.errstate(all="ignore"):
        bone = np.linalg.norm(p[:, 1:] - p[:, PARENT[1:]], axis=2)
        return np.isfinite(j).all(1) & (np.abs(j).max(1) < HAND_REACH) & (p[:, :, 2] > 0).all(1) & (bone.max(1) < BONE_LONGEST) & (bone.max(1) > 0)


def _columns(track: str, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns that are compared, and hashes of the parts that may freeze, of possible readings."""
    if track == "camera":
        position = np.ascontiguousarray(x[:, [3, 7, 11]])
        return np.concatenate([position, x[:, [0, 1, 2, 4, 5, 6, 8, 9, 10]]], 1), np.stack([_hash(x), _hash(position)], 1)
    if track == "joints":
        p = x.reshape(-1, 21, 3)
        return np.concatenate([p[:, 0], (p[:, 1:] - p[:, :1]).reshape(-1, 60)], 1), np.stack([_hash(x), *[_hash(p[:, i]) for i in range(21)]], 1)
    return x, np.stack([_hash(x), _hash(x[:, :3])], 1)


def _pack(frame: np.ndarray, at: np.ndarray, state: np.ndarray, source: list, x: np.ndarray) -> bytes:
    """Readings of a block as bytes: the numbers by column, and of each number the first bytes together, which shrinks best."""
    names = sorted(set(source), key=lambda v: (v is not None, v))
    code = {v: i for i, v in enumerate(names)}
    columns = np.ascontiguousarray(x.T).view(np.uint8).reshape(-1, 4).T.tobytes()
    head = json.dumps(names).encode()
    raw = struct.pack("<iii", len(frame), len(x), len(head)) + head + frame.astype("<i8").tobytes() + at.astype("<i8").tobytes() + state.astype("<i1").tobytes() + np.array([code[v] for v in source], "<i4").tobytes() + columns
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(pack: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(pack)
    n, m, size = struct.unpack_from("<iii", raw)
    names, off, out = json.loads(raw[12 : 12 + size]), 12 + size, []
    for kind, bytes_ in (("<i8", 8), ("<i8", 8), ("<i1", 1), ("<i4", 4)):
        out.append(np.frombuffer(raw, kind, n, off))
        off += bytes_ * n
    x = np.frombuffer(raw, np.uint8, 4 * m * width, off).reshape(4, -1).T.copy().view(np.float32).reshape(width, m).T
    return out[0], out[1], out[2], [names[c] for c in out[3]], x


def _reduce(kind: str):
    """Rows of a table to packed readings of its tracks; nothing is compared across rows yet."""
    names = ["track", "seq_id", "block", "n", "pack"]

    def packs(batch: pa.RecordBatch, track: str, values: np.ndarray, rows: np.ndarray, odd: np.ndarray, possible) -> Iterator[pa.RecordBatch]:
        n = batch.num_rows
        state, place = np.zeros(n, np.int8), np.zeros(n, np.int64)
        state[rows] = np.where(possible(values), 2, 1)
        state[odd] = 1
        place[rows] = np.arange(len(rows))
        frame, at, source = batch["frame"].to_numpy(), batch["at"].to_numpy(), batch["source"].to_pylist()
        coded = batch["seq_id"].dictionary_encode()
        seq, seqs = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        block, inner = frame // BLOCK, frame % BLOCK
        low, high = np.flatnonzero(inner < HALO), np.flatnonzero(inner >= BLOCK - HALO)
        row = np.r_[np.arange(n), low, high]
        to = np.r_[block, block[low] - 1, block[high] + 1]
        order = np.lexsort((row, to, seq[row]))
        row, to = row[order], to[order]
        cuts = np.flatnonzero(np.r_[True, (seq[row[1:]] != seq[row[:-1]]) | (to[1:] != to[:-1])])
        out = []
        for lo, hi in zip(cuts, np.r_[cuts[1:], len(row)], strict=True):
            r = row[lo:hi]
            good = r[state[r] == 2]
            out.append((track, seqs[seq[r[0]]], int(to[lo]), len(r), _pack(frame[r], at[r], state[r], [source[i] for i in r], values[place[good]])))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary()], strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            if kind == "prediction":
                m, ok, odd = _matrix(batch["extrinsic_c2w"], 16)
                yield from packs(batch, "camera", m, np.flatnonzero(ok), odd, _camera)
                h, ok, odd = _matrix(batch["hand"], 218)
                logits, have, _ = _matrix(batch["hand_presence_logits"], 2)
                logit = np.full((batch.num_rows, 2), np.nan, np.float32)
                logit[have] = logits
                for i, side in enumerate(("left", "right")):
                    with np.errstate(invalid="ignore"):
                        there = logit[:, i] >= 0  # NaN isn't
                    yield from packs(batch, side, np.ascontiguousarray(h[there[ok], 109 * i : 109 * i + 109]), np.flatnonzero(ok & there), odd & there, _hand)
            else:
                valid = pc.fill_null(batch["hand_valid"], False).to_numpy(zero_copy_only=False)
                j, ok, odd = _matrix(batch["hand_joints_3d"], 63)
                yield from packs(batch, "joints", j[valid[ok]], np.flatnonzero(ok & valid), odd & valid, _joints)

    return run


@dataclass
class Readings:
    """Possible readings of whole blocks in order, the one ingested last of each frame; ``odd`` are the impossible ones."""

    entity: np.ndarray  # a source's readings in one block of one sequence
    frame: np.ndarray
    core: np.ndarray
    source: np.ndarray  # place in ``sources``
    sources: list[str]
    seq: list[str]
    x: np.ndarray
    hashes: np.ndarray
    odd: list[tuple[str | None, str, int]]


def _readings(track: str, packs: list[tuple[str, int, bytes]]) -> Readings:
    width = WIDTH[track]
    entity, frame, core, source, seq, xs, odd = [], [], [], [], [], [], []
    codes: dict[str, int] = {}
    i = 0
    while i < len(packs):
        j = i
        while j < len(packs) and packs[j][:2] == packs[i][:2]:
            j += 1
        parts = [_unpack(p[2], width) for p in packs[i:j]]
        f, at, state = (np.concatenate([p[k] for p in parts]) for k in range(3))
        names = [v for p in parts for v in p[3]]
        x = np.concatenate([p[4] for p in parts])
        place = np.cumsum(state == 2) - 1
        tie = np.zeros(len(f), np.int64)
        tie[state == 2] = _hash(x)
        order = np.lexsort((tie, state, at, f))
        last = order[np.r_[f[order][1:] != f[order][:-1], True]]
        inside = f[last] // BLOCK == packs[i][1]
        odd += [(names[r], packs[i][0], int(f[r])) for r in last[inside & (state[last] == 1)]]
        good = state[last] == 2
        last, inside = last[good], inside[good]
        mine = np.array([codes.setdefault("" if names[r] is None else names[r], len(codes)) for r in last], np.int64)
        for c in np.unique(mine):
            of = np.flatnonzero(mine == c)
            entity.append(np.full(len(of), len(seq)))
            frame.append(f[last[of]])
            core.append(inside[of])
            source.append(mine[of])
            seq.append(packs[i][0])
            xs.append(x[place[last[of]]])
        i = j
    one = lambda v, kind: np.concatenate(v) if v else np.empty(0, kind)
    x = np.concatenate(xs) if xs else np.empty((0, width), np.float32)
    columns, hashes = _columns(track, x)
    return Readings(one(entity, np.int64), one(frame, np.int64), one(core, bool), one(source, np.int64), list(codes), seq, columns.astype(np.float64), hashes, odd)


def smooth_basis() -> np.ndarray:
    """Level and slow motion over a profile: the patterns before a source has its own."""
    return np.linalg.qr(np.vander(np.linspace(-1, 1, PROFILE), RANK + 1, increasing=True))[0]


def source_basis(gram: np.ndarray) -> np.ndarray:
    """The level and the principal components of a source's motion, drawn a little towards smooth motion."""
    level = np.full((PROFILE, 1), 1 / np.sqrt(PROFILE))
    off = np.eye(PROFILE) - level @ level.T
    smooth = smooth_basis()
    trace = np.trace(gram)
    mixed = off @ ((gram / trace if trace > 0 else 0) + 0.2 * smooth @ smooth.T / RANK) @ off
    return np.concatenate([level, np.linalg.eigh((mixed + mixed.T) / 2)[1][:, -RANK:]], 1)


class Profiles:
    """The profile matrix of one group of columns: a row for each column and stretch of ``PROFILE`` frames of an entity.

    Only the inner products between the frames of a profile are kept, over all its columns, which is all that a split
    into patterns and distances from them needs. Profiles overlap by half in two tilings.
    """

    def __init__(self, x: np.ndarray, entity: np.ndarray, frame: np.ndarray, keep: np.ndarray, tilings: tuple[int, ...] = (0, PROFILE // 2)) -> None:
        self.n, self.tilings = len(x), []
        for shift in tilings:
            window, slot = (frame + shift) // PROFILE, (frame + shift) % PROFILE
            new = np.r_[True, (entity[1:] != entity[:-1]) | (window[1:] != window[:-1])]
            row = np.cumsum(new) - 1
            size = int(row[-1]) + 1
            values, mask = np.zeros((size, PROFILE, x.shape[1])), np.zeros((size, PROFILE))
            at = np.flatnonzero(keep)
            first = np.zeros(size, np.int64)
            has, where = np.unique(row[at], return_index=True)
            first[has] = at[where]
            values[row[at], slot[at]] = x[at] - x[first[row[at]]]
            mask[row[at], slot[at]] = 1
            self.tilings.append((row, slot, values @ values.transpose(0, 2, 1), mask))

    def fit(self, basis: np.ndarray, rounds: int, which: int = 0, rows: np.ndarray | slice = slice(None), out: np.ndarray | None = None) -> np.ndarray:
        """Distance of each frame of the profiles ``rows`` from its low-rank part. Frames marked in ``out`` have no say.

        The low-rank part minimises the sum of the distances, not of their squares, so that sparse spikes have no pull;
        it is found by weights that fall with the distance.
        """
        _, _, gram, mask = self.tilings[which]
        gram, mask = gram[rows], mask[rows]
        say = mask if out is None else mask * ~out
        own = np.einsum("ntt->nt", gram)
        eye = 1e-9 * np.eye(basis.shape[1])
        weight = say
        for _ in range(rounds):
            g = weight[:, :, None] * basis
            a = basis.T @ g + eye * np.maximum(weight.sum(1), 1e-3)[:, None, None]
            s = np.linalg.solve(a, g.transpose(0, 2, 1) @ gram)
            inner = np.linalg.solve(a, (s @ g).transpose(0, 2, 1))
            far = np.sqrt(np.maximum(own - 2 * np.einsum("tk,nkt->nt", basis, s) + ((basis @ inner) * basis).sum(2), 0)) * mask
            weight = say / np.maximum(far, 1e-5)
        return far

    def clean_gram(self, basis: np.ndarray, floor: float) -> np.ndarray:
        """Sum of the Gram matrices of the profiles that show how the source moves: those with most of their frames and
        none far out. A profile with something sparse in it has no say in the patterns."""
        _, _, gram, mask = self.tilings[0]
        far = self.fit(basis, 4)
        middle = np.median(far, axis=1)
        clean = (mask.sum(1) >= PROFILE * 0.75) & (far.max(1) <= np.maximum(floor, 6 * middle))
        return gram[clean].sum(0)

    def residual(self, basis: np.ndarray, gate: float, out: np.ndarray | None = None, rounds: int = 6) -> np.ndarray:
        """Distance of each kept reading from the low-rank part of the profile that has more readings, or where it is
        nearer to the middle. Readings in ``out`` have no say; profiles with others beyond ``gate`` are fitted once more
        without those."""

        def marks(which: np.ndarray) -> list[np.ndarray]:
            found = [np.zeros(mask.shape, bool) for *_, mask in self.tilings]
            for mark, (row, slot, _, _) in zip(found, self.tilings, strict=True):
                mark[row[which], slot[which]] = True
            return found

        first = None if out is None else marks(out)
        far = [self.fit(basis, rounds, i, out=None if first is None else first[i]) for i in range(len(self.tilings))]
        suspect = self.combine(far) > gate
        if suspect.any():
            for i, mark in enumerate(marks(suspect if out is None else suspect | out)):
                rows = np.unique(self.tilings[i][0][suspect])
                far[i][rows] = self.fit(basis, rounds, i, rows, mark[rows])
        return self.combine(far)

    def combine(self, far: list[np.ndarray]) -> np.ndarray:
        out, held = np.full(self.n, np.nan), np.full(self.n, -1.0)
        for (row, slot, _, mask), d in zip(self.tilings, far, strict=True):
            score = mask.sum(1)[row] + np.where(np.abs(slot - (PROFILE - 1) / 2) <= PROFILE / 4, 0.5, 0)
            better = (mask[row, slot] > 0) & (score > held)
            out[better], held[better] = d[row, slot][better], score[better]
        return out


def way_between(x: np.ndarray, entity: np.ndarray, frame: np.ndarray, burst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distance of each reading of a burst from the straight way between the burst's neighbours, how many readings
    the burst has, and how far apart its neighbours are; NaN and 0 where ``burst``, its number, is negative.

    At an entity's end the one neighbour stands for both; a burst without neighbours has NaN."""
    at = np.flatnonzero(burst >= 0)
    out, size, change = np.full(len(x), np.nan), np.zeros(len(x), np.int64), np.zeros(len(x))
    if not len(at):
        return out, size, change
    new = np.r_[True, burst[at[1:]] != burst[at[:-1]]]
    start, end = at[new], at[np.r_[new[1:], True]]
    of = np.cumsum(new) - 1
    a, b = np.maximum(start - 1, 0), np.minimum(end + 1, len(x) - 1)
    left, right = (start > 0) & (entity[a] == entity[start]), (end < len(x) - 1) & (entity[b] == entity[end])
    a, b = np.where(left, a, b), np.where(right, b, np.where(left, a, b))
    size[at] = (end - start + 1)[of]
    ok, a, b = (left | right)[of], a[of], b[of]
    share = (frame[at] - frame[a]) / np.maximum(frame[b] - frame[a], 1)
    way = x[a] + (x[b] - x[a]) * share[:, None]
    out[at] = np.where(ok, np.sqrt(((x[at] - way) ** 2).sum(1)), np.nan)
    change[at] = np.sqrt(((x[b] - x[a]) ** 2).sum(1))
    return out, size, change


def bursts(x: np.ndarray, entity: np.ndarray, frame: np.ndarray, jumps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the burst that each reading lies in, else -1, and the smaller one of its jumps.

    A burst goes from a jump to the next one within ``HALO`` frames that leads back to where the first began, or takes
    back what it did, at least by half."""
    out, leap, at = np.full(len(x), -1), np.zeros(len(x)), 0
    while at < len(jumps):
        i = jumps[at]
        end = None
        for k in range(at + 1, len(jumps)):
            j = jumps[k]
            if entity[j] != entity[i] or frame[j] - frame[i] > HALO:
                break
            here, back = x[i] - x[i - 1], x[j] - x[j - 1]
            if min(np.linalg.norm(x[j] - x[i - 1]), np.linalg.norm(here + back)) <= np.linalg.norm(here) / 2:
                end = k
                break
        if end is not None:
            j, at = jumps[end], end
            out[i:j] = i
            leap[i:j] = min(np.linalg.norm(x[i] - x[i - 1]), np.linalg.norm(x[j] - x[j - 1]))
        at += 1
    return out, leap


def _bin(v: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(v > 1e-7, np.ceil(_BINS * np.log2(np.maximum(v, 1e-7))), -1000).astype(np.int64)


def _runs(r: Readings, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Length of the stretch of equal bits that each reading lies in, and which readings begin one."""
    fresh = np.r_[True, (r.entity[1:] != r.entity[:-1]) | (r.hashes[1:, k] != r.hashes[:-1, k])]
    run = np.cumsum(fresh) - 1
    return np.bincount(run)[run], fresh


def _steps(v: np.ndarray, e: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Way from the reading before, for each frame between, and which readings have one not far before."""
    step = np.r_[0.0, np.sqrt((np.diff(v, axis=0) ** 2).sum(1)) / np.maximum(np.diff(f), 1)]
    return step, np.r_[False, (e[1:] == e[:-1]) & (np.diff(f) <= 3)]


def _strided(e: np.ndarray, f: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, entities and frames in which every ``stride``-th frame follows another."""
    if stride == 1:
        return np.arange(len(e)), e, f
    order = np.lexsort((f, f % stride, e))
    return order, e[order] * stride + f[order] % stride, f[order] // stride


class _Rows:
    """Rows of ``OUT``; histograms and Gram matrices are summed until the task ends."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.counts: dict[tuple, int] = {}
        self.grams: dict[tuple, np.ndarray] = {}

    def count(self, track: str, test: str, part: str, source: str, values: np.ndarray) -> None:
        for b, m in zip(*(v.tolist() for v in np.unique(values, return_counts=True)), strict=True):
            key = (track, test, part, source, b)
            self.counts[key] = self.counts.get(key, 0) + m

    def suspect(self, track: str, test: str, part: str, source: str | None, seq: str, frames: list[int], value: float | None) -> None:
        self.rows.append(("suspect", track, test, part, source, seq, frames, value, None, None, None))

    def take(self, end: bool) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        if end:
            rows += [("histogram", *key[:4], None, None, None, key[4], m, None) for key, m in self.counts.items()]
            rows += [("gram", track, "gram", part, source, None, None, None, stride, None, g.tobytes()) for (track, part, source, stride), g in self.grams.items()]
        types = [pa.string()] * 6 + [pa.list_(pa.int64()), pa.float64(), pa.int32(), pa.int64(), pa.binary()]
        cols = list(zip(*rows, strict=True)) or [[]] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["row", "track", "test", "part", "source", "seq_id", "frames", "value", "bin", "n", "gram"])


def _observe(name: str, r: Readings, out: _Rows) -> None:
    """How the sources move and repeat in these blocks."""
    track = TRACKS[name]
    lengths = [_runs(r, k)[0] for k in range(len(track.frozen))] if len(r.frame) else []
    for code in np.unique(r.source):
        of, s = np.flatnonzero(r.source == code), r.sources[code]
        e, f, c = r.entity[of], r.frame[of], r.core[of]
        for part, length in zip(track.frozen, lengths, strict=True):
            out.count(name, "frozen", part, s, np.minimum(length[of][c], HALO))
        for part in track.parts:
            v = r.x[of][:, part.columns]
            step, near = _steps(v, e, f)
            out.count(name, "step", part.name, s, _bin(step[near & c]))
            for stride in STRIDES:
                order, es, fs = _strided(e, f, stride)
                key = (name, part.name, s, stride)
                out.grams[key] = out.grams.get(key, 0) + Profiles(v[order], es, fs, np.ones(len(of), bool), (0,)).clean_gram(smooth_basis(), part.floor)


def _judge(name: str, r: Readings, out: _Rows, bases: dict[tuple, np.ndarray], frozen: dict[tuple, int], steps: dict[tuple, float]) -> None:
    """Suspects, and how far readings usually lie from the source's motion."""
    track = TRACKS[name]
    for source, seq, frame in r.odd:
        out.suspect(name, "impossible", "", source, seq, [frame], None)
    if not len(r.frame):
        return
    stuck = np.zeros(len(r.frame), bool)
    for k, part in enumerate(track.frozen):
        length, fresh = _runs(r, k)
        long = (length > np.array([frozen.get((name, part, s), np.inf) for s in r.sources])[r.source]) & ~fresh
        stuck |= long
        at = np.flatnonzero(long & r.core)
        for rows in np.split(at, np.flatnonzero((np.diff(at) > 1) | (np.diff(r.entity[at]) > 0)) + 1) if len(at) else []:
            out.suspect(name, "frozen", part, r.sources[r.source[rows[0]]], r.seq[r.entity[rows[0]]], r.frame[rows].tolist(), float(length[rows[0]]))
    for code in np.unique(r.source):
        of, s = np.flatnonzero((r.source == code) & ~stuck), r.sources[code]
        if len(of):
            for part in track.parts:
                _excursions(name, part, s, r, of, out, bases, max(part.floor, 2 * steps.get((name, part.name, s), 0.0)))


def _excursions(name: str, part: Part, s: str, r: Readings, of: np.ndarray, out: _Rows, bases: dict[tuple, np.ndarray], gate: float) -> None:
    e, f, c = r.entity[of], r.frame[of], r.core[of]
    v = r.x[of][:, part.columns]
    step, near = _steps(v, e, f)
    # What may be an excursion by its jumps has no say in the patterns' mixture. One that fills much of a narrow profile
    # is measured against a wider one.
    burst, leap = bursts(v, e, f, np.flatnonzero(near & (step > gate)))
    at = np.flatnonzero(burst >= 0)
    size = np.zeros(len(of), np.int64)
    size[at] = np.bincount(burst[at], minlength=len(of))[burst[at]]
    wide_ones, long = size >= PROFILE // 4, np.zeros(len(of), bool)
    at = np.flatnonzero(np.isin(e, e[wide_ones])) if wide_ones.any() else ()
    if len(at):
        wide, order, es, fs = f"{part.name}@{STRIDES[1]}", *_strided(e[at], f[at], STRIDES[1])
        far = np.zeros(len(of))
        far[at[order]] = Profiles(v[at][order], es, fs, np.ones(len(at), bool)).residual(bases[(name, part.name, s, STRIDES[1])], gate, (burst >= 0)[at][order])
        way = way_between(v, e, f, burst)[0]
        long = wide_ones & (way > gate) & (far > gate)
        out.count(name, "residual", wide, s, _bin(far[at][(c & ~long)[at]]))
        for i in np.flatnonzero(long & c):
            out.suspect(name, "excursion", wide, s, r.seq[e[i]], [int(f[i])], float(min(far[i], leap[i])))
    far = Profiles(v, e, f, ~long).residual(bases[(name, part.name, s, 1)], gate, (burst >= 0) & ~long)
    suspect = far > gate
    at = np.flatnonzero(suspect | long)
    runs = np.full(len(of), -1)
    runs[at] = np.cumsum(np.r_[True, (at[1:] != at[:-1] + 1) | (e[at[1:]] != e[at[:-1]])])[: len(at)]
    way, size, change = way_between(v, e, f, runs)
    lasting = (change > gate * (size + 1) / 2) & (way <= change)  # a new level, not a way there and back
    calm = near & c & ~suspect & ~long
    calm[1:] &= ~suspect[:-1] & ~long[:-1]
    out.count(name, "calm", part.name, s, _bin(step[calm]))
    out.count(name, "residual", part.name, s, _bin(far[c & ~long & np.isfinite(far)]))
    for i in np.flatnonzero(suspect & c & (size < PROFILE // 2) & (way > gate / 2) & ~lasting):
        out.suspect(name, "excursion", part.name, s, r.seq[e[i]], [int(f[i])], float(far[i]))


def _scan(work, *more, chunk: int = CHUNK):
    """Whole blocks, sorted by track, entity and block, through ``work``, several at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows()
        held: list[tuple[str, int, bytes]] = []
        size, track = 0, None
        for batch in batches:
            for t, seq, block, n, pack in zip(*(batch[c].to_pylist() for c in ("track", "seq_id", "block", "n", "pack")), strict=True):
                if held and (t != track or (size >= chunk and held[-1][:2] != (seq, block))):
                    work(track, _readings(track, held), out, *more)
                    held, size = [], 0
                    yield out.take(False)
                track = t
                held.append((seq, block, pack))
                size += n
        if held:
            work(track, _readings(track, held), out, *more)
        yield out.take(True)

    return run


def packed_readings(prediction: DataFrame, gtsequence: DataFrame) -> DataFrame:
    at = F.expr("coalesce(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ingested_at AS TIMESTAMP_NTZ)), -1)").alias("at")
    keyed = "seq_id IS NOT NULL AND frame IS NOT NULL"
    pred = prediction.filter(keyed).select("seq_id", "frame", "source", at, "extrinsic_c2w", "hand", "hand_presence_logits").mapInArrow(_reduce("prediction"), PACKS)
    gt = gtsequence.filter(keyed).select("seq_id", "frame", "source", at, "hand_joints_3d", "hand_valid").mapInArrow(_reduce("gtsequence"), PACKS)
    return pred.unionByName(gt)


def _quantile(histograms: DataFrame, q: float) -> DataFrame:
    """Lowest bin of each (track, test, part, source) that holds the quantile."""
    keys = ["track", "test", "part", "source"]
    sums = histograms.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    run = Window.partitionBy(*keys)
    share = sums.withColumn("below", F.sum("n").over(run.orderBy("bin"))).withColumn("all", F.sum("n").over(run))
    return share.filter(F.col("below") >= q * F.col("all")).groupBy(*keys).agg(F.min("bin").alias("bin"))


def _add(one: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(g) for g in one["gram"].to_pylist()], axis=0)
    return one.slice(0, 1).select(["track", "part", "source", "bin"]).append_column("gram", pa.array([total.tobytes()], pa.binary()))


def implausible(prediction: DataFrame, gtsequence: DataFrame, far: float = FAR, chunk: int = CHUNK) -> DataFrame:
    """``seq_id, frame, field, track, test, part, source, value, limit`` of every implausible reading.

    Per (seq_id, frame) the row ingested last counts. Rows with a null key take no part; a null source is a source of
    its own; null lists and hands that aren't there are never flagged; a list of another width is impossible. Empty
    tables give an empty result.

    ``impossible``: not finite, no rotation, behind the camera, out of reach. ``frozen``: bit-equal to the reading
    before, in a stretch longer than the source's usual repeats allow; parts that stand still in the source, nine of ten
    readings in stretches of ``HALO`` frames and more, are not tested. ``excursion``: readings whose sparse part, what
    the source's patterns leave over, is more than ``far`` times what the source usually moves in a frame, and that
    return: an excursion lies off the way between the readings before and after it, a lasting change doesn't. Those of
    a quarter of a profile and more (part ``...@8``) besides leave and return by a jump; they are seen up to ``HALO`` frames.

    The driver holds a pattern of motion and a few limits for each source and part of a track.
    """
    spark = prediction.sparkSession
    packs = packed_readings(prediction, gtsequence)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(3 * prediction.count() + gtsequence.count()) // PARTITION))
    held = checkpoint(packs.repartition(parts, "track", "seq_id", "block").sortWithinPartitions("track", "seq_id", "block", "pack"))
    seen = checkpoint(held.mapInArrow(_scan(_observe, chunk=chunk), OUT))

    keys = ["track", "part", "source"]
    size = F.pow(F.lit(2.0), F.col("bin") / F.lit(float(_BINS)))
    first = collect_small(_quantile(seen.filter("row = 'histogram'"), 0.9).select(*keys, "test", "bin", size.alias("size")), 1_000_000)
    frozen = {(r["track"], r["part"], r["source"]): 2 * r["bin"] + FROZEN_SLACK for r in first if r["test"] == "frozen" and r["bin"] < HALO}
    steps = {(r["track"], r["part"], r["source"]): r["size"] for r in first if r["test"] == "step"}
    grams = seen.filter("row = 'gram'").select(*keys, "bin", "gram").groupBy(*keys, "bin").applyInArrow(_add, "track STRING, part STRING, source STRING, bin INT, gram BINARY")
    bases = {(r["track"], r["part"], r["source"], r["bin"]): source_basis(np.frombuffer(r["gram"]).reshape(PROFILE, PROFILE)) for r in collect_small(grams)}
    judged = checkpoint(held.mapInArrow(_scan(_judge, bases, frozen, steps, chunk=chunk), OUT))

    wide = F.concat("part", F.lit(f"@{STRIDES[1]}"))
    hist = judged.filter("row = 'histogram'")
    calm = _quantile(hist.filter("test = 'calm'"), 0.98).withColumn("part", F.explode(F.array("part", wide)))
    usual = calm.unionByName(_quantile(hist.filter("test = 'residual'"), 0.9)).groupBy(*keys).agg(F.max(size).alias("usual"))
    floors = spark.createDataFrame([(n, part, p.floor) for n, t in TRACKS.items() for p in t.parts for part in (p.name, f"{p.name}@{STRIDES[1]}")], "track STRING, part STRING, floor DOUBLE")
    limits = usual.join(F.broadcast(floors), ["track", "part"]).select(*keys, F.greatest(F.lit(far) * F.col("usual"), F.col("floor")).alias("limit"))

    suspects = judged.filter("row = 'suspect'").select("track", "test", "part", "source", "seq_id", "frames", "value")
    excursions = salted_lookup(suspects.filter("test = 'excursion'"), limits, keys, ["seq_id", "frames"]).filter("value > limit")
    cases = excursions.unionByName(suspects.filter("test <> 'excursion'").withColumn("limit", F.lit(None).cast("double")))
    fields = F.create_map(*[F.lit(v) for n, t in TRACKS.items() for v in (n, t.field)])
    return cases.select("seq_id", F.explode("frames").alias("frame"), fields[F.col("track")].alias("field"), "track", "test", "part", "source", "value", "limit")
