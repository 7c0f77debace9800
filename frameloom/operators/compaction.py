"""Many small newline-delimited files become few well-sized ones that hold every record once.

Files are joined as bytes. One scan looks for line ends and reads the keys where they stand in a line of the usual form,
without building objects; a JSON parser sees only lines of another form. It leaves a short row for each file: checksum,
lengths, and the stretches of frames that its keys cover. From those rows alone follows what happens to a file: a copy
of another one is left out, a file that shares no frame with any other goes on as one range of bytes, and only files
whose stretches overlap are cut into lines, of which the newest of each key stays. Ranges of bytes become zstandard
frames, and complete frames join to files; :func:`merge_blobs` joins frames of files that are stored already.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.session import broadcast_if_small, checkpoint

#: Bytes of lines in an output file, and in one of the zstandard frames it is made of.
TARGET_BYTES, FRAME_BYTES = 128 << 20, 1 << 20
#: Frames in a block inside which files are compared; a longer hole between two frames of a file ends a stretch.
BLOCK = 1 << 16

FRAMES = "ARRAY<STRUCT<at: BIGINT, size: BIGINT, raw: BIGINT, records: BIGINT, sha256: STRING>>"
BLOBS = f"part INT, file_no INT, kind STRING, n_records BIGINT, n_frames INT, raw_bytes BIGINT, stored_bytes BIGINT, raw_sha256 STRING, stored_sha256 STRING, frames {FRAMES}, payload BINARY"
RECORDS = "kind STRING, line BINARY"
META = "kind STRING, file_id BIGINT, written_at TIMESTAMP_NTZ, sha STRING, bytes BIGINT, records BIGINT, parsed BIGINT, plain BOOLEAN, spans ARRAY<STRUCT<e: BIGINT, lo: BIGINT, hi: BIGINT>>"

_EOL = re.compile(rb"\r\n|\r|\n")
_VALUE = rb'(?:-?(?:0|[1-9]\d*)(?:\.\d+)?|true|false|null|"[^"\\\x00-\x1f]*")'
_USUAL = {
    "parquet": re.compile(rb'(?:^|(?<=\n))(\{"episode_index": ?(-?\d{1,18}), ?"frame_index": ?(-?\d{1,18})(?:, ?"\w+": ?' + _VALUE + rb")*\}(?:\n|$))"),
    "video": re.compile(rb"(?:^|(?<=\n))((-?\d{1,18}),(-?\d{1,18}),-?\d+,[KP](?:\n|$))"),
}
_LEADING_ZERO = re.compile(rb'"(?:episode|frame)_index": ?-?0\d')


def _key(kind: str, line: bytes) -> tuple[int, int] | None:
    """Key of a line of any form; None if it is no complete record."""
    if kind == "video":
        m = _USUAL[kind].fullmatch(line)
        return (int(m[2]), int(m[3])) if m else None
    if not (line.startswith(b"{") and line.endswith(b"}")):
        return None
    try:
        row = json.loads(line)
        e, f = row["episode_index"], row["frame_index"]
    except (ValueError, KeyError, TypeError, RecursionError):
        return None
    return (e, f) if all(type(v) is int and -(1 << 63) <= v < 1 << 63 for v in (e, f)) else None


def records_of(kind: str | None, payload: bytes) -> tuple[list[tuple[bytes, int, int]], int]:
    """Complete lines of a file with their keys, each ending in a line feed, and how many lines had to be parsed."""
    if kind not in _USUAL or not payload:
        return [], 0
    usual = [(m[0], int(m[1]), int(m[2])) for m in _USUAL[kind].findall(payload)]
    if sum(len(m[0]) for m in usual) == len(payload) and not (kind == "parquet" and _LEADING_ZERO.search(payload)):
        if not payload.endswith(b"\n"):
            usual[-1] = (usual[-1][0] + b"\n", *usual[-1][1:])
        return usual, 0
    out, parsed = [], 0
    for raw in _EOL.split(payload):
        line = raw.strip(b" ")
        if not line:
            continue
        m = _USUAL[kind].fullmatch(line)
        if m and not (kind == "parquet" and _LEADING_ZERO.match(line)):
            out.append((line + b"\n", int(m[2]), int(m[3])))
            continue
        parsed += 1
        key = _key(kind, line)
        if key:
            out.append((line + b"\n", *key))
    return out, parsed


def spans_of(keys: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Stretches (episode, first, last) that cover the keys, ended by holes of more than a block."""
    out: list[tuple[int, int, int]] = []
    for e, f in sorted(keys):
        if out and out[-1][0] == e and f - out[-1][2] <= BLOCK:
            out[-1] = (e, out[-1][1], f)
        else:
            out.append((e, f, f))
    return out


def _meta(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for kind, payload in zip(batch["kind"].to_pylist(), batch["payload"].to_pylist(), strict=True):
            records, parsed = records_of(kind, payload)
            keys = [(e, f) for _, e, f in records]
            spans = spans_of(keys)
            plain = len(spans) == 1 and len(set(keys)) == len(keys)
            rows.append((hashlib.sha256(payload).hexdigest(), len(payload), len(records), parsed, plain, [{"e": e, "lo": lo, "hi": hi} for e, lo, hi in spans]))
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.struct([("e", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())]))]
        yield pa.RecordBatch.from_arrays([batch["kind"], batch["file_id"], batch["written_at"], *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], ["kind", "file_id", "written_at", "sha", "bytes", "records", "parsed", "plain", "spans"])


def _raw(files: DataFrame) -> DataFrame:
    return files.select("kind", F.col("file_id").cast("long").alias("file_id"), F.col("written_at").cast("timestamp_ntz").alias("written_at"), F.col("payload").cast("binary").alias("payload")).filter("payload IS NOT NULL")


def file_index(files: DataFrame) -> DataFrame:
    """``META`` of every file with a payload: what its bytes hold, whatever the table says about it."""
    return _raw(files).mapInArrow(_meta, META)


def plan_files(index: DataFrame) -> DataFrame:
    """``kind, sha, file_id, written_at, action`` of each file that takes part, copies left out: ``join`` its bytes or
    cut it into ``lines``.

    Files are compared inside blocks of an episode's frames, so that one episode may hold any part of all files.
    """
    newest = index.filter("records > 0").groupBy("kind", "sha").agg(F.max(F.struct("written_at", "file_id")).alias("m"), F.first("plain").alias("plain"), F.first("spans").alias("spans"))
    block = lambda c: F.expr(f"({c} - pmod({c}, {BLOCK})) div {BLOCK}")
    spans = newest.select("kind", "sha", F.inline("spans"))
    placed = spans.withColumn("block", F.explode(F.sequence(block("lo"), block("hi"))))
    per = Window.partitionBy("kind", "e", "block").orderBy("lo", "hi", "sha")
    before = F.max("hi").over(per.rowsBetween(Window.unboundedPreceding, -1))
    meets = F.coalesce(before >= F.col("lo"), F.lit(False)) | F.coalesce(F.lead("lo").over(per) <= F.col("hi"), F.lit(False))
    alone = placed.withColumn("meets", meets).groupBy("kind", "sha").agg(F.max("meets").alias("meets"))
    action = F.when(F.col("plain") & ~F.col("meets"), "join").otherwise("lines").alias("action")
    return newest.join(alone, ["kind", "sha"]).select("kind", "sha", "m.file_id", "m.written_at", action)


UNITS = "kind STRING, episode_index BIGINT, frame_index BIGINT, sha STRING, written_at TIMESTAMP_NTZ, file_id BIGINT, bytes BINARY"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole files as ranges of bytes, with line ends made even and what isn't complete cut off, and lines of the files
    that are cut (without ``sha``), of one key only the newest in the batch."""
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.timestamp("us"), pa.int64(), pa.binary()]
    for batch in batches:
        rows, lines = [], {}
        for kind, sha, at, i, payload, action in zip(*(batch[c].to_pylist() for c in ("kind", "sha", "written_at", "file_id", "payload", "action")), strict=True):
            records, _ = records_of(kind, payload)
            if action == "join":
                _, e, f = min(records, key=lambda r: r[1:])
                rows.append((kind, e, f, sha, at, i, b"".join(r[0] for r in records)))
                continue
            order = (at is not None, at, i is not None, i)
            for line, e, f in records:
                old = lines.get((kind, e, f))
                if old is None or old[0] < (*order, line):
                    lines[(kind, e, f)] = ((*order, line), at, i)
        rows += [(*key, None, at, i, order[-1]) for key, (order, at, i) in lines.items()]
        cols = list(zip(*rows, strict=True)) or [[]] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["kind", "episode_index", "frame_index", "sha", "written_at", "file_id", "bytes"])


class _File:
    """One output file: complete zstandard frames after each other, which is itself a valid zstandard file."""

    def __init__(self, part: int, no: int, kind: str, level: int) -> None:
        self.part, self.no, self.kind, self.level = part, no, kind, level
        self.stored: list[bytes] = []
        self.frames: list[dict] = []
        self.buffer: list[bytes] = []
        self.held = self.raw = self.size = 0
        self.raw_sum = hashlib.sha256()

    def add(self, lines: bytes) -> None:
        self.buffer.append(lines)
        self.held += len(lines)
        if self.held >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.buffer:
            block = b"".join(self.buffer)
            frame = zstandard.ZstdCompressor(level=self.level, write_checksum=True, write_content_size=True).compress(block)
            self.raw_sum.update(block)
            self.append(frame, {"raw": len(block), "records": block.count(b"\n"), "sha256": hashlib.sha256(block).hexdigest()})
            self.buffer, self.held = [], 0

    def append(self, frame: bytes, about: dict) -> None:
        """A complete frame as it is; only its header is read."""
        if zstandard.get_frame_parameters(frame).content_size != about["raw"]:
            raise ValueError("a frame's header gives another length than its entry")
        self.frames.append({"at": self.size, "size": len(frame), **{k: about[k] for k in ("raw", "records", "sha256")}})
        self.stored.append(frame)
        self.size += len(frame)
        self.raw += about["raw"]

    def row(self, whole: bool = True) -> dict:
        self.flush()
        stored = b"".join(self.stored)
        return {
            "part": self.part, "file_no": self.no, "kind": self.kind, "n_records": sum(f["records"] for f in self.frames), "n_frames": len(self.frames), "raw_bytes": self.raw,
            "stored_bytes": len(stored), "raw_sha256": self.raw_sum.hexdigest() if whole else None, "stored_sha256": hashlib.sha256(stored).hexdigest(), "frames": self.frames, "payload": stored,
        }


_BLOB = pa.schema([
    ("part", pa.int32()), ("file_no", pa.int32()), ("kind", pa.string()), ("n_records", pa.int64()), ("n_frames", pa.int32()), ("raw_bytes", pa.int64()), ("stored_bytes", pa.int64()), ("raw_sha256", pa.string()), ("stored_sha256", pa.string()),
    ("frames", pa.list_(pa.struct([("at", pa.int64()), ("size", pa.int64()), ("raw", pa.int64()), ("records", pa.int64()), ("sha256", pa.string())]))), ("payload", pa.binary()),
])


def _packer(target: int, level: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _File | None = None
        no, last = 0, None
        out = lambda f: pa.RecordBatch.from_pylist([f.row()], _BLOB)
        for batch in batches:
            for part, kind, e, f, sha, unit in zip(*(batch[c].to_pylist() for c in ("part", "kind", "episode_index", "frame_index", "sha", "bytes")), strict=True):
                if (kind, e, f, sha) == last:
                    continue  # an older line of the key, or a row of the table that is there twice
                last, at = (kind, e, f, sha), 0
                while at < len(unit):
                    if now is not None and now.kind != kind:
                        yield out(now)
                        now, no = None, no + 1
                    if now is None:
                        now = _File(part, no, kind, level)
                    room = target - now.raw - now.held
                    end = len(unit) if len(unit) - at <= min(room, FRAME_BYTES) else unit.rfind(b"\n", at, at + min(room, FRAME_BYTES)) + 1 if room > 0 else 0
                    if end <= at:
                        longer = unit.find(b"\n", at) + 1
                        if longer - at > room and (now.raw or now.held):
                            yield out(now)
                            now, no = None, no + 1
                            continue
                        end = longer  # a line longer than a frame, or than a file
                    now.add(unit[at:end])
                    at = end
        if now is not None:
            yield out(now)

    return pack


def compact(files: DataFrame, target_bytes: int = TARGET_BYTES, level: int = 6) -> DataFrame:
    """Output files as rows of ``BLOBS``, each a zstandard file of at most ``target_bytes`` of lines of one kind.

    A ``parquet`` line is complete if its JSON object closes, a ``video`` line if it has its four fields. Line ends are
    LF, CRLF or CR; blank and unfinished lines, null and empty payloads and unknown kinds give no row, and neither does
    a line whose key is null or no whole number. Of several lines with one key that of the file written last counts,
    then of the highest id.

    Bytes are dealt by blocks of an episode's frames, so an episode that holds a third of all rows is cut like any other,
    and sorted by episode and frame; each part is written in one pass that holds one frame and the compressed bytes of
    one file. A single line longer than the target gets a file of its own. No file gives no row.
    """
    index = checkpoint(file_index(files))
    plan = checkpoint(plan_files(index))
    small = broadcast_if_small(plan)
    sides = _raw(files).withColumn("sha", F.sha2("payload", 256)).alias("f"), (plan if small is None else small).alias("p")
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"p.{c}")) for c in ("kind", "sha", "file_id", "written_at")]
    kept = sides[0].join(sides[1], same).select("f.kind", "f.sha", "f.file_id", "f.written_at", "f.payload", "p.action")
    units = kept.mapInArrow(_units, UNITS)
    sizes = {r["kind"]: r["n"] for r in index.filter("records > 0").groupBy("kind").agg(F.sum("bytes").alias("n")).collect()}  # a row for each of the two kinds
    part, parts = F.lit(0), 0
    for kind, n in sorted(sizes.items()):
        own = max(1, -(-n * 5 // (target_bytes * 4)))  # parts are not quite equal; few need a second file at four fifths
        block = F.floor(F.col("frame_index") / BLOCK)
        part = F.when(F.col("kind") == kind, F.pmod(F.xxhash64("episode_index", block), F.lit(own)) + parts).otherwise(part)
        parts += own
    order = ["kind", "episode_index", "frame_index", "sha", F.desc_nulls_last("written_at"), F.desc_nulls_last("file_id"), F.desc("bytes")]
    dealt = units.withColumn("part", part.cast("int")).repartitionById(max(1, parts), "part").sortWithinPartitions(*order)
    return dealt.mapInArrow(_packer(target_bytes, level), BLOBS)


def merge_blobs(blobs: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Stored files joined to files of at most ``target_bytes`` of lines without unpacking: frames are copied as they
    are and only their headers are read. Each frame keeps its length and checksum, which reading validates; the
    checksum over all lines of a file is null."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _File | None = None
        no = 0
        for batch in batches:
            for row in batch.to_pylist():
                if hashlib.sha256(row["payload"]).hexdigest() != row["stored_sha256"]:
                    raise ValueError(f"file {row['part']}-{row['file_no']}: stored bytes differ from what was written")
                for f in row["frames"]:
                    if now is not None and (now.kind != row["kind"] or now.raw + f["raw"] > target_bytes):
                        yield pa.RecordBatch.from_pylist([now.row(False)], _BLOB)
                        now, no = None, no + 1
                    if now is None:
                        now = _File(row["at"], no, row["kind"], 1)
                    now.append(row["payload"][f["at"] : f["at"] + f["size"]], f)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.row(False)], _BLOB)

    total = blobs.agg(F.sum("raw_bytes")).first()[0] or 0
    ranged = blobs.repartitionByRange(max(1, -(-total // target_bytes)), "kind", "part", "file_no").sortWithinPartitions("kind", "part", "file_no")
    return ranged.withColumn("at", F.spark_partition_id()).mapInArrow(merge, BLOBS)


def _frames(row: dict) -> Iterator[bytes]:
    """Lines of each frame of a stored file; lengths and checksums are validated on the way."""
    stored, n, size, seen = row["payload"], 0, 0, hashlib.sha256()
    name = f"file {row['part']}-{row['file_no']}"
    if len(stored) != row["stored_bytes"] or hashlib.sha256(stored).hexdigest() != row["stored_sha256"]:
        raise ValueError(f"{name}: stored bytes differ from what was written")
    for f in row["frames"]:
        block = zstandard.ZstdDecompressor().decompress(stored[f["at"] : f["at"] + f["size"]])
        if len(block) != f["raw"] or hashlib.sha256(block).hexdigest() != f["sha256"]:
            raise ValueError(f"{name}: content differs from its length or checksum")
        seen.update(block)
        size += len(block)
        n += block.count(b"\n")
        yield block
    if n != row["n_records"] or size != row["raw_bytes"] or (row["raw_sha256"] is not None and seen.hexdigest() != row["raw_sha256"]):
        raise ValueError(f"{name}: content differs from its length or checksum")


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            for block in _frames(row):
                lines = block.split(b"\n")[:-1]
                yield pa.RecordBatch.from_arrays([pa.array([row["kind"]] * len(lines), pa.string()), pa.array(lines, pa.binary())], ["kind", "line"])


def _unpack_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            for block in _frames(row):
                keys = records_of(row["kind"], block)[0]
                yield pa.RecordBatch.from_arrays([pa.array([row["kind"]] * len(keys), pa.string()), pa.array([e for _, e, _ in keys], pa.int64()), pa.array([f for _, _, f in keys], pa.int64())], ["kind", "episode_index", "frame_index"])


def read_compacted(blobs: DataFrame) -> DataFrame:
    """``kind, line`` of every record of compacted files; lengths and checksums are validated on the way."""
    return blobs.mapInArrow(_unpack, RECORDS).withColumn("line", F.col("line").cast("string"))


def read_keys(blobs: DataFrame) -> DataFrame:
    """``kind, episode_index, frame_index`` of every record of compacted files, validated likewise."""
    return blobs.mapInArrow(_unpack_keys, "kind STRING, episode_index BIGINT, frame_index BIGINT")


def record_keys(lines: DataFrame) -> DataFrame:
    """``kind, episode_index, frame_index`` of records read back from compacted files."""
    json = lambda name: F.get_json_object("line", f"$.{name}").cast("long")
    csv = lambda i: F.split("line", ",").getItem(i).cast("long")
    pick = lambda name, i: F.when(F.col("kind") == "parquet", json(name)).otherwise(csv(i)).alias(name)
    return lines.select("kind", pick("episode_index", 0), pick("frame_index", 1))


def write_compacted(blobs: DataFrame, path: str) -> None:
    """Writes the packed files as a table; the payload column of a row is a complete ``.zst`` file."""
    blobs.write.mode("errorifexists").option("compression", "uncompressed").parquet(path)


def size_report(files: DataFrame, blobs: DataFrame) -> DataFrame:
    """Files, records and bytes before and after, by kind."""
    before = files.groupBy("kind").agg(F.count(F.lit(1)).alias("files_before"), F.sum(F.octet_length("payload")).alias("bytes_before"))
    after = blobs.groupBy("kind").agg(F.count(F.lit(1)).alias("files_after"), F.sum("n_records").alias("records"), F.sum("raw_bytes").alias("raw_bytes"), F.sum("stored_bytes").alias("stored_bytes"))
    return before.join(after, "kind", "left")


def audit(files: DataFrame) -> DataFrame:
    """By kind, how many files there are and how many of them say something about themselves that their bytes don't
    bear out: length, checksum (the first digits of SHA-256) or number of records. A null payload counts as missing."""
    index = file_index(files)
    said = files.select("kind", F.col("file_id").cast("long").alias("file_id"), F.col("written_at").cast("timestamp_ntz").alias("written_at"), "size_bytes", "content_hash", "n_records", F.sha2(F.col("payload").cast("binary"), 256).alias("sha"))
    same = [said[c].eqNullSafe(index[c]) for c in ("kind", "file_id", "written_at", "sha")]
    wrong = lambda c: F.count_if(F.coalesce(c, F.col("bytes").isNotNull()))
    return (
        said.join(index.dropDuplicates(["kind", "file_id", "written_at", "sha"]), same, "left")
        .select(said["kind"], said["sha"], "size_bytes", "content_hash", "n_records", "bytes", "records", "parsed")
        .groupBy("kind").agg(
            F.count(F.lit(1)).alias("files"), F.count_if(F.col("sha").isNull()).alias("missing"), wrong(F.col("size_bytes") != F.col("bytes")).alias("wrong_size"),
            wrong(~F.col("sha").startswith(F.nullif("content_hash", F.lit("")))).alias("wrong_hash"), wrong(F.col("n_records") != F.col("records")).alias("wrong_records"),
            F.coalesce(F.sum("records"), F.lit(0)).alias("records"),
        )
    )
