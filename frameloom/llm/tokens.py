"""Encoding of whole texts with a public byte-level BPE vocabulary, long texts in parallel."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.session import spread

#: Folder of the vocabulary files; never copied into this repository.
TOKENIZERS = os.environ.get("FRAMELOOM_TOKENIZERS", "/opt/tokenizers")

#: The pattern that splits a text into pieces before the merges of this public vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Characters of a text that one task encodes at a time, and bytes of a piece without a split that are merged at once.
SEGMENT_CHARS, LEAF_BYTES = 1 << 16, 1 << 10

SEGMENTS = "id BIGINT, segment INT, ids ARRAY<INT>"


@lru_cache(maxsize=4)
def encoder(folder: str, name: str) -> tiktoken.Encoding:
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Encodes texts; pieces longer than ``leaf`` bytes go through :meth:`tree`."""

    def __init__(self, folder: str = TOKENIZERS, name: str = "byte_bpe_50k", leaf: int = LEAF_BYTES) -> None:
        self.encoding = encoder(folder, name)
        self.pattern = regex.compile(PATTERN)
        self.long = regex.compile(rf"[\p{{L}}\p{{N}}]{{{leaf // 4},}}|[^\s\p{{L}}\p{{N}}]{{{leaf // 4},}}|\s{{{leaf // 4},}}")
        self.leaf = max(2, leaf)

    def piece(self, raw: bytes) -> list[int]:
        return self.encoding._core_bpe.encode_single_piece(raw)

    def join(self, left: list[int], right: list[int], more: tuple[bool, bool] = (False, False)) -> list[int] | None:
        """Tokens of the concatenation of two encoded byte strings of one piece.

        A window of tokens around the join is encoded again and grows until its first token is the one that stood
        there on the left, and its last token the one on the right. Neighbouring tokens that the merges leave apart in
        some context stay apart in every context, so the rest of both sides stands. ``more`` says that a side goes on
        beyond what is given; if the window then has no such token on that side, the result is None.
        """
        of = lambda ids: b"".join(self.encoding.decode_single_token_bytes(i) for i in ids)
        a = b = 2
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            window = self.piece(of(left[len(left) - a :] + right[:b]))
            ok_left = (a == len(left) and not more[0]) or window[0] == left[len(left) - a]
            ok_right = (b == len(right) and not more[1]) or window[-1] == right[b - 1]
            if ok_left and ok_right:
                return left[: len(left) - a] + window + right[b:]
            if (ok_left or a == len(left)) and (ok_right or b == len(right)):
                return None
            a, b = (a if ok_left else 2 * a), (b if ok_right else 2 * b)

    def tree(self, raw: bytes) -> list[int]:
        """A long piece: leaves are encoded apart and joined in pairs, level by level."""
        level = [self.piece(raw[i : i + self.leaf]) for i in range(0, len(raw), self.leaf)]
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def text(self, text: str) -> list[int]:
        if not self.long.search(text):
            return self.encoding.encode_ordinary(text)
        out: list[int] = []
        for m in self.pattern.finditer(text):
            raw = m.group().encode()
            out += self.piece(raw) if len(raw) <= self.leaf else self.tree(raw)
        return out

    def glue(self, parts: list[list[int]]) -> list[int]:
        """Encoded pieces of text, in order, joined to the encoding of the whole text, in pairs, level by level."""
        level = [p for p in parts if p]
        while len(level) > 1:
            level = [self.join_text(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0] if level else []

    def join_text(self, left: list[int], right: list[int]) -> list[int]:
        """Like :meth:`join`, where the pattern may split the texts differently once they meet.

        The window grows until it holds, on each side of the join, a place where a piece ends whatever lies around it:
        a white-space character after one that isn't. Between two such places the window's own split is the text's.
        """
        of = lambda ids: b"".join(self.encoding.decode_single_token_bytes(i) for i in ids)
        a = b = 16
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            head, tail = of(left[len(left) - a :]), of(right[:b])
            i = 0 if a == len(left) else _last_cut(head)
            j = len(tail) if b == len(right) else _first_cut(tail)
            if i is not None and j is not None and (cut := self.split_at(left, len(left) - a, i)) is not None and (end := self.split_at(right, 0, j)) is not None:
                return left[:cut] + self.text((head[i:] + tail[:j]).decode()) + right[end:]
            if a == len(left) and b == len(right):
                return self.text((head + tail).decode())
            if ONE_PIECE.fullmatch((head + tail).decode(errors="replace")):  # the window lies inside one piece
                mid = self.join(left[len(left) - a :], right[:b], (a < len(left), b < len(right)))
                if mid is not None:
                    return left[: len(left) - a] + mid + right[b:]
            a, b = 2 * a, 2 * b

    def split_at(self, ids: list[int], at: int, byte: int) -> int | None:
        """Index of the token that begins ``byte`` bytes after token ``at``."""
        while byte > 0 and at < len(ids):
            byte -= len(self.encoding.decode_single_token_bytes(ids[at]))
            at += 1
        return at if byte == 0 else None


#: Text without a place where the pattern could split; bytes of a cut character at either end count as letters.
ONE_PIECE = regex.compile(r"\ufffd{0,3}(?:\p{L}+|\p{N}+)\ufffd{0,3}")

#: A piece always ends between these, in bytes: any byte of a visible ASCII character, then a space or line end.
_CUT = regex.compile(rb"(?<=[!-~])[ \n]")


def _last_cut(raw: bytes) -> int | None:
    last = None
    for m in _CUT.finditer(raw):
        last = m.start()
    return last


def _first_cut(raw: bytes) -> int | None:
    m = _CUT.search(raw)
    return m.start() if m else None


def _encode_segments(folder: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(folder, name)
        for batch in batches:
            ids = [enc.text(t) if t else [] for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["segment"], pa.array(ids, pa.list_(pa.int32()))], ["id", "segment", "ids"])

    return run


def _glue(folder: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(folder, name)
        for batch in batches:
            ids = [enc.glue(parts) for parts in batch["parts"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return run


def encode(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """``key, ids`` of each row: the token ids of its text, without special tokens; null and empty texts have no ids.

    Texts up to ``segment_chars`` are encoded where they lie, without a shuffle. Longer ones are cut into segments
    that are dealt over all tasks, encoded apart and joined in a tree. Keys are whole numbers; a row's key must be
    unique among long texts, else the rows get an internal number. Ties and repeated rows each keep their row.
    """
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    small = spread(rows).filter(F.col("text").isNull() | (F.length("text") <= segment_chars)).withColumn("segment", F.lit(0))
    done = small.select("id", "segment", "text").mapInArrow(_encode_segments(folder, name), SEGMENTS).select("id", "ids")

    long = rows.filter(F.length("text") > segment_chars)
    cuts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / segment_chars).cast("int"))
    pieces = long.withColumn("row", F.struct("id", F.xxhash64("text").alias("h"), F.length("text").alias("n"))).select("row", F.explode(F.transform(cuts, lambda i: F.struct(i.alias("segment"), F.substring("text", i * segment_chars + 1, F.lit(segment_chars)).alias("text")))).alias("s"))
    flat = pieces.select("row", F.col("s.segment").alias("segment"), F.col("s.text").alias("text"))
    # Repeated rows: equal segments of equal rows are encoded once and counted.
    once = flat.groupBy("row", "segment", "text").agg(F.count(F.lit(1)).alias("copies")).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row", "segment")
    coded = once.mapInArrow(_encode_rows(folder, name), "row STRUCT<id: BIGINT, h: BIGINT, n: INT>, segment INT, copies BIGINT, ids ARRAY<INT>")
    whole = coded.groupBy("row").agg(F.max("copies").alias("copies"), F.sort_array(F.collect_list(F.struct("segment", "ids"))).alias("s"))
    each = whole.select(F.col("row.id").alias("id"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))), F.transform("s", lambda x: x["ids"]).alias("parts")).select("id", "parts")
    joined = each.mapInArrow(_glue(folder, name), "id BIGINT, ids ARRAY<INT>")
    return done.unionByName(joined).withColumnRenamed("id", key)


def _encode_rows(folder: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(folder, name)
        for batch in batches:
            ids = [enc.text(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["row"], batch["segment"], batch["copies"], pa.array(ids, pa.list_(pa.int32()))], ["row", "segment", "copies", "ids"])

    return run
