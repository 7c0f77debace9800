"""Text that was decoded with the wrong character encoding: which documents hold some, and what it was.

Noisy channel: a chunk (a run without ASCII white space) was written in one encoding and read in another. Its
characters give back the bytes that were read, where a replacement character stands for a byte that got lost; every
way to read the bytes is a candidate. Candidates are weighed by how often their words occur in the whole corpus, and a
Viterbi path over the chunks of a document chooses where a wrong reading begins and ends.
"""

from __future__ import annotations

import codecs
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.operators.skew import salted_lookup
from frameloom.session import broadcast_if_small, checkpoint, collect_small, spread

#: Encodings that texts are wrongly read in when they were UTF-8, and other usual pairs (read in, written in).
READ_IN = ["cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "koi8-r", "cp866", "cp1250", "iso8859-2"]
PAIRS = [
    ("cp1252", "cp1250"), ("cp1252", "cp1251"), ("cp1252", "iso8859-2"), ("cp1252", "koi8-r"), ("cp1252", "cp866"), ("cp1252", "gbk"), ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"),
    ("latin-1", "cp1250"), ("latin-1", "cp1251"), ("latin-1", "iso8859-2"), ("latin-1", "koi8-r"), ("latin-1", "cp866"), ("latin-1", "gbk"),
    ("cp1250", "cp1252"), ("cp1250", "cp1251"), ("cp1251", "koi8-r"), ("cp1251", "cp866"), ("cp1251", "cp1252"), ("koi8-r", "cp1251"), ("koi8-r", "cp866"), ("cp866", "cp1251"), ("cp866", "koi8-r"),
    ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"),
]
#: Nats by which a byte that UTF-8 requires speaks for UTF-8; what it costs to begin a wrong reading; the least gain of
#: a chunk for a reading without such a check; the gain of a replacement character, which is proof by itself.
BYTE_GAIN, BEGIN_UTF8, BEGIN_OTHER, LEAST_OTHER, LOST_GAIN = 4.0, 3.0, 12.0, 6.0, 1000.0
#: Chunks that a task counts before it hands on what it has; bits of the filter of known words, at most.
HELD_CHUNKS, FILTER_BITS = 200_000, 1 << 29

LOST = "\ufffd"
CHUNK = r"[^\x00-\x20]+"
_CHUNK = re.compile(CHUNK)
_PART = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]|[[\p{L}\p{M}\p{Nd}]--[\p{Han}\p{Hiragana}\p{Katakana}]]+|[^\x00-\x7f]", regex.V1)
_DIGITS = regex.compile(r"\p{Nd}+")
_PART_ASCII, _DIGITS_ASCII = re.compile(r"[0-9A-Za-z]+"), re.compile(r"[0-9]+")
_BESIDE = re.compile(r"[^\x00-\x7f]{2}")


def parts(text: str) -> list[str]:
    """Words (digits as one 0), ideographs and symbols beyond ASCII."""
    if text.isascii():
        return [_DIGITS_ASCII.sub("0", p) for p in _PART_ASCII.findall(text)]
    return [_DIGITS.sub("0", p) for p in _PART.findall(text)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts (kind 0) and chunks beyond ASCII (kind 1) with their numbers. Chunks are counted first, so that a chunk is
    taken apart once however often it occurs."""

    def found(chunks: Counter) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        for chunk, n in chunks.items():
            for part in parts(chunk):
                words[part] += n
        for kind, seen in enumerate((words, {c: n for c, n in chunks.items() if not c.isascii()})):
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(seen), pa.int32()), pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["kind", "key", "n"])

    held: Counter = Counter()
    for batch in batches:
        for text in batch["text"].to_pylist():
            held.update(_CHUNK.findall(text))
            if len(held) > HELD_CHUNKS:
                yield from found(held)
                held = Counter()
    yield from found(held)


@lru_cache(maxsize=None)
def _table(name: str) -> tuple[dict[int, int], frozenset[int]]:
    """Byte of each code point of an 8-bit encoding, and the bytes it doesn't define; those may also pass as controls."""
    chars, holes = {}, []
    for b in range(256):
        try:
            chars[ord(bytes([b]).decode(name))] = b
        except UnicodeDecodeError:
            holes.append(b)
    for b in holes:
        chars.setdefault(b, b)
    return chars, frozenset(holes)


def bytes_read(text: str, name: str) -> bytes | None:
    """The bytes that give ``text`` when read in an encoding; None if there are none."""
    try:
        return codecs.charmap_encode(text, "strict", _table(name)[0])[0]
    except UnicodeEncodeError:
        return None


class CharModel:
    """Cost in nats of a character, from how often the corpus has it, and the likeliest character for damaged bytes."""

    def __init__(self, counts: Mapping[str, int]) -> None:
        self.counts, self.total = counts, sum(counts.values()) or 1
        self.masked: dict[frozenset[int] | None, dict[tuple[int, ...], tuple[float, str]]] = {}

    def cost(self, char: str) -> float:
        return -math.log((self.counts.get(char, 0) + 0.1) / (self.total + 0.1))

    def damaged(self, seen: tuple[int, ...], lost: frozenset[int]) -> tuple[float, str] | None:
        """The likeliest character whose UTF-8 bytes are ``seen``, -1 being one of the bytes ``lost`` (any if empty)."""
        if lost not in self.masked:
            table = self.masked[lost] = {}
            for char in self.counts:
                raw = char.encode("utf-8", "surrogatepass")
                can = [i for i, b in enumerate(raw) if b >= 0x80 and (not lost or b in lost)] if len(raw) > 1 else []
                for size in range(1, len(can) + 1):
                    for at in itertools.combinations(can, size):
                        key = tuple(-1 if i in at else b for i, b in enumerate(raw))
                        table[key] = min(table.get(key, (math.inf, "")), (self.cost(char), char))
        got = self.masked[lost].get(seen)
        if got is None and seen[0] >= 0:  # no character of the corpus: the first that the bytes allow
            for fill in itertools.product(sorted(lost or range(0x80, 0xC0)), repeat=seen.count(-1)):
                it = iter(fill)
                try:
                    char = bytes(next(it) if b < 0 else b for b in seen).decode()
                except UnicodeDecodeError:
                    continue
                got = (self.cost(char), char)
                break
            self.masked[lost][seen] = got or (math.inf, "")
        return got if got and got[1] else None


def lattice_path(text: str, name: str, model: CharModel) -> list[tuple[int, int, str, bool]] | None:
    """Viterbi path through the byte lattice of ``text``, UTF-8 that was read in an encoding: for each character its
    place in ``text`` (from, to), the character, and whether a byte of it was lost. None if no path exists.

    A position of the lattice is a byte: the one that the character stands for or, for a replacement character, any
    that the encoding doesn't define (any byte beyond ASCII if it defines all). An edge is a character in UTF-8, from
    the byte where it begins to the one where it ends, at the cost of the character in the corpus. The work grows with
    the length, whatever the number of lost bytes.
    """
    chars, holes = _table(name)
    raw = [-1 if c == LOST else chars.get(ord(c), -2) for c in text]
    if -2 in raw or not any(b >= 0xC2 for b in raw):  # some byte must speak for UTF-8
        return None
    n = len(raw)
    best = [0.0] + [math.inf] * n
    back: list[tuple[int, str, bool] | None] = [None] * (n + 1)
    for i, b in enumerate(raw):
        if best[i] == math.inf:
            continue
        sizes = (1,) if 0 <= b < 0x80 else (2,) if 0xC2 <= b < 0xE0 else (3,) if 0xE0 <= b < 0xF0 else (4,) if 0xF0 <= b < 0xF5 else (2, 3, 4) if b < 0 and not holes else ()
        for size in sizes:
            seen = tuple(raw[i : i + size])
            if len(seen) < size or any(0 <= x < 0x80 or x >= 0xC0 for x in seen[1:]):
                continue
            if -1 in seen:
                got = model.damaged(seen, holes)
            else:
                try:
                    char = bytes(seen).decode()
                    got = (model.cost(char), char)
                except UnicodeDecodeError:
                    got = None
            if got and best[i] + got[0] < best[i + size]:
                best[i + size] = best[i] + got[0]
                back[i + size] = (i, got[1], -1 in seen)
    if best[n] == math.inf:
        return None
    path, at = [], n
    while at:
        i, char, damaged = back[at]
        path.append((i, at, char, damaged))
        at = i
    return path[::-1]


def readings(text: str, depth: int = 2) -> Iterator[tuple[str, str]]:
    """Channel and result of each other way to read a chunk; UTF-8 read wrongly up to ``depth`` + 1 times in a row.

    A result that still has replacement characters, or a chunk with some, goes on through :func:`lattice_path`.
    """
    seen = set()
    for name in READ_IN if _BESIDE.search(text) else ():  # UTF-8 beyond ASCII has two such bytes at least
        raw = bytes_read(text, name)
        if raw is None:
            continue
        try:
            new = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if new == text or new in seen:
            continue
        seen.add(new)
        yield f"utf-8 as {name}", new
        if depth and LOST not in new and not new.isascii():
            for channel, more in readings(new, depth - 1):
                if channel.startswith("utf-8") and more not in seen:
                    seen.add(more)
                    yield f"{channel}, then {name}", more
    if depth < 2 or LOST in text:
        return
    for name, true in PAIRS:
        raw = bytes_read(text, name)
        if raw is None:
            continue
        try:
            new = raw.decode(true)
        except UnicodeDecodeError:
            continue
        if new != text:
            yield f"{true} as {name}", new


class WordFilter:
    """Bloom filter of words: may take an unknown word for a known one, never a known one for unknown."""

    def __init__(self, bits: int, data: np.ndarray | None = None) -> None:
        self.bits = bits
        self.data = np.zeros(bits // 8, np.uint8) if data is None else data

    def places(self, word: str) -> tuple[int, int]:
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h % self.bits, (h >> 17) * 0x9E3779B1 % self.bits

    def add(self, word: str) -> None:
        for at in self.places(word):
            self.data[at >> 3] |= 1 << (at & 7)

    def __contains__(self, word: str) -> bool:
        return all(self.data[at >> 3] >> (at & 7) & 1 for at in self.places(word))


def word_filter(words: DataFrame) -> WordFilter:
    """Filter of the ``key`` of all rows: 16 bits a word up to ``FILTER_BITS``, beyond which it lets more through."""
    n = words.count()
    bits = min(FILTER_BITS, max(1 << 20, 1 << (16 * n).bit_length()))
    piece = 1 << 16

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = WordFilter(bits)
        for batch in batches:
            for word in batch["key"].to_pylist():
                mine.add(word)
        rows = [(i, mine.data[i * piece : (i + 1) * piece].tobytes()) for i in range(-(-len(mine.data) // piece)) if mine.data[i * piece : (i + 1) * piece].any()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["at", "data"])

    def either(one: pa.Table) -> pa.Table:
        data = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in one["data"].to_pylist()])
        return pa.table({"at": one["at"][:1].cast(pa.int32()), "data": pa.array([data.tobytes()], pa.binary())})

    out = WordFilter(bits)
    for r in collect_small(words.select("key").mapInArrow(fill, "at INT, data BINARY").groupBy("at").applyInArrow(either, "at INT, data BINARY")):  # FILTER_BITS at most
        out.data[r["at"] * piece : r["at"] * piece + len(r["data"])] = np.frombuffer(r["data"], np.uint8)
    return out


#: A reading's text in pieces, in order: ``part`` is a word that has a cost (null if none), ``key`` what stands in the
#: chunk for a word with lost bytes, ``lossy`` the encoding that lost them.
PIECES = "chunk STRING, channel STRING, seq INT, text STRING, part STRING, lossy STRING, key STRING, unseen DOUBLE, bonus DOUBLE"
_PIECES = pa.schema([("chunk", pa.string()), ("channel", pa.string()), ("seq", pa.int32()), ("text", pa.string()), ("part", pa.string()), ("lossy", pa.string()), ("key", pa.string()), ("unseen", pa.float64()), ("bonus", pa.float64())])


def misread(counts: Mapping[str, int]) -> dict[str, int]:
    """How often each character comes up when the corpus is read in every encoding as if it weren't UTF-8."""
    out: Counter = Counter()
    for char, n in counts.items():
        if not char.isascii():
            for name in READ_IN:
                for c in char.encode("utf-8", "surrogatepass").decode(name, "replace"):
                    out[c] += n
    return dict(out)


def _candidates(counts: dict[str, int], total: int, known: WordFilter):
    floor = math.log(max(total, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, garbled = CharModel(counts), CharModel(misread(counts))

        def unseen(part: str) -> float:
            return floor + sum(model.cost(c) for c in part) / 2

        def whole(chunk: str, channel: str, new: str) -> Iterator[tuple]:
            bonus = BYTE_GAIN * (len(chunk) - len(new)) if channel.startswith("utf-8") else 0.0
            yield (chunk, channel, 0, new, None, None, None, 0.0, bonus)
            for p in parts(new):
                yield (chunk, channel, None, None, p, None, None, unseen(p), bonus)

        def damaged(chunk: str, channel: str, text: str, name: str, path: list[tuple[int, int, str, bool]]) -> Iterator[tuple]:
            new = "".join(c for _, _, c, _ in path)
            bonus, at = BYTE_GAIN * (len(chunk) - len(new)), 0
            for seq, m in enumerate(_PART.finditer(new)):
                if m.start() > at:
                    yield (chunk, channel, 2 * seq, new[at : m.start()], None, None, None, 0.0, bonus)
                at = m.end()
                seen = path[m.start() : at]
                open_ = any(lost for *_, lost in seen) and not _DIGITS.search(m.group())
                part = _DIGITS.sub("0", m.group())
                yield (chunk, channel, 2 * seq + 1, m.group(), part, *((name, text[seen[0][0] : seen[-1][1]]) if open_ else (None, None)), unseen(part), bonus)
            if at < len(new):
                yield (chunk, channel, 1 << 30, new[at:], None, None, None, 0.0, bonus)

        def twice(chunk: str, text: str, inner: str) -> Iterator[tuple]:
            """UTF-8 that was read wrongly twice: the outer lattice prefers what a wrong reading makes of the corpus."""
            for name in READ_IN:
                path = lattice_path(text, name, garbled)
                if not path:
                    continue
                mid = "".join(c for _, _, c, _ in path)
                if LOST not in mid:
                    for channel, new in readings(mid, 1):
                        if channel.startswith("utf-8") and LOST not in new:
                            yield from whole(chunk, f"{channel}, then {name}{inner}", new)
                    continue
                for first in READ_IN:
                    under = lattice_path(mid, first, model)
                    if under:
                        yield from damaged(chunk, f"utf-8 as {first}, then {name}{inner}", mid, first, under)

        for batch in batches:
            rows: list[tuple] = []
            for chunk in batch["key"].to_pylist():
                before = len(rows)
                for channel, new in [("", chunk), *readings(chunk)] if LOST in chunk else readings(chunk):
                    if LOST in new:
                        inner = f", then {channel.removeprefix('utf-8 as ')}" if channel else ""
                        for name in READ_IN:
                            path = lattice_path(new, name, model)
                            if path:
                                rows += damaged(chunk, f"utf-8 as {name}{inner}", new, name, path)
                        rows += twice(chunk, new, inner)
                    elif channel and (channel.startswith("utf-8") or all(p.isascii() or p in known for p in parts(new))):
                        rows += whole(chunk, channel, new)
                if len(rows) > before:
                    rows += whole(chunk, "", chunk)
            cols = list(zip(*rows, strict=True)) or [[]] * len(_PIECES)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _PIECES, strict=True)], schema=_PIECES)

    return run


def _garbled_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each word becomes where its UTF-8 is read in an encoding that doesn't define all of its bytes."""
    for batch in batches:
        rows = []
        for word, n in zip(batch["key"].to_pylist(), batch["n"].to_pylist(), strict=True):
            raw = word.encode("utf-8", "surrogatepass")
            for name in READ_IN:
                if _table(name)[1]:
                    seen = raw.decode(name, "replace")
                    if LOST in seen:
                        rows.append((name, seen, word, n))
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.string(), pa.string(), pa.int64()], strict=True)], ["lossy", "key", "word", "n"])


def channel_gains(docs: DataFrame) -> DataFrame:
    """``chunk, options`` of each distinct chunk that another reading may explain better; ``docs`` has ``id, text``.

    An option is ``channel, gain, new``: the gain in nats over taking the chunk as it stands. Words with lost bytes are
    edges of the lattice too: the corpus word that the encoding turns into just what is seen, the commonest one if
    there are several, replaces the characters of the path, at the cost of the word.
    """
    parallel = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vocabulary = checkpoint(spread(docs.select("text")).mapInArrow(_count, "kind INT, key STRING, n BIGINT").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    words, chunks = vocabulary.filter("kind = 0"), vocabulary.filter("kind = 1")
    total = words.agg(F.sum("n")).first()[0] or 0
    chars = words.select(F.explode(F.split("key", "")).alias("c"), "n").groupBy("c").agg(F.sum("n").alias("n"))
    char_counts = {r["c"]: r["n"] for r in collect_small(chars, 1_200_000)}  # there are fewer code points
    common = words.filter(r"n >= 2 AND key RLIKE '[^\\x00-\\x7f]'")
    pieces = checkpoint(chunks.select("key").repartition(parallel, "key").mapInArrow(_candidates(char_counts, total, word_filter(common)), PIECES))

    needed = pieces.select("part").distinct().join(words.select(F.col("key").alias("part"), "n"), "part")
    # Few chunks have lost bytes; what their words can have been is looked up by what is seen.
    open_ = pieces.select("lossy", "key").filter("key IS NOT NULL").distinct()
    lossy = common.select("key", "n").mapInArrow(_garbled_words, "lossy STRING, key STRING, word STRING, n BIGINT")
    edges = lossy.join(open_, ["lossy", "key"]).groupBy("lossy", "key").agg(F.max(F.struct(F.col("n").alias("word_n"), "word")).alias("w")).select("lossy", "key", "w.word", "w.word_n")
    costed = salted_lookup(pieces.filter("key IS NULL"), needed, ["part"], ["chunk"], how="left").withColumns({"word": F.lit(None).cast("string"), "word_n": F.lit(None).cast("long")})
    holed = salted_lookup(salted_lookup(pieces.filter("key IS NOT NULL"), needed, ["part"], ["chunk"], how="left"), edges, ["lossy", "key"], ["chunk"], how="left")
    n = F.coalesce("word_n", "n", F.lit(0))
    known = n >= 2
    cost = F.when(F.col("part").isNull(), 0.0).when(known, -F.log(n / F.lit(float(max(total, 1))))).otherwise(F.col("unseen"))
    each = (
        costed.unionByName(holed).groupBy("chunk", "channel", "bonus")
        .agg(F.sum(cost).alias("cost"), F.min(F.coalesce(known | F.col("part").isNull(), F.lit(False))).alias("known"), F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("seq", F.coalesce("word", "text").alias("text"))))).alias("texts"))
        .withColumn("new", F.array_join(F.transform("texts", lambda x: x["text"]), ""))
    )
    is_utf8 = F.col("channel").startswith("utf-8")
    by_chunk = each.groupBy("chunk").agg(
        F.max(F.when(F.col("channel") == "", F.col("cost"))).alias("plain"),
        F.collect_list(F.when((F.col("channel") != "") & (is_utf8 | F.col("known")), F.struct("channel", (F.col("bonus") - F.col("cost")).alias("gain"), "new"))).alias("options"),
    )
    least = lambda x: F.when(x["channel"].startswith("utf-8"), 0.0).otherwise(LEAST_OTHER)
    gained = F.transform("options", lambda x: F.struct(x["channel"].alias("channel"), (x["gain"] + F.col("plain")).alias("gain"), x["new"].alias("new")))
    better = by_chunk.select("chunk", F.filter(gained, lambda x: x["gain"] > least(x)).alias("options")).filter("size(options) > 0")
    # That a byte was lost is proof of a wrong reading, whichever it was: among the readings of such a chunk the words decide.
    sure = better.withColumn("options", F.transform("options", lambda x: F.struct(x["channel"].alias("channel"), (x["gain"] + _certain("chunk")).alias("gain"), x["new"].alias("new"))))
    return sure.unionByName(_eight_bit(chunks, vocabulary)).groupBy("chunk").agg(F.flatten(F.collect_list("options")).alias("options"))


def _certain(chunk: str) -> Column:
    return F.when(F.col(chunk).contains(LOST), LOST_GAIN).otherwise(0.0)


def _eight_bit(chunks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The option of chunks whose 8-bit bytes were read as UTF-8, where a replacement character stands for any character
    beyond ASCII: the commonest whole chunk of the corpus that fits, else its words one by one. Replacement characters
    alone fit anything and stay."""
    word = r"[\p{L}\p{M}\p{Nd}\x{FFFD}]*\x{FFFD}[\p{L}\p{M}\p{Nd}\x{FFFD}]*"
    holed = chunks.filter(F.col("key").contains(LOST)).select(F.col("key").alias("chunk"), F.explode(F.concat(F.array("key"), F.array_distinct(F.regexp_extract_all("key", F.lit(word), 0)))).alias("run"))
    whole = F.max_by("key", F.struct("n", "key")).alias("word")
    shape = vocabulary.filter("key RLIKE '[^\\\\x00-\\\\x7f]' AND key RLIKE '[A-Za-z0-9]'").filter(~F.col("key").contains(LOST)).withColumn("run", F.regexp_replace("key", r"[^\x00-\x7f]", LOST)).groupBy("run").agg(whole)
    filled = holed.join(shape, "run", "left").groupBy("chunk").agg(F.max(F.when(F.col("run") == F.col("chunk"), F.col("word"))).alias("all"), F.collect_list(F.struct("run", "word")).alias("runs"))
    mended = F.aggregate(F.sort_array("runs"), F.col("chunk"), lambda acc, x: F.coalesce(F.replace(acc, x["run"], x["word"]), acc))
    return filled.select("chunk", F.array(F.struct(F.lit("lost bytes").alias("channel"), F.lit(LOST_GAIN).alias("gain"), F.coalesce("all", mended).alias("new"))).alias("options"))


def best_path(options: list[dict[str, tuple[float, str]]]) -> list[str]:
    """Viterbi: the channel of each chunk, ``""`` where it stands as it is. To begin a wrong reading costs, to stay in it doesn't."""
    states = sorted({c for o in options for c in o})
    begin = np.array([0.0, *[BEGIN_UTF8 if c.startswith("utf-8") else 0.0 if c == "lost bytes" else BEGIN_OTHER for c in states]])
    score, back = np.where(np.arange(len(begin)) == 0, 0.0, -np.inf), []
    for o in options:
        gain = np.array([0.0, *[o[c][0] if c in o else 0.0 for c in states]])
        start = score.max() - begin
        stay = score >= start
        back.append(np.where(stay, np.arange(len(begin)), int(score.argmax())))
        score = np.where(stay, score, start) + gain
    now, out = int(score.argmax()), []
    for i in range(len(options) - 1, -1, -1):
        out.append(([""] + states)[now] if now == 0 or states[now - 1] in options[i] else "")
        now = int(back[i][now])
    return out[::-1]


HITS = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("pos", pa.int32()), ("chunk", pa.string()), ("new", pa.string()), ("channel", pa.string())])


def _decide(one: pa.Table) -> pa.Table:
    rows = sorted(one.to_pylist(), key=lambda r: r["pos"])
    options = [{o["channel"]: (o["gain"], o["new"]) for o in sorted(r["options"], key=lambda o: o["gain"])} for r in rows]
    hits = [{**r, "new": o[c][1], "channel": c} for r, o, c in zip(rows, options, best_path(options), strict=True) if c]
    return pa.Table.from_pylist([{n: h[n] for n in HITS.names} for h in hits], schema=HITS)


def garbled_chunks(documents: DataFrame, doc: str, text: str) -> DataFrame:
    """``id, row, pos, chunk, new, channel``: every garbled chunk of every document with its place among the chunks
    beyond ASCII, what it was and how it was misread.

    Null ids are kept as a document of their own text; null and ASCII texts hold nothing garbled. Words are counted
    over all documents. Only chunks with another reading leave their document, and hot chunks are looked up salted unless
    the table of gains is small enough, by its measured size, to be sent to every task.
    """
    docs = documents.select(F.col(f"`{doc}`").alias("id"), F.col(f"`{text}`").alias("text")).filter("text IS NOT NULL")
    gains = checkpoint(channel_gains(docs))
    beyond = F.expr(r"text RLIKE '[^\\x00-\\x7f]'")
    chunk = F.filter(F.regexp_extract_all("text", F.lit(CHUNK), 0), lambda c: c.rlike(r"[^\x00-\x7f]"))
    placed = docs.filter(beyond).select("id", F.xxhash64("text").alias("row"), F.posexplode(chunk).alias("pos", "chunk"))
    small = broadcast_if_small(gains)
    hits = placed.join(small, "chunk") if small is not None else salted_lookup(placed, gains, ["chunk"], ["id", "row", "pos"])
    return hits.groupBy("id", "row").applyInArrow(_decide, "id BIGINT, row BIGINT, pos INT, chunk STRING, new STRING, channel STRING")


def restore(documents: DataFrame, doc: str, text: str) -> DataFrame:
    """``id, text, restored, channels`` of each garbled document; lost characters without a fitting word stay as they are."""
    found = garbled_chunks(documents, doc, text).groupBy("id", "row").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("pos", "new")))).alias("new"), F.sort_array(F.collect_set("channel")).alias("channels"))
    docs = documents.select(F.col(f"`{doc}`").alias("id"), F.col(f"`{text}`").alias("text")).filter("text IS NOT NULL").withColumn("row", F.xxhash64("text")).dropDuplicates(["id", "row"])
    joined = docs.join(found, (docs["id"].eqNullSafe(found["id"])) & (docs["row"] == found["row"])).select(docs["id"], "text", "new", "channels")

    @F.pandas_udf("string")
    def mend(texts: pd.Series, news: pd.Series) -> pd.Series:
        out = []
        for t, new in zip(texts, news, strict=True):
            at = dict(new)
            count = itertools.count()
            out.append(_CHUNK.sub(lambda m: m.group() if m.group().isascii() else at.get(next(count), m.group()), t))  # noqa: B023
        return pd.Series(out)

    return joined.select("id", "text", mend("text", "new").alias("restored"), "channels")
