"""The training-data operators on small cases: brute force, skew, nulls, ties, empty and clashing inputs."""

import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from compare import DATA, spark_rows, sql_rows

from frameloom.llm import events, leaks, mixing, mojibake, queries, splits, terms, tokens

R = queries.R


@pytest.mark.parametrize("name", sorted(R.sql))
def test_matches_sql(spark, name):
    df = R.queries[name](spark, DATA)
    assert spark_rows(df) == sql_rows(R.sql[name], df.columns)


@pytest.mark.parametrize("name", sorted(set(R.queries) - set(R.sql)))
def test_runs(spark, name):
    df = R.queries[name](spark, DATA)
    assert df.columns and df.count() >= 0


# Terms


def test_terms_brute_force(spark):
    rnd = random.Random(1)
    words = ["the", "Tür", "naïve", "x2", "开手", "l'eau", "A_B", "ГРУША", "½", "", "null"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 9))) or None, "y", 1) for i in range(300)]
    rows += rows[:40] + [(None, "ghost", "y", 1), (7, "the " * 20000, "y", 1), (400, None, "y", 1), (401, "...", "y", 1)]
    df = spark.createDataFrame(rows, "id BIGINT, text STRING, term STRING, record INT")
    got = {r["term"]: (r["occurrences"], r["records"], r["mark"]) for r in terms.term_frequencies(df, "id", "text", partitions=7).collect()}
    occ, rec = Counter(), {}
    for i, t, *_ in set(rows):
        if i is not None and t is not None:
            for w in "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in t.lower()).split():
                occ[w] += 1
                rec.setdefault(w, set()).add(i)
    n = len({r[0] for r in rows if r[0] is not None})
    assert got == {w: (occ[w], len(rec[w]), "rare" if len(rec[w]) < 3 else "common" if len(rec[w]) > 0.15 * n else None) for w in occ}


def test_terms_empty(spark):
    assert terms.term_frequencies(spark.createDataFrame([], "id BIGINT, text STRING"), "id", "text").count() == 0


# Events


def brute_runs(rows):
    out, last = [], None
    for e, p, s in sorted(rows):
        if last and last[0] == e and last[3] == p - 1 and last[1] == s:
            last[3] = p
        else:
            last = [e, s, p, p]
            out.append(last)
    return sorted((e, s, a, b) for e, s, a, b in out)


@pytest.mark.parametrize("block", [8, 4096])
def test_runs_over_blocks(spark, block):
    rnd = random.Random(block)
    state, rows = 0, []
    for p in range(-40, 1200):
        state = state if rnd.random() > 0.2 else 1 - state
        if rnd.random() > 0.03:
            rows.append(("hot", p, state if rnd.random() > 0.02 else None))
    rows += [("b", p, p % 2) for p in range(50)] + [("c", 5, 1)] + [(None, 1, 1), ("d", None, 1)]
    df = spark.createDataFrame([(*r, 0, "z") for r in rows + rows[:30]], "e STRING, p INT, s INT, block INT, entity STRING")
    got = events.collapse_runs(df, "e", "p", ["s"], block=block)
    assert sorted((r["entity"], r["state"], r["first"], r["last"]) for r in got.collect()) == brute_runs([r for r in rows if None not in r])


def plain_optimum(states, penalty):
    """Least cost of a stretch by trying both labels at every event."""
    cost = [0.0, 0.0]
    for s in states:
        cost = [min(cost[k], cost[1 - k] + penalty) + (s != k) for k in (0, 1)]
    return min(cost)


@pytest.mark.parametrize("block", [8, 64, 4096])
def test_near_identical_is_optimal(spark, block):
    rnd = random.Random(3)
    rows, series = [], {}
    for e in "abcd":
        state, s = 0, []
        for _ in range(500):
            state = state if rnd.random() > 0.04 else 1 - state
            s.append(state if rnd.random() > 0.1 else 1 - state)
        series[e] = s
        rows += [(e, p, x) for p, x in enumerate(s)]
    got = events.collapse_runs(spark.createDataFrame(rows, "e STRING, p INT, s INT"), "e", "p", ["s"], penalty=2.5, block=block).collect()
    for e, s in series.items():
        mine = sorted((r for r in got if r["entity"] == e), key=lambda r: r["first"])
        assert [r["first"] for r in mine] == [0] + [r["last"] + 1 for r in mine[:-1]] and mine[-1]["last"] == 499
        cost = sum(sum(x != r["state"] for x in s[r["first"] : r["last"] + 1]) for r in mine)
        assert cost == sum(r["cost"] for r in mine)
        assert cost + 2.5 * (len(mine) - 1) == pytest.approx(plain_optimum(s, 2.5))


def test_runs_empty_and_newest_row(spark):
    assert events.collapse_runs(spark.createDataFrame([], "e STRING, p INT, s INT"), "e", "p", ["s"]).count() == 0
    df = spark.createDataFrame([("a", 1, 0, 1), ("a", 1, 1, 2), ("a", 2, 1, 1), ("a", 2, 1, None)], "e STRING, p INT, s INT, o INT")
    assert [(r["state"], r["first"], r["last"]) for r in events.collapse_runs(df, "e", "p", ["s"], order="o").collect()] == [(1, 1, 2)]


# Mixing


def test_water_fill():
    took = mixing.water_fill({"a": 100, "b": 10, "c": 100}, {"a": 0.4, "b": 0.4, "c": 0.2}, {"a": 1, "b": 2, "c": 1}, 120)
    assert took["b"] == 20 and took["a"] == pytest.approx(100 * 0.4 / 0.6) and took["c"] == pytest.approx(100 * 0.2 / 0.6)
    assert mixing.water_fill({}, {"a": 1.0}, {"a": 3}, 10) == {"a": 0.0}
    full = mixing.water_fill({"a": 5, "b": 5}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 1}, 100)
    assert full == {"a": 5.0, "b": 5.0}


def test_mix_reaches_targets(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice([" Hot", "hot", "HOT ", "mid"]) if i % 9 else "tiny", rnd.randrange(1, 50), "u", 1) for i in range(4000)]
    rows += rows[:100] + [(9001, None, 5, "u", 1), (9002, "hot", None, "u", 1), (9003, "hot", -4, "u", 1), (9004, "other", 5, "u", 1), (None, "hot", 3, "u", 1)]
    df = spark.createDataFrame(rows, "id BIGINT, source STRING, frames BIGINT, uses STRING, size INT")
    targets = spark.createDataFrame([("hot", 0.3, 1), ("mid", 0.3, 2), ("tiny", 0.4, 3), ("none", 0.1, 4), (None, 0.1, 1)], "source STRING, target_share DOUBLE, max_repeats INT")
    chosen, report = mixing.mix(df, "source", "frames", ["id"], targets, buckets=64)
    got = chosen.collect()
    caps = {"hot": 1, "mid": 2, "tiny": 3}
    assert all(1 <= r["uses"] <= caps[r["source"]] for r in got)
    assert len({(r["id"], r["source"], r["size"]) for r in got}) == len(got)
    for r in report.collect():
        assert abs(r["size_used"] - r["size_planned"]) <= 50 * 3
        assert r["most_uses"] <= r["max_repeats"]
    again = mixing.mix(df.orderBy("frames"), "source", "frames", ["id"], targets, buckets=64)[0].collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_mix_empty(spark):
    targets = spark.createDataFrame([("hot", 1.0, 1)], "source STRING, target_share DOUBLE, max_repeats INT")
    chosen, report = mixing.mix(spark.createDataFrame([], "id BIGINT, source STRING, frames BIGINT"), "source", "frames", ["id"], targets)
    assert chosen.count() == 0 and report.first()["share"] == 0.0


# Splits


def union_find(rows):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for e, s, i in rows:
        if e is not None:
            root(("e", e))
            if s is not None and i is not None:
                parent[root(("e", e))] = root(("r", s, i))
    groups = {}
    for e, *_ in rows:
        if e is not None:
            groups.setdefault(root(("e", e)), []).append(e)
    return {e: min(g) for g in groups.values() for e in g}


def test_groups_brute_force(spark):
    rnd = random.Random(2)
    rows = [(rnd.randrange(3000), "hot", 1) if rnd.random() < 0.1 else (rnd.randrange(3000), rnd.choice("abc"), rnd.randrange(900)) for _ in range(2500)]
    rows += [(5000 + k + d, "chain", k) for k in range(60) for d in (0, 1)]  # one chain of 61 episodes
    rows += [(9000, None, 1), (9001, "a", None), (None, "a", 3), (9002, None, None), (9002, "a", 1)] + rows[:50]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "e BIGINT, s STRING, i BIGINT, id INT, low INT, root INT")
    got = {r["record"]: r["root"] for r in splits.related_groups(df, "e", ["s", "i"]).collect()}
    assert got == union_find(rows)


def test_splits_keep_groups_and_shares(spark):
    sizes = [1] * 3000 + [7] * 200 + [40] * 30 + [600]
    at, rows = 0, []
    for s in sizes:
        rows += [(at + k, at) for k in range(s)]
        at += s
    df = spark.createDataFrame(rows, "record BIGINT, root BIGINT")
    targets = {"train": 0.8, "validation": 0.1, "test": 0.1}
    got = splits.assign_splits(df, targets)
    by = got.groupBy("split").count().collect()
    assert sum(r["count"] for r in by) == len(rows)
    for r in by:
        assert abs(r["count"] / len(rows) - targets[r["split"]]) < 0.02
    assert got.select("root", "split").distinct().count() == len(sizes)


def test_balanced_bins_are_whole_and_even():
    sizes = Counter({1: 5000, 3: 400, 50: 20, 900: 1})
    bins = splits.balanced_bins(sizes, 16)
    weights = [sum(s * n for s, n in b.items()) for b in bins]
    assert sum(bins, Counter()) == sizes and len(bins) == 16
    rest = [w for w in weights if w != max(weights)]
    assert max(rest) - min(rest) <= 50
    assert splits.balanced_bins({}, 4) == []


def test_splits_empty(spark):
    df = spark.createDataFrame([], "e BIGINT, s STRING, i BIGINT")
    groups = splits.related_groups(df, "e", ["s", "i"])
    assert groups.count() == 0
    assert splits.assign_splits(groups, {"a": 1.0}).count() == 0


# Tokens


def reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return [t.encode(x, add_special_tokens=False).ids if x else [] for x in texts]


def hard_texts():
    rnd = random.Random(4)
    pick = lambda what, n: "".join(rnd.choice(what) for _ in range(n))
    return [None, "", " ", "\n\n  x", "<|endoftext|>", "it's we'll 12ab  \t end ", pick("abcdefgh", 5000), "a" * 4097, pick("开这手的一中文éß", 3000), pick("0123456789", 3000), " " * 3000 + "x", pick(["the", "un", "'s", " ", "12", "👍", "\n", "!", "ß"], 3000), "İstanbul ﬁ Å"]


def test_tokens_exact_on_any_segment(spark):
    texts = hard_texts()
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in enumerate(texts)] + [(99, texts[6], "a", 1), (99, texts[6], "a", 1), (None, "null id", "a", 1)], "id BIGINT, text STRING, segment STRING, row INT")
    for size in (64, 1000, 1 << 16):
        got = tokens.encode(df.withColumnRenamed("id", "doc_id"), "doc_id", "text", segment_chars=size).collect()
        by = {r["doc_id"]: r["ids"] for r in got}
        assert len(got) == len(texts) + 3
        assert [by[i] for i in range(len(texts))] == reference(texts)
        assert sum(r["doc_id"] == 99 for r in got) == 2 and by[99] == by[6]


def test_tree_and_glue_are_exact():
    e, rnd = tokens.Encoder(leaf=64), random.Random(9)
    texts = [t for t in hard_texts() if t]
    for text, want in zip(texts, reference(texts), strict=True):
        assert e.text(text) == want
        for size in (1, 7, 50, 333):
            parts = [e.text(text[i : i + size]) for i in range(0, len(text), size)]
            assert e.glue(parts) == want, (text[:40], size)
    assert rnd


def test_tokens_empty(spark):
    assert tokens.encode(spark.createDataFrame([], "doc_id BIGINT, text STRING"), "doc_id", "text").count() == 0


# Leaks


def test_leaks_brute_force(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(2, 9)))
    shared = " ".join(word() for _ in range(14))
    items = [(i, " ".join(word() for _ in range(20)) + (" " + shared if i < 3 else "")) for i in range(12)] + [(50, "too short"), (51, None), (52, ""), (53, "a" * 200)]
    docs = []
    for k in range(200):
        text = " ".join(word() for _ in range(60))
        if k % 4 == 0:
            src = leaks.normalised(rnd.choice(items[:12])[1])
            n = rnd.choice([59, 60, 61, 90])
            a = rnd.randrange(0, max(1, len(src) - n))
            piece = src[a : a + n]
            style = k % 3
            piece = piece.upper() if style == 0 else "-".join(piece) if style == 1 else "".join(chr(ord(c) + 0xFEE0) for c in piece)
            text = text + " " + piece + " " + text
        docs.append((k, text))
    docs += [(300, None), (301, ""), (None, items[0][1]), (302, "a" * 50000), (303, items[5][1] * 300), (304, items[0][1].replace("e", "é"))]
    d = spark.createDataFrame([(*x, 1, "q") for x in docs], "doc_id BIGINT, text STRING, item_id INT, id STRING")
    i = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    found = leaks.find_leaks(d, "doc_id", "text", i, "item_id", "text").collect()
    want = set()
    for k, t in docs:
        n = leaks.normalised(t or "")
        for j, it in items:
            m = leaks.normalised(it or "")
            if k is not None and any(m[p : p + 60] in n for p in range(len(m) - 59)):
                want.add((k, j))
    assert {(r["doc_id"], r["item_id"]) for r in found if r["longest_run"] >= 60} == want
    assert all(r["score"] >= 2 * min(r["longest_run"], 40) for r in found)


def test_smith_waterman_score():
    c = leaks.codes
    assert leaks._align([(c("abcdef"), c("xxabcdefyy"))])[0] == 12
    assert leaks._align([(c("abcdef"), c("abcxdef"))])[0] == 12 + leaks.GAP
    assert leaks._align([(c("abcdef"), c("qrstuv"))])[0] == 0


def test_edited_copies_are_reported(spark):
    text = "the wearer turns the marulpex dial twice and leaves the gribemar tray beside the vornorra bolt"
    edited = text.replace("twice", "thrice").replace("tray", "box").replace("wearer", "person")
    docs = spark.createDataFrame([(1, "before " + edited + " after")], "doc_id BIGINT, text STRING")
    items = spark.createDataFrame([(7, text)], "item_id BIGINT, text STRING")
    r = leaks.find_leaks(docs, "doc_id", "text", items, "item_id", "text").first()
    assert r["item_id"] == 7 and r["longest_run"] < 60 and r["coverage"] > 0.6


def test_leaks_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id BIGINT, text STRING"), spark.createDataFrame([], "item_id BIGINT, text STRING")
    assert leaks.find_leaks(docs, "doc_id", "text", items, "item_id", "text").count() == 0


# Wrong decodings

CLEAN = {
    "de": "Die Schüssel fällt später über den Kühlschrank und öffnet die grüne Tür.",
    "fr": "La lumière change très tôt près de l’étagère, à côté du thé — 12° ± 3°.",
    "ru": "Человек берёт чайник и ставит его на верхнюю полку.",
    "pl": "Osoba obraca żółty młotek i odkłada go później na półkę, już około łóżka.",
    "zh": "佩戴者拿起红色篮子，然后放到架子上。",
}


def test_mojibake_found_and_restored(spark):
    clean = [(i, CLEAN[k]) for i, k in enumerate([*CLEAN] * 40)]
    tricks = {
        1000: ("de", lambda t: t.encode().decode("cp1252")), 1001: ("fr", lambda t: t.encode().decode("latin-1")), 1002: ("de", lambda t: t.encode().decode("cp437")),
        1003: ("ru", lambda t: t.encode("cp1251").decode("latin-1")), 1004: ("ru", lambda t: t.encode("koi8-r").decode("cp1251")), 1005: ("pl", lambda t: t.encode("cp1250").decode("cp1252")),
        1006: ("de", lambda t: t.encode().decode("cp1252").encode().decode("cp1252")), 1007: ("zh", lambda t: t.encode("gbk").decode("latin-1")), 1008: ("fr", lambda t: t.encode().decode("mac_roman")),
    }
    rows = clean + [(k, f(CLEAN[lang])) for k, (lang, f) in tricks.items()]
    rows += [(2000, CLEAN["de"].encode("cp1252").decode("utf-8", "replace")), (2001, "VERSÃO 49: SÃO 12 QUADROS, ÂNGULO «RÉSUMÉ»"), (2002, None), (2003, ""), (2004, "├── data  √ checked"), (2005, "plain"), (2005, "plain"), (2006, "x" * 200000)]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id BIGINT, text STRING, pos INT, chunk STRING")
    got = {r["id"]: r["restored"] for r in mojibake.restore(df, "doc_id", "text").collect()}
    assert set(got) == {*tricks, 2000}
    for k, (lang, _) in tricks.items():
        assert got[k] == CLEAN[lang], k
    assert got[2000] == CLEAN["de"]


def test_mojibake_empty(spark):
    assert mojibake.garbled_chunks(spark.createDataFrame([], "doc_id BIGINT, text STRING"), "doc_id", "text").count() == 0


def test_viterbi_enters_a_reading_only_for_enough_gain():
    weak, strong = {"utf-8 as cp1252": (2.0, "x")}, {"utf-8 as cp1252": (4.0, "x")}
    assert mojibake.best_path([weak]) == [""]
    assert mojibake.best_path([strong]) == ["utf-8 as cp1252"]
    assert mojibake.best_path([weak, {}, weak]) == ["utf-8 as cp1252", "", "utf-8 as cp1252"]


def test_hash_of_grams_is_positional():
    c = leaks.codes("abcabd")
    h = leaks.gram_hashes(c, 3)
    assert len(h) == 4 and len(set(h.tolist())) == 4
    assert leaks.gram_hashes(leaks.codes("zzabc"), 3)[2] == h[0]
    assert re.fullmatch(r"[0-9]+", str(int(np.max(h))))
