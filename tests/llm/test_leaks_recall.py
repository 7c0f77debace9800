"""Recall of edited copies against the alignment of every document with every item."""

import random

import numpy as np
import pytest

from frameloom.llm import leaks

rng = random.Random(11)
SYLLABLES = ["ka", "lo", "mi", "ter", "sun", "ba", "rin", "do", "pel", "va", "gor", "shi", "ne", "tul", "ox"]
WORDS = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 5))) for _ in range(3000)]


def planted(every):
    items = [[rng.choice(WORDS) for _ in range(40)] for _ in range(60)]
    docs = []
    for item in items:
        edited = [rng.choice(WORDS) if rng.randrange(every) == 0 else w for w in item]
        docs.append([rng.choice(WORDS) for _ in range(30)] + edited + [rng.choice(WORDS) for _ in range(30)])
    # Other documents quote short phrases of the items, and one holds every third item as it is.
    for _ in range(60):
        doc = []
        for _ in range(10):
            q, i = rng.choice(items), rng.randrange(36)
            doc += [rng.choice(WORDS), *q[i : i + 4]]
        docs.append(doc)
    docs += [items[i] for i in range(0, 60, 3)]
    return [" ".join(i) for i in items], [" ".join(d) for d in docs]


@pytest.mark.parametrize("every", [8, 5, 4, 3])
def test_recall_of_edited_copies(spark, every):
    items, docs = planted(every)
    a, b = ([leaks.codes(leaks.normalised(t)) for t in texts] for texts in (items, docs))
    score = leaks._align([(x, y) for x in a for y in b]).reshape(len(a), len(b))
    truth = {(j, i) for i, j in zip(*np.nonzero(score >= leaks.MATCH * leaks.LEAST), strict=True)}
    got = leaks.find_leaks(spark.createDataFrame(list(enumerate(docs)), "d BIGINT, t STRING"), "d", "t", spark.createDataFrame(list(enumerate(items)), "i BIGINT, t STRING"), "i", "t")
    found = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    assert found <= truth
    recall = len(found & truth) / len(truth)
    print(f"one word in {every}: {len(truth)} pairs, recall {recall:.3f}")
    assert len(truth) > 60 and recall >= 0.9


def test_items_in_several_parts(spark):
    items, docs = planted(5)
    d, i = spark.createDataFrame(list(enumerate(docs)), "d BIGINT, t STRING"), spark.createDataFrame(list(enumerate(items)), "i BIGINT, t STRING")
    rows = lambda **more: {(r["doc_id"], r["item_id"], r["score"]) for r in leaks.find_leaks(d, "d", "t", i, "i", "t", **more).collect()}
    assert {r[:2] for r in rows(part_chars=3000)} >= {r[:2] for r in rows()}
