"""Edited copies of an item beside exact ones: what one document holds must not hide another."""

import random

from frameloom.llm import leaks


def test_an_exact_copy_does_not_hide_edited_ones(spark):
    rnd = random.Random(11)
    item = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(240))
    edited = {k: "".join("7" if i % k == k - 1 else c for i, c in enumerate(item)) for k in (20, 30, 40)}
    rows = [(1, item), *[(k, "before " + t + " after") for k, t in edited.items()]]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    items = spark.createDataFrame([(7, item)], "item_id BIGINT, text STRING")
    got = {r["doc_id"]: r for r in leaks.find_leaks(docs, "doc_id", "text", items, "item_id", "text").collect()}
    assert set(got) == {1, 20, 30, 40}
    for k in edited:
        assert got[k]["longest_run"] == k - 1 and got[k]["score"] >= 2 * 240 * (1 - 1 / k) - 3 * (240 // k)
    assert [r["doc_id"] for r in leaks.find_leaks(docs, "doc_id", "text", items, "item_id", "text", least_run=leaks.RUN).collect()] == [1]
