"""Truncation of every text, not of plain ASCII only: brute force over all documents."""

from collections import Counter

import duckdb
from compare import DATA

from frameloom.plans import catalogue

Q = catalogue.core().queries


def test_truncation_of_all_texts(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    got = Q["c04_truncate"](spark, DATA).collect()
    assert Counter(map(tuple, got)) == Counter((i, t[:200] + "...[truncated]" if t is not None and len(t) > 200 else t) for i, t in rows)
    assert any(t is None for _, t in rows) and any(t and not t[:200].isascii() and len(t) > 200 for _, t in rows)
