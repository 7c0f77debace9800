"""How often each term occurs over all records, and in how many records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TERM = r"[\p{L}\p{N}]+"


def term_pairs(df: DataFrame, record: str, text: str) -> DataFrame:
    """``term, record, n``: how often a record holds a term; exact copies of a row count once.

    Terms are maximal runs of letters and numbers of the lower-cased text. Null, empty and wordless texts give no row.
    A null record id names no record and is left out; a record with several different texts holds the terms of all.
    """
    once = df.select(F.col(f"`{record}`").alias("record"), F.col(f"`{text}`").alias("text")).filter(F.col("record").isNotNull()).distinct()
    words = once.select("record", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(TERM), 0)).alias("term"))
    return words.groupBy("term", "record").agg(F.count(F.lit(1)).alias("n"))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length scan of sorted (term, record, n): a row for each run of a term; a run that a batch's end cuts gives
    two rows, which the final sum joins like the runs that a range's end cuts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        runs = pc.run_end_encode(batch["term"].cast(pa.string()), run_end_type=pa.int32())
        ends = runs.run_ends.to_numpy()
        starts = np.concatenate([[0], ends[:-1]])
        n = batch["n"].to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([runs.values, pa.array(np.add.reduceat(n, starts), pa.int64()), pa.array((ends - starts).astype(np.int64))], ["term", "occurrences", "records"])


def term_counts(df: DataFrame, record: str, text: str, partitions: int | None = None) -> DataFrame:
    """``term, occurrences, records`` of every term.

    External sort: pairs are ranged by (term, record), so that a term that fills a third of all pairs is cut over
    several ranges, sorted with spilling inside each range and scanned once; the few runs that a border cuts are summed.
    """
    pairs = term_pairs(df, record, text)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = pairs.repartitionByRange(n, "term", "record").sortWithinPartitions("term", "record")
    runs = ranged.select("term", "n").mapInArrow(_scan, "term STRING, occurrences BIGINT, records BIGINT")
    return runs.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def term_frequencies(df: DataFrame, record: str, text: str, min_records: int = 3, max_share: float = 0.15, partitions: int | None = None) -> DataFrame:
    """``term, occurrences, records, share, mark``: mark is ``rare`` below ``min_records`` records, ``common`` above
    ``max_share`` of all records (those without a text included), else null. No record gives no row."""
    total = df.select(F.count_distinct(F.col(f"`{record}`")).alias("_total"))  # one row: its cross product is a constant
    counts = term_counts(df, record, text, partitions).crossJoin(F.broadcast(total))
    share = F.col("records") / F.col("_total")
    mark = F.when(F.col("records") < min_records, "rare").when(F.col("records") > F.lit(max_share) * F.col("_total"), "common")
    return counts.select("term", "occurrences", "records", share.alias("share"), mark.alias("mark"))
