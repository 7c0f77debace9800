"""The counting row is the newest one even where it withdraws a frame; lookups of hot keys."""

import datetime

from pyspark.sql import functions as F

from frameloom.operators.skew import salted_lookup
from frameloom.plans import scalars


def test_a_newest_invalid_row_withdraws_the_frame(spark, tmp_path):
    at = [datetime.datetime(2025, 1, k) for k in (1, 2)]
    good = [float(i % 3) for i in range(63)]
    rows = [("a", 1, "s", good, True, at[0]), ("a", 1, "s", good, False, at[1]), ("a", 2, "s", good, True, at[0]), ("a", 3, "s", good, True, at[0]), ("a", 3, "s", [float("nan")] * 63, True, at[1]), ("a", 4, "s", None, True, at[0])]
    spark.createDataFrame(rows, "seq_id STRING, frame BIGINT, source STRING, hand_joints_3d ARRAY<FLOAT>, hand_valid BOOLEAN, ingested_at TIMESTAMP_NTZ").write.parquet(f"{tmp_path}/gtsequence.parquet")
    assert [r["frame"] for r in scalars._joints(spark, str(tmp_path)).collect()] == [2]


def test_lookup_of_hot_and_cold_keys(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") == 1, None).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(0, 3000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).union(spark.sql("SELECT 7L, 14L"))
    for how in ("inner", "left"):
        want = left.join(right, "k", how)
        got = salted_lookup(left, right, ["k"], ["id"], how=how)
        assert sorted(map(str, got.select("k", "id", "v").collect())) == sorted(map(str, want.select("k", "id", "v").collect()))
    assert salted_lookup(left.limit(0), right, ["k"], ["id"]).count() == 0
    even = spark.range(500).select(F.col("id").alias("k"), "id")
    assert salted_lookup(even, right, ["k"], ["id"]).count() == even.join(right, "k").count()
