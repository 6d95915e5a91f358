from collections import Counter

from pyspark.sql import functions as F

from netloom.llm import buckets
from netloom.llm.buckets import compare_blocks


def test_every_pair_of_a_bucket_meets_once_and_a_hot_bucket_is_spread(spark, monkeypatch):
    monkeypatch.setattr(buckets, "HOT_LEAST", 50)
    rows = spark.range(0, 900, numPartitions=6).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 40).cast("long").alias("key"), F.col("id").alias("x"))
    met = compare_blocks(rows, "key", "x", 16).withColumn("task", F.spark_partition_id())
    found = met.collect()
    hot = Counter(r.task for r in found if r.key == 7)
    assert len(hot) >= 6 and max(hot.values()) <= 2 * sum(hot.values()) / len(hot)
    groups = {}
    for r in found:
        groups.setdefault((r.key, r.low, r.high), []).append((r.x, r.block))
    pairs = Counter()
    for (key, low, high), members in groups.items():
        assert len(members) <= 16 * 2 * 3
        for i, (x, a) in enumerate(members):
            for y, b in members[:i]:
                if low == high or a != b:
                    pairs[key, min(x, y), max(x, y)] += 1
    own = {}
    for r in rows.collect():
        own.setdefault(r.key, []).append(r.x)
    want = {(k, x, y) for k, v in own.items() for x in v for y in v if x < y}
    assert set(pairs) == want and set(pairs.values()) == {1}
