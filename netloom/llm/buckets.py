"""Comparing the rows of a bucket without emitting its pairs and without one task per bucket.

``compare_blocks`` cuts every bucket of more than ``limit`` rows into blocks by
hash and replicates its rows to pairs of blocks, so that any two rows of a
bucket meet in exactly one (key, low, high) group of bounded size: rows of
different blocks in the group of these two, rows of one block in (key, b, b).
``complete_groups`` then gives Python whole groups, many at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare_blocks(rows: DataFrame, key: str, spread: str, limit: int) -> DataFrame:
    """Rows of the buckets with two rows or more, with block, low and high; see above.

    ``spread`` is the column whose hash picks the block; it should differ between rows.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("rows_")).filter("rows_ > 1").withColumn("blocks", F.ceil(F.col("rows_") / limit).cast("int"))
    # rows of a hot bucket stay in the tasks they are in: the number of its blocks goes to them
    cut = join_unevenly(rows, sizes, [key], "rows_", least_hot(rows.count())).drop("rows_").withColumn("block", F.pmod(F.hash(spread, F.lit(17)), F.col("blocks")))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("blocks", "other")


#: A key with more than one in HOT_SHARE of all rows is never dealt to one task. No more than HOT_SHARE keys are, so they may be broadcast.
HOT_SHARE, HOT_LEAST = 4096, 1000


def least_hot(total: int) -> int:
    """With more rows than this, of ``total``, a key is hot."""
    return max(HOT_LEAST, total // HOT_SHARE)


def hot_keys(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """Those values of a column of hashes that more than ``limit`` rows have. Values in buckets of 16 bits that all
    together have no more are not counted one by one."""
    bucket = F.col(key).bitwiseAND(F.lit(0xFFFF << 24))
    heavy = [r[0] for r in rows.groupBy(bucket.alias("bucket")).count().filter(F.col("count") > limit).select("bucket").collect()]  # at most HOT_SHARE
    return rows.filter(bucket.isin(heavy)).groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > limit).select(key)


def join_unevenly(rows: DataFrame, facts: DataFrame, keys: list[str], n: str, limit: int) -> DataFrame:
    """``rows`` joined with one row of ``facts`` for each of the keys, which has the number of its rows in column n.

    Facts of hot keys are broadcast, so no task gets all rows of one; the others meet by a shuffle.
    """
    hot = F.broadcast(facts.filter(F.col(n) > limit))  # at most HOT_SHARE rows
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(facts.filter(F.col(n) <= limit), keys)
    return rows.join(hot, keys).unionByName(rest)


def by_group(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Deals rows out so that ``complete_groups`` sees each group of the keys together."""
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def complete_groups(frames: Iterator[pd.DataFrame], keys: list[str], at_least: int = 50_000) -> Iterator[pd.DataFrame]:
    """Frames of whole groups from a sorted partition: a group that a batch cuts is held back."""
    held: list[pd.DataFrame] = []
    rows = 0
    for frame in frames:
        if not len(frame):
            continue
        held.append(frame)
        rows += len(frame)
        if rows < at_least:
            continue
        frame = pd.concat(held, ignore_index=True)
        last = frame[keys].iloc[-1]
        same = (frame[keys] == last).all(axis=1).to_numpy()
        cut = int(len(frame) - same[::-1].argmin()) if not same.all() else 0
        if cut:
            yield frame.iloc[:cut].reset_index(drop=True)
        held, rows = [frame.iloc[cut:]], len(frame) - cut
    if held:
        yield pd.concat(held, ignore_index=True)


def group_bounds(frame: pd.DataFrame, keys: list[str]) -> list[tuple[int, int]]:
    """First row and end of every group of a sorted frame."""
    values = frame[keys]
    starts = (values != values.shift()).any(axis=1).to_numpy().nonzero()[0].tolist()
    return list(zip(starts, [*starts[1:], len(frame)]))
