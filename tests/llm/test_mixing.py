from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from netloom.llm.mixing import copies_of, entropy_balance, mix_sources, op6_mixing, plan_mix


def targets_of(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        whole = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / whole > most * sizes[s]}
        if not over:
            out |= {s: left * weight[s] / whole for s in open_}
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def check(rows, longest_share):
    """rows: source, size, source_size, target, taken."""
    sizes, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for s, size, *_, t in rows:
        sizes[s] += size
        taken[s] += t
        longest[s] = max(longest[s], size)
        assert t <= 2 * size and (size == 0 or t % size == 0)
    want = targets_of(sizes)
    for s, size, source_size, target, _ in rows:
        assert source_size == sizes[s] and target == pytest.approx(want[s])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(2, longest_share * longest[s])


def test_targets_and_copies_of_odd_tables(spark):
    docs = [(k, "w " * (k % 23), ["b", "a", None, "é", "Z"][k % 5]) for k in range(200)] + [(300, None, "a"), (301, "", "empty"), (7, "w w", "b"), (7, "w w", "b"), (None, "w " * 9, "b"), (400, "long " * 40000, "é")]
    frame = spark.createDataFrame([(*d, "k", 1, 2) for d in docs], "doc_id long, text string, source string, key string, size int, hash int")
    slim, classes, sources = plan_mix(frame)
    rows = copies_of(slim, classes).join(sources, "key").select("source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
    first = sorted(map(tuple, rows.collect()), key=str)
    check(first, 0.5)
    slim, classes, sources = plan_mix(frame.repartition(7))
    again = copies_of(slim, classes).join(sources, "key").select("source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
    assert sorted(map(tuple, again.collect()), key=str) == first
    mixed = mix_sources(frame)
    assert mixed.columns == frame.columns
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == sum(r[4] for r in first)
    assert mix_sources(frame.limit(0)).count() == 0


def test_two_groupings_are_balanced_together(spark):
    cells = spark.createDataFrame([("a", "x", 100), ("a", "y", 300), ("b", "x", 200), ("b", "y", 400)], "source string, lang string, size long")
    source = spark.createDataFrame([("a", 500.0), ("b", 400.0)], "source string, target double")
    lang = spark.createDataFrame([("x", 600.0), ("y", 300.0)], "lang string, target double")
    rates = entropy_balance(cells, {"source": source, "lang": lang}, tolerance=1e-10)
    for key, want in (("source", {"a": 500, "b": 400}), ("lang", {"x": 600, "y": 300})):
        got = rates.groupBy(key).agg(F.sum(F.col("size") * F.exp("log_rate"))).collect()
        assert {r[0]: r[1] for r in got} == pytest.approx(want)


def test_query(spark, tiny):
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    check([(source[r.doc_id], r["size"], r.source_size, r.target, r.taken) for r in op6_mixing(spark, tiny).collect()], 0.2)


def test_many_equal_rows_in_one_class(spark):
    """Of rows that are equal in all, some get an odd copy, so that the target is met."""
    docs = [(7, "w " * 8, "a")] * 1000 + [(k, "x " * 40, "b") for k in range(400)] + [(9, "y", "b")] * 10
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5)
    slim, classes, sources = plan_mix(frame)
    rows = copies_of(slim, classes).join(sources, "key").select("source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
    found = list(map(tuple, rows.collect()))
    assert len(found) == len(docs)
    check(found, 0.5)
    mixed = mix_sources(frame).groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " ")))).collect()
    assert dict(map(tuple, mixed)) == {s: sum(r[4] for r in found if r[0] == s) for s in "ab"}


def test_moves_end_when_none_helps(spark):
    """One long document and many short ones: the last words come from the short ones, many at once."""
    docs = [(0, "long " * 5000, "a")] + [(k, "w", "a") for k in range(1, 4000)] + [(k, "w " * 300, "b") for k in range(5000, 5040)]
    slim, classes, sources = plan_mix(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    taken = copies_of(slim, classes).groupBy("key").agg(F.sum(F.col("copies") * F.col("size")).alias("taken")).join(sources, "key").collect()
    assert all(abs(r.taken - r.target) <= (1 if r.key == "sa" else 150) for r in taken)
