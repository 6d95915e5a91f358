import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from netloom.llm.manifest import COLUMNS, dataset_manifest, op11_manifest, proof_digest, verified

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes, arity):
    levels = [list(nodes)]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k : k + arity]) for k in range(0, len(levels[-1]), arity)])
    return levels


def lacking(levels, at, arity):
    """For each level the nodes left and right of the node's own."""
    out = []
    for level in levels[:-1]:
        first = at - at % arity
        out.append((level[first:at], level[at + 1 : first + arity]))
        at //= arity
    return out


def slow(rows, arity=2):
    """(doc_id, leaf, subroot, root, proof digest, folded root, verified) of every row (doc_id, source, lang, n_chars, text)."""
    parts = {}
    for r in rows:
        parts.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    names = sorted(parts, key=lambda x: (x is not None, (x or "").encode()))
    trees = {p: tree([x[2] for x in sorted(parts[p], key=lambda x: x[:3])], arity) for p in names}
    top = tree([trees[p][-1][0] for p in names], arity)
    out = []
    for k, p in enumerate(names):
        for at, (*_, leaf, row) in enumerate(sorted(parts[p], key=lambda x: x[:3])):
            path = lacking(trees[p], at, arity) + lacking(top, k, arity)
            node = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None:
                node = leaf_of((*row[:3], row[3] + 1, row[4]))
            for left, right in path:
                node = H(*left, node, *right)
            out.append((row[0], leaf, trees[p][-1][0], top[-1][0], H(*(x for left, right in path for x in left + right)), node, node == top[-1][0]))
    return out


def digest_rows(manifest):
    rows = verified(manifest).select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("p"), "folded_root", "verified").collect()
    return sorted(map(tuple, rows), key=str)


KIND = "doc_id long, source string, lang string, n_chars long, text string, part string, node int, at int, total int"


def odd_rows():
    r = random.Random(5)
    rows = [(k, r.choice(["a", "é", None]), r.choice(["en"] * 6 + ["de", "", "é", "z", None]), r.choice([k, None, -3]), r.choice([f"text {k}", "", None, "漢字", "same"])) for k in range(150)]
    rows += [rows[3]] * 40 + [(None, "s", "en", 1, "t"), (None, None, None, None, None), (7, "other", "en", 1, "same id"), (900, "s", "solo", 9, "x" * 200_000)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("levels", "arity"), [(1, 2), (3, 2), (10, 2), (2, 3)])
def test_against_whole_trees(spark, levels, arity):
    rows = odd_rows()
    docs = spark.createDataFrame([(*x, "mine", 1, 2, 3) for x in rows], KIND).repartition(5)
    got = digest_rows(dataset_manifest(docs, levels=levels, arity=arity))
    assert got == sorted(slow(rows, arity), key=str)
    assert {x[-1] for x in got} == {True, False}


def test_small_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "s", "en", 4, "text", None, None, None, None)], KIND)
    assert digest_rows(dataset_manifest(docs)) == slow([(1, "s", "en", 4, "text")])
    assert dataset_manifest(docs.limit(0)).count() == 0


def test_equal_rows_are_spread_over_ranges(spark):
    rows = [(1, "s", "en", 4, "text")] * 3000 + [(k, "s", "en", k, "t") for k in range(2, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert digest_rows(dataset_manifest(docs, levels=4)) == sorted(slow(rows), key=str)


def test_query_against_brute_force(spark, tiny):
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select(*COLUMNS).collect()]
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted(map(tuple, op11_manifest(spark, tiny).select(*names).collect()), key=str)
    assert got == sorted(slow(rows), key=str) and not all(x[-1] for x in got)
