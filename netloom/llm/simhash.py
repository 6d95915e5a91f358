"""SimHash near-duplicates by pivot distance tables.

The fingerprint of a document has bit b if more than half of its shingle hashes
have it. Two fingerprints at Hamming distance t have distances to any reference
fingerprint that differ by t at most, so a table of distances to many references
discards pairs by the maximum difference of a coordinate before they are
compared.

Distances to unrelated references spread too little (a standard deviation of 4)
to find candidates among many fingerprints, so the references come in families.
A family belongs to one block of bit positions: zero and, for every bit of the
block, the fingerprint with that bit alone. Its coordinates tell the block. A
pair that differs in ``max_distance`` bits agrees on all coordinates of at least
``blocks - max_distance`` families, so rows meet on the coordinates of every
choice of so many families (20 choices of 3 out of 6, about 32 bits each), which
loses no pair. Within a bucket the table of further references discards, and an
exact comparison verifies.

Equal fingerprints are one node throughout. A bucket emits the edges of a
spanning forest, at most one less than its rows, never its pairs; a large bucket
is compared block by block in several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.buckets import by_group, compare_blocks, complete_groups, group_bounds, join_unevenly, least_hot
from netloom.llm.components import connected_components
from netloom.llm.session import checkpoint, table
from netloom.llm.text import LOWER_ASCII, encode

BITS = 64
BLOCKS = 6
MAX_DISTANCE = 3
#: Rows of a bucket that are compared in one group.
BLOCK_ROWS = 256
#: Further references of the pivot table, from a fixed generator.
REFERENCES = np.random.default_rng(64).integers(0, 1 << 64, 16, dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of one text as an unsigned 64-bit number; zero without words."""
    words = encode(text).translate(LOWER_ASCII).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    first_end = min(shingle, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[first_end:])], np.uint64)
    n = len(hashes)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 65536):  # a long text is counted in pieces
        ones += np.unpackbits(hashes[at : at + 65536, None].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, mark (a hash of id and text) and fp, the fingerprint as a signed long, for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, shingle) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints)], names=["doc_id", "mark", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("mark"), "text").mapInArrow(run, "doc_id long, mark long, fp long")


def family_masks(blocks: int = BLOCKS) -> list[int]:
    """The bit positions of each family of references, as masks of nearly equal width."""
    edges = [round(k * BITS / blocks) for k in range(blocks + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]


def family_keys(fp: Column, blocks: int = BLOCKS, max_distance: int = MAX_DISTANCE) -> Column:
    """An array of bucket keys, one for each choice of families.

    The distances to zero and to the single-bit references of a family differ by
    +1 where the bit is set and by -1 where it is not, so equal coordinates are
    equal bits and the key holds the bits themselves, with the choice.
    """
    masks = family_masks(blocks)
    keys = []
    for number, choice in enumerate(combinations(masks, blocks - max_distance)):
        mask = sum(choice)
        keys.append(F.xxhash64(fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")), F.lit(number)))
    return F.array(*keys)


def pivot_table(fps: np.ndarray, references: np.ndarray = REFERENCES) -> np.ndarray:
    """Hamming distances of fingerprints to the references, a row for each fingerprint."""
    return np.bitwise_count(fps[:, None] ^ references[None, :]).astype(np.int8)


def forest(fps: np.ndarray, max_distance: int = MAX_DISTANCE) -> list[tuple[int, int]]:
    """Positions of the edges of a spanning forest of the pairs within max_distance."""
    n = len(fps)
    table_ = pivot_table(fps)
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    edges = []
    for i in range(n - 1):
        near = np.arange(i + 1, n)
        for c in range(table_.shape[1]):  # a coordinate at a time: few rows are left after some
            near = near[np.abs(table_[near, c] - table_[i, c]) <= max_distance]
            if not len(near):
                break
        else:
            for j in near[np.bitwise_count(fps[near] ^ fps[i]) <= max_distance].tolist():
                a, b = find(i), find(j)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    edges.append((i, j))
    return edges


def near_edges(fps: DataFrame, blocks: int = BLOCKS, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Edges a, b between the distinct fingerprints ``fp`` that connect all pairs within max_distance."""
    keyed = fps.select("fp", F.explode(family_keys(F.col("fp"), blocks, max_distance)).alias("key"))
    keys = ["key", "low", "high"]
    met = by_group(compare_blocks(keyed, "key", "fp", BLOCK_ROWS), keys)

    def link(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in complete_groups(frames, keys):
            fp = frame["fp"].to_numpy(np.int64)
            a, b = [], []
            for start, end in group_bounds(frame, keys):
                if end - start > 1:
                    for i, j in forest(fp[start:end].view(np.uint64), max_distance):
                        a.append(fp[start + i])
                        b.append(fp[start + j])
            yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return met.select("key", "low", "high", "fp").mapInPandas(link, "a long, b long").distinct()


def _components(docs: DataFrame, shingle: int, blocks: int, max_distance: int) -> DataFrame:
    """doc_id, mark, fp and component_id of every row; component is a fingerprint that names it."""
    if blocks <= max_distance:
        raise ValueError("more families than differing bits are needed")
    prints = checkpoint(with_fingerprints(docs, shingle))
    nodes = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    edges = near_edges(nodes.select("fp"), blocks, max_distance)
    roots = connected_components(edges, "a", "b").withColumnsRenamed({"node": "fp"})
    linked = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    fps = linked.join(named, "root").select("fp", "n", F.col("root").alias("component"), "component_id")
    total = nodes.agg(F.sum("n")).first()[0] or 0
    return join_unevenly(prints, fps, ["fp"], "n", least_hot(total)).drop("n")


def simhash_components(docs: DataFrame, *, shingle: int = 3, blocks: int = BLOCKS, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable) for every row.

    Null and empty texts have fingerprint zero and link like any other; repeated
    rows give a row each; rows whose doc_id is null take part but never name a
    component; an empty table gives no rows; other columns are ignored.
    """
    found = _components(docs, shingle, blocks, max_distance)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, *, shingle: int = 3, blocks: int = BLOCKS, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """One row of ``docs`` for each component, the one with the smallest doc_id (a null id only if the
    component has no other; among rows of one id the text with the smallest hash, among rows with one id
    and text the one that is first as JSON). Columns are those of ``docs``, whatever their names."""
    found = _components(docs, shingle, blocks, max_distance)
    chosen = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")
    first = checkpoint(found.groupBy("component").agg(F.min(chosen).alias("row"), F.count("*").alias("n")).select(F.col("row.doc_id").alias("stay_id"), F.col("row.mark").alias("stay_mark"), "n"))
    packed = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("doc_id", "text").alias("mark"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    same = (F.col("mark") == F.col("stay_mark")) & F.col("id").eqNullSafe(F.col("stay_id"))
    # only where a chosen id and text occur in several rows must whole rows meet once more to keep one
    again = found.join(first.filter("n > 1"), (F.col("mark") == F.col("stay_mark")) & F.col("doc_id").eqNullSafe(F.col("stay_id")), "left_semi")
    several = checkpoint(again.groupBy(F.col("doc_id").alias("stay_id"), F.col("mark").alias("stay_mark")).agg(F.count("*").alias("n")).filter("n > 1").drop("n"))
    stay = packed.join(first, same, "left_semi")
    if several.isEmpty():
        return stay.select("row.*")
    single = stay.join(several, same, "left_anti").select("row.*")
    return single.unionByName(stay.join(several, same, "left_semi").groupBy("mark", "id").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


QUERIES = {"op2_simhash": op2_simhash}
ORACLES: dict[str, str] = {}
