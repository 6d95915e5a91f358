"""Embedding near-duplicates: sign hashes of random hyperplanes, exact cosines, components.

In each of several tables a vector's bucket is the pattern of its signs against
the table's random hyperplanes; pairs that meet in a bucket of any table are
verified by their cosine in double precision. Planes grow with the number of
vectors (log2 of it, 20 at least), so buckets of unrelated vectors stay small, and
tables with the planes, so a pair at cosine 0.9 is found with probability 0.988
(with 20 planes these are 96 tables), one at 0.95 with 0.9999.

Equal vectors are one node with a number of copies. Only nodes that share a
bucket travel with their vectors. A bucket emits, for each node, the rows it is
linked to and a spanning forest of its links, never its pairs; a pair counts in
the first table in which it meets. Small buckets are compared many at a time, large
ones block by block in several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.buckets import by_group, compare_blocks, complete_groups, group_bounds, join_unevenly, least_hot
from netloom.llm.components import connected_components
from netloom.llm.session import checkpoint, table

MIN_COSINE = 0.9
LEAST_PLANES, MOST_PLANES = 20, 31
#: Probability with which a pair at the wanted cosine meets in some table.
RECALL = 0.988
SEED = 7
BLOCK_ROWS = 256


def shape(n: int, min_cosine: float, recall: float = RECALL) -> tuple[int, int]:
    """Tables and planes for n vectors."""
    planes = min(MOST_PLANES, max(LEAST_PLANES, ceil(log2(max(n, 1)))))
    meet = (1 - acos(min_cosine) / pi) ** planes
    return min(4096, ceil(log(1 - recall) / log(1 - meet))), planes


def unit_rows(vectors: list[list[float] | None]) -> list[np.ndarray | None]:
    """Vectors of length 1 in double precision; None for null, empty, zero or non-finite ones."""
    out: list[np.ndarray | None] = []
    for v in vectors:
        x = None if v is None or not len(v) or None in v else np.array(v, np.float64)
        if x is not None:
            top = np.abs(x).max()
            x = x / top if np.isfinite(top) and top > 0 else None
        out.append(None if x is None else x / np.sqrt(x @ x))
    return out


def hyperplanes(dim: int, tables: int, planes: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, tables * planes))


def signatures(units: np.ndarray, tables: int, planes: int, seed: int) -> np.ndarray:
    """The bucket of each vector in each table, as int32."""
    signs = units @ hyperplanes(units.shape[1], tables, planes, seed) >= 0
    return signs.reshape(len(units), tables, planes) @ (1 << np.arange(planes, dtype=np.int32)).astype(np.int32)


def _prepare(vectors: DataFrame) -> DataFrame:
    """vec_id and unit, the bytes of the vector of length 1 or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = [None if x is None else x.astype("<f8").tobytes() for x in unit_rows(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(units, pa.binary())], names=["vec_id", "unit"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, unit binary")


def _sign(nodes: DataFrame, tables: int, planes: int, seed: int) -> DataFrame:
    """Adds marks, the bytes of the int32 signature."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            marks = np.empty(len(frame), object)
            sizes = frame["unit"].map(len).to_numpy()
            for size in np.unique(sizes):
                at = (sizes == size).nonzero()[0]
                for some in np.array_split(at, len(at) // 1024 + 1):
                    found = signatures(np.frombuffer(b"".join(frame["unit"].iloc[some]), "<f8").reshape(len(some), -1), tables, planes, seed)
                    for k, row in zip(some, found):
                        marks[k] = row.astype("<i4").tobytes()
            yield frame.assign(marks=marks)

    return nodes.mapInPandas(run, "node long, copies long, unit binary, marks binary")


def _bucket_keys(signed: DataFrame, tables: int) -> DataFrame:
    """node and key, a row for each table; vectors of different lengths never share a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in (batch.slice(k, 2000) for k in range(0, len(batch), 2000)):
                marks = np.frombuffer(b"".join(some.column(1).to_pylist()), "<i4").reshape(-1, tables).astype(np.int64)
                dims = some.column(2).to_numpy().astype(np.int64)
                keys = (marks | np.arange(tables, dtype=np.int64) << 32) ^ dims[:, None] << 44
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some.column(0).to_numpy(), tables)), pa.array(keys.ravel())], names=["node", "key"])

    return signed.select("node", "marks", F.length("unit").alias("dim")).mapInArrow(run, "node long, key long")


def met_before(marks: np.ndarray, i: np.ndarray, j: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether rows i and j agree in one of their first ``at`` columns. Near rows agree early, so few pairs are looked at to the end."""
    met = np.zeros(len(i), bool)
    for some in range(0, len(i), 65536):
        left, start, width = np.arange(some, min(some + 65536, len(i))), 0, 4
        while len(left := left[at[left] > start]):
            end = min(start + width, marks.shape[1])
            same = marks[i[left], start:end] == marks[j[left], start:end]
            met[left] = (same & (np.arange(start, end) < at[left][:, None])).any(axis=1)
            left, start, width = left[~met[left]], end, 2 * width
    return met


def forest_of_few(i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of pairs."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root.setdefault(up, up)
        return x

    edges = []
    for x, y in zip(i.tolist(), j.tolist()):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            edges.append((x, y))
    return edges


def forest_of_many(i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """The same for the pairs of one group: a row's neighbours are found together."""
    rows, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    near = np.zeros((len(rows), len(rows)), bool)
    near[at[: len(i)], at[len(i) :]] = near[at[len(i) :], at[: len(i)]] = True
    apart, edges = np.ones(len(rows), bool), []
    for first in range(len(rows)):
        todo = [first] if apart[first] else []
        apart[first] = False
        while todo:
            x = todo.pop()
            new = (near[x] & apart).nonzero()[0]
            apart[new] = False
            edges += zip([x] * len(new), new.tolist())
            todo += new.tolist()
    return [(int(rows[x]), int(rows[y])) for x, y in edges]


#: Groups of no more rows are compared together.
FEW_ROWS = 32


def _near_pairs(units: np.ndarray, starts: np.ndarray, ends: np.ndarray, side: np.ndarray, min_cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Pairs (i, j) of rows of the same group at the wanted cosine, and whether all are of one large group. Rows of
    side 0 meet those of side 1, rows of side -1 each other."""
    sizes = ends - starts
    for size in np.unique(sizes[(sizes > 1) & (sizes <= FEW_ROWS)]):
        a, b = np.triu_indices(size, 1)
        of_size = starts[sizes == size]
        for some in np.array_split(of_size, len(of_size) * len(a) // 16384 + 1):
            i, j = (some[:, None] + a).ravel(), (some[:, None] + b).ravel()
            meet = (side[i] < 0) | (side[i] != side[j])
            i, j = i[meet], j[meet]
            near = np.einsum("ij,ij->i", units[i], units[j]) >= min_cosine
            yield i[near], j[near], False
    for start, end in zip(starts[sizes > FEW_ROWS], ends[sizes > FEW_ROWS]):
        if side[start] < 0:
            part = units[start:end]
            i, j = np.triu(part @ part.T >= min_cosine, 1).nonzero()
            yield i + start, j + start, True
        else:
            x, y = ((side[start:end] == k).nonzero()[0] + start for k in (0, 1))
            i, j = (units[x] @ units[y].T >= min_cosine).nonzero()
            yield x[i], y[j], True


def _links(met: DataFrame, tables: int, min_cosine: float) -> DataFrame:
    """Rows (a, b, n): n >= 0 vectors linked to node a, or, where n is null, an edge a, b of a spanning forest."""
    keys = ["key", "low", "high"]

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        units = np.frombuffer(b"".join(frame["unit"]), "<f8").reshape(len(frame), -1)
        marks = np.frombuffer(b"".join(frame["marks"]), "<i4").reshape(len(frame), tables)
        node, copies, block, low, high = (frame[c].to_numpy() for c in ("node", "copies", "block", "low", "high"))
        at = frame["key"].to_numpy() >> 32 & 0xFFF
        starts, ends = np.array(group_bounds(frame, keys)).T
        side = np.where(low == high, -1, (block == high).astype(int))
        n, edges = np.zeros(len(frame)), []
        for i, j, many in _near_pairs(units, starts, ends, side, min_cosine):
            first = ~met_before(marks, i, j, at[i])
            i, j = i[first], j[first]
            if len(i):
                n += np.bincount(i, copies[j], len(frame)) + np.bincount(j, copies[i], len(frame))
                edges += forest_of_many(i, j) if many else forest_of_few(i, j)
        linked = n.nonzero()[0]
        ends_of = np.array(edges, int).reshape(-1, 2)
        counts = pd.DataFrame({"a": node[linked], "b": pd.array([None] * len(linked), "Int64"), "n": pd.array(n[linked].astype(int), "Int64")})
        forest = pd.DataFrame({"a": node[ends_of[:, 0]], "b": pd.array(node[ends_of[:, 1]], "Int64"), "n": pd.array([None] * len(ends_of), "Int64")})
        return pd.concat([counts, forest], ignore_index=True)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in complete_groups(frames, keys, 5_000):
            for _, part in frame.groupby(frame["unit"].map(len)):
                yield compare(part.reset_index(drop=True))

    return met.mapInPandas(run, "a long, b long, n long")


def embedding_components(vectors: DataFrame, *, min_cosine: float = MIN_COSINE, tables: int | None = None, planes: int | None = None, seed: int = SEED) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of (vec_id, embedding).

    Null vectors, vectors that are zero, empty or hold null or non-finite
    components, link with nothing and are components of their own; so do vectors
    of different lengths with each other. Equal vectors, repeated rows too, link
    with each other. Rows whose vec_id is null take part but never name a
    component. An empty table gives no rows; other columns are ignored. Tables and planes
    that are not given follow the number of vectors (``shape``).
    """
    rows = checkpoint(_prepare(vectors).withColumn("digest", F.md5("unit")))
    total = rows.count()
    own = shape(total, min_cosine)
    tables, planes = tables or own[0], planes or own[1]
    if not 1 <= planes <= 31 or not 1 <= tables <= 4096:
        raise ValueError("1 to 31 planes and 1 to 4096 tables")
    distinct = rows.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("unit").alias("unit"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    nodes = checkpoint(distinct.withColumn("node", F.monotonically_increasing_id()))
    signed = checkpoint(_sign(nodes.select("node", "copies", "unit"), tables, planes, seed))
    met = compare_blocks(_bucket_keys(signed, tables), "key", "node", BLOCK_ROWS).join(signed, "node")
    found = checkpoint(_links(by_group(met.select("key", "low", "high", "block", "node", "copies", "unit", "marks"), ["key", "low", "high"]), tables, min_cosine))
    counts = found.filter("n IS NOT NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    roots = connected_components(found.filter("n IS NULL").select("a", "b"), "a", "b")
    placed = checkpoint(nodes.select("node", "digest", "copies", "least").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    known = placed.join(named, "root").select("digest", "copies", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    linked = join_unevenly(rows.filter("digest IS NOT NULL").select("vec_id", "digest"), known, ["digest"], "copies", least_hot(total)).select("vec_id", "n_links", "component_id")
    alone = rows.filter("digest IS NULL").select("vec_id", F.lit(0).alias("n_links"), F.col("vec_id").alias("component_id"))
    whole = linked.unionByName(alone)
    return whole.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"))


QUERIES = {"op7_embedding_dedup": op7_embedding_dedup}
ORACLES: dict[str, str] = {}
