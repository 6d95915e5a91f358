"""Removal of passages that repeat across documents, by prefix-partitioned suffix trees.

A passage of ``window`` words counts as a repeat in every document but the one
with the smallest id that has it. All suffixes, cut to ``window`` words, are split
into groups that fit in memory, and the suffix tree of each group tells the
repeats: its internal nodes at depth ``window``, each of which keeps the smallest
document below it. Consecutive suffixes below such nodes make a maximal repeat.

Splitting by words of fixed place would send every suffix with its own words. The
splitting gram of a suffix is the one with the smallest hash among its grams
instead, so equal suffixes still split alike, and consecutive suffixes with one
gram travel as one stretch of text; a text that repeats a phrase is one stretch.
Grams have variable length: a group begins with ``WIDTHS[0]`` words, and those with
more than ``GROUP_WORDS`` words split anew by longer grams, up to the whole window,
where a group is one node and needs no tree. Which groups split is a bitmap of
fixed size; a gram that shares its bit with such a group merely splits early too.

Before a tree is built, stretches with the same words (one BLAKE2b digest of 128
bits, of the words themselves) become one leaf set with one smallest document. The others of
such a set repeat it whole, so only one of each set sends its words. Groups of
one document, or of one set, need no tree. A gram that is too common for one task
(see ``buckets``) is never grouped in one place before its sets are merged.

Within a group the tree is built level by level: ranks of the suffixes by 1, 2, 4,
... words are the nodes at that depth, each from pairs of nodes of the level
before. Texts are shuffled once; both joins with them read that exchange.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b
from itertools import chain
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.llm.buckets import by_group, complete_groups, hot_keys, join_unevenly, least_hot
from netloom.llm.session import discard, table, written
from netloom.llm.text import WORD, encode

WINDOW = 50
#: Words of the splitting grams, from the first to the last but one; the last is the window.
GRAM = 8
#: Words of the stretches that are put in one tree.
GROUP_WORDS = 1 << 19
#: Bits that tell which groups split.
FLAG_BITS = 24
_PIECE_BYTES = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BLANK_RUN, _WORD_RUN = re.compile(rb"[\x20\x09-\x0d]+"), re.compile(rb"[^\x20\x09-\x0d]+")


def gram_widths(window: int, gram: int) -> list[int]:
    """Lengths of the splitting grams: each twice as long as the one before, then the window."""
    widths = []
    while gram < window:
        widths.append(gram)
        gram *= 2
    return [*widths, window]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of every word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def least_grams(words: np.ndarray, width: int, window: int) -> np.ndarray:
    """For every window of the words, the smallest hash of its grams of that width."""
    grams = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        grams = grams * _BASE + words[k : len(words) - width + 1 + k]
    best, span, wanted = _mixed(grams), 1, window - width + 1
    while span < wanted:
        step = min(span, wanted - span)
        best = np.minimum(best[: len(best) - step], best[step:])
        span += step
    return best


def flagged(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    slot = keys & np.uint64((1 << FLAG_BITS) - 1)
    return (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def stretches_of(texts: list[bytes], window: int, widths: list[int], flags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Text, gram, digest, first and last suffix of each stretch: a run of consecutive suffixes with one
    splitting gram, the last of ``widths``, among suffixes whose shorter grams are all flagged."""
    split = [t.split() for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    listed = list(chain.from_iterable(split))
    none = np.zeros(0, np.int64)
    if len(listed) < window:
        return none, none, [], none, none
    text = np.repeat(np.arange(len(texts)), counts)
    wanted = text[: len(listed) - window + 1] == text[window - 1 :]
    words = word_hashes(listed)
    for width, bits in zip(widths, flags):
        if not wanted.any():
            break
        wanted &= flagged(least_grams(words, width, window), bits)
    suffix = wanted.nonzero()[0]
    if not len(suffix):
        return none, none, [], none, none
    key = least_grams(words, widths[-1], window)[suffix]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (suffix[1:] != suffix[:-1] + 1) | (text[suffix[1:]] != text[suffix[:-1]])])
    if widths[-1] == window:  # a stretch of equal suffixes: its words are all one word
        alike = np.concatenate([[0], np.cumsum(np.fromiter(map(eq, listed, listed[1:]), np.int64, len(listed) - 1)), [0]])
        new[1:] |= alike[suffix[:-1] + window] - alike[suffix[:-1]] < window
    begin = new.nonzero()[0]
    low, high = suffix[begin], suffix[np.append(begin[1:], len(suffix)) - 1]
    # of equal suffixes, however many follow each other, the digest is that of one
    length = (high - low if widths[-1] < window else np.zeros(len(low), np.int64)) + window
    joined = b" ".join(listed)
    ends = np.cumsum(np.fromiter(map(len, listed), np.int64, len(listed)) + 1)
    begins = np.concatenate([[0], ends[:-1]])
    digest = [blake2b(joined[a:b], digest_size=16).digest() for a, b in zip(begins[low].tolist(), (ends[low + length - 1] - 1).tolist())]
    of = text[low]
    first = (np.cumsum(counts) - counts)[of]
    return of, key[begin].view(np.int64), digest, low - first, high - first


def pieces(texts: list[bytes], window: int, size: int = _PIECE_BYTES) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (text, its words before, bytes) with about ``size`` bytes each. A longer text is cut into
    several, which overlap so that every window lies in exactly one."""
    held: list[tuple[int, int, bytes]] = []
    room = size
    for k, text in enumerate(texts):
        if len(text) <= size:
            if held and room < len(text):
                yield held
                held, room = [], size
            held.append((k, 0, text))
            room -= len(text)
            continue
        at = before = 0
        while at < len(text):
            blank = _BLANK_RUN.search(text, at + size)
            end = blank.start() if blank else len(text)
            beyond = end
            for _, word in zip(range(window - 1), _WORD_RUN.finditer(text, end)):
                beyond = word.end()
            yield [(k, before, text[at:beyond])]
            before += len(text[at:end].split())
            at = end
    if held:
        yield held


_STRETCHES = "doc long, mark long, key long, digest binary, low int, high int"


def _find_stretches(window: int, widths: list[int], flags: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at in range(0, len(batch), 500):
                texts = [encode(t) for t in batch.column(2).slice(at, 500).to_pylist()]
                for some in pieces(texts, window):
                    of, key, digest, low, high = stretches_of([x[2] for x in some], window, widths, flags)
                    row = at + np.array([x[0] for x in some])[of]
                    before = np.array([x[1] for x in some])[of]
                    columns = [pa.array(docs[row]), pa.array(marks[row]), pa.array(key), pa.array(digest, pa.binary()), *(pa.array((x + before).astype(np.int32)) for x in (low, high))]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc", "mark", "key", "digest", "low", "high"])

    return run


def _bits_of(keys: DataFrame) -> np.ndarray:
    """The bitmap of a column of keys: at most 2 ** (FLAG_BITS - 6) words reach the driver."""
    slot = F.col("key").bitwiseAND(F.lit((1 << FLAG_BITS) - 1)).alias("slot")
    set_ = keys.select(slot).groupBy(F.expr("cast(slot >> 6 as int)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits")).toArrow()
    bits = np.zeros(1 << FLAG_BITS >> 6, np.int64)
    bits[set_.column("word").to_numpy()] = set_.column("bits").to_numpy()
    return bits.view(np.uint64)


def _judged(docs: DataFrame, window: int, widths: list[int], flags: list[np.ndarray], group_words: int) -> tuple[DataFrame, DataFrame | None]:
    """Stretches that repeat whole (ask false) or that a tree must judge (ask true): doc, mark, low, high,
    key, ask; and the bits of the groups that split."""
    found = written(docs.mapInArrow(_find_stretches(window, widths, flags), _STRETCHES))
    last = widths[-1] == window  # there a group is one set
    group = ["key", "digest"] if last else ["key"]
    limit = least_hot(found.count())
    hot = written(hot_keys(found, "key", limit))
    size = F.col("high") - F.col("low") + window

    of_set, of_group = W.partitionBy("key", "digest"), W.partitionBy(*group)
    even = found.join(F.broadcast(hot), "key", "left_anti").repartition(*group).withColumn("least", F.min("doc").over(of_set))
    leader = F.col("doc") == F.col("least")
    facts = {"first": F.min("least"), "final": F.max("doc"), "words": F.sum(F.when(leader, size).otherwise(0)), "low_set": F.min("digest"), "high_set": F.max("digest")}
    even = even.withColumns({name: value.over(of_group) for name, value in facts.items()})

    common = found.join(F.broadcast(hot), "key")
    sets = common.groupBy("key", "digest").agg(F.count("*").alias("n"), F.min("doc").alias("least"), F.max("doc").alias("greatest"), F.max(size).alias("size"))
    of_hot = sets.groupBy(*group).agg(F.min("least").alias("first"), F.max("greatest").alias("final"), F.sum("size").alias("words"), F.min("digest").alias("low_set"), F.max("digest").alias("high_set"))
    common = join_unevenly(common, sets.select("key", "digest", "n", "least"), ["key", "digest"], "n", limit).drop("n")
    common = common.join(F.broadcast(of_hot), group)  # as many rows as there are hot keys

    varied = F.col("low_set") < F.col("high_set")
    told = even.unionByName(common).filter((F.col("first") < F.col("final")) & (~leader | varied))
    judged = written(told.select("doc", "mark", "low", "high", "key", leader.alias("ask"), (varied & (F.col("words") > group_words)).alias("splits")))
    over = judged.filter("ask AND splits").select("key")
    split = None if last or over.isEmpty() else _bits_of(over)
    discard(found, hot)
    return judged.filter("NOT (ask AND splits)").drop("splits"), split


_ASKED = "level int, key long, doc long, mark long, low int, words binary"


def _words_of(window: int):
    """The words of every stretch asked for: each row of the input has a text and its stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        names = ["level", "key", "doc", "mark", "low", "words"]
        for batch in batches:
            for some in (batch.slice(k, 200) for k in range(0, len(batch), 200)):
                rows: list[tuple] = []
                for doc, mark, text, asked in zip(*(some.column(c).to_pylist() for c in ("doc", "mark", "text", "asked"))):
                    words = encode(text).split()
                    rows += [(a["level"], a["key"], doc, mark, a["low"], b" ".join(words[a["low"] : a["high"] + window])) for a in asked]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=names)

    return run


def nodes_at_depth(words: np.ndarray, depth: int) -> np.ndarray:
    """The tree node at the given depth below which each suffix lies; equal for equal first words.

    Suffixes that end before have no meaning in the result.
    """
    node, deep = words, 1
    while deep < depth:
        step = min(deep, depth - deep)
        beyond = np.concatenate([node[step:], np.zeros(min(step, len(node)), node.dtype)])[: len(node)]
        _, node = np.unique(node.astype(np.uint64) << np.uint64(32) | beyond.astype(np.uint64), return_inverse=True)
        deep += step
    return node.astype(np.int64)


def tree_repeats(words: pa.Array, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and end of every maximal repeat among the stretches: suffixes one after another
    below nodes at depth ``window`` that also have a smaller document below them."""
    split = pc.split_pattern(words.cast(pa.large_binary()), b" ")
    ids = split.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
    lengths = pc.list_value_length(split).to_numpy()
    node = nodes_at_depth(ids, window)
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    leaf = (place <= lengths[row] - window).nonzero()[0]
    row, place, node = row[leaf], place[leaf], node[leaf]
    least = np.full(int(node.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, node, doc[row])
    out = (doc[row] > least[node]).nonzero()[0]
    if not len(out):
        return row[out], place[out], place[out]
    new = np.concatenate([[True], (row[out][1:] != row[out][:-1]) | (place[out][1:] != place[out][:-1] + 1)])
    first = new.nonzero()[0]
    last = np.append(first[1:], len(out)) - 1
    return row[out][first], place[out][first], place[out][last] + window


def _trees(window: int):
    """Builds the trees of whole groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in complete_groups((b.to_pandas() for b in batches), ["level", "key"], 10_000):
            doc, mark, low = (frame[c].to_numpy() for c in ("doc", "mark", "low"))
            row, start, end = tree_repeats(pa.array(frame["words"], pa.binary()), doc, window)
            columns = [pa.array(doc[row]), pa.array(mark[row]), *(pa.array((low[row] + x).astype(np.int32)) for x in (start, end))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "mark", "low", "high"])

    return run


def _together(rows: DataFrame, listed: Column, name: str) -> DataFrame:
    return rows.groupBy("doc", "mark").agg(F.collect_set(listed).alias(name))


def repeated_spans(texts: DataFrame, docs: DataFrame, *, window: int, gram: int, group_words: int) -> DataFrame:
    """doc, mark, low, high: words low to high of a document repeat one with a smaller id.

    ``docs`` has doc, mark and text; ``texts`` the same rows, dealt out by doc and mark.
    """
    widths, flags, levels = gram_widths(window, gram), [], []
    for level in range(len(widths)):
        judged, split = _judged(docs, window, widths[: level + 1], flags, group_words)
        levels.append(judged.withColumn("level", F.lit(level)))
        if split is None:
            break
        flags.append(split)
    judged = reduce(DataFrame.unionByName, levels)
    asked = _together(judged.filter("ask"), F.struct("level", "key", "low", "high"), "asked")
    stretches = by_group(texts.join(asked, ["doc", "mark"]).mapInArrow(_words_of(window), _ASKED), ["level", "key"])
    repeats = stretches.mapInArrow(_trees(window), "doc long, mark long, low int, high int")
    return judged.filter("NOT ask").select("doc", "mark", "low", (F.col("high") + window).alias("high")).unionByName(repeats)


def drop_repeats(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, group_words: int = GROUP_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (what is left, words joined by one space) for every row.

    Repeats are judged on the input. Rows with the same id never remove each other's
    words, so repeated rows are treated alike. A null text has no words. A row whose
    doc_id is null is kept whole and removes nothing. Texts of any length are
    compared whole; an empty table gives no rows; other columns are ignored.
    """
    if not 1 <= gram <= window:
        raise ValueError("the gram is longer than the window")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("doc"), F.xxhash64("doc_id", "text", F.col("doc_id").isNull()).alias("mark"), F.col("doc_id").cast("long"), "text")
    texts = keyed.repartition("doc", "mark")
    spans = repeated_spans(texts, keyed.filter("doc_id IS NOT NULL").select("doc", "mark", "text"), window=window, gram=gram, group_words=group_words)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, kept = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                words = encode(text).split()
                n.append(len(words))
                if spans:
                    left, upto = [], 0
                    for span in sorted((s["low"], s["high"]) for s in spans):
                        left += words[upto : span[0]]
                        upto = max(upto, span[1])
                    words = left + words[upto:]
                removed.append(n[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    whole = texts.join(_together(spans, F.struct("low", "high"), "spans"), ["doc", "mark"], "left")
    return whole.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op4_substring_dedup": op4_substring_dedup}
ORACLES: dict[str, str] = {
    "op4_substring_dedup": f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text,''), '{WORD}') w FROM documents),
 win AS (SELECT doc_id, i, md5(array_to_string(w[i:i+{WINDOW - 1}], ' ')) h FROM d, unnest(range(1, len(w)-{WINDOW - 2})) t(i)),
 again AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) f FROM win) WHERE f<doc_id),
 gone AS (SELECT DISTINCT doc_id, i+j p FROM again, range({WINDOW}) t(j)),
 kept AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY p) s, count(*) n FROM (SELECT doc_id, unnest(w) word, unnest(range(1, len(w)+1)) p FROM d) k ANTI JOIN gone g USING (doc_id, p) GROUP BY 1)
 SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(len(w)-coalesce(n,0) AS BIGINT) n_removed, sha256(coalesce(s,'')) kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
}
