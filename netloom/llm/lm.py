"""Language-model scoring by prediction by partial matching.

The model is a trie of byte contexts up to ``order`` bytes. A byte is predicted
in the longest context that training has seen; if it is new there, an escape
leads to the next shorter context, where the bytes already excluded take no
probability (symbol exclusion), down to a uniform choice among the bytes never
seen. Escapes are estimated by method D: every distinct byte of a context gives
half a count to the escape. Probabilities of all bytes in a context sum to 1.

Texts are lower-cased (A-Z) words joined by single spaces, between an end mark
that also stands for what precedes the text. The score of a document is the log10
probability of its bytes and its end; the model is trained beforehand and stays
fixed while it scores.

Since the model is fixed, the code length of a byte depends on the last
``order`` bytes and itself only, that is on one n-gram. So tries don't travel to
texts: documents are dealt into blocks of bounded size, and each block sends its
distinct n-grams (with training counts) to shards by the last three context
bytes. A shard then holds everything of its contexts of three bytes and more;
contexts of up to two bytes are one table of at most 2**24 counts, which a first
pass gathers and which is broadcast. The shard answers every block with the code
lengths in the order in which the block asked, and the block sums them up for its
documents. Words and their training counts take the same way. Blocks are dealt
once: asking and summing up read the same shuffle, each in an order of rows of its
own, as fetches from other executors and spills leave it. So a block asks in the
order of its n-grams and words, which doesn't depend on that of its rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from math import ceil, log10, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.packing import slices, unsliced
from netloom.llm.session import table

ORDER = 5
#: Bytes of text in a block; a shard's number follows the root of all bytes.
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 1 << 20
#: Contexts of so many bytes at most are in the broadcast table.
LOW = 2
_CHUNK = 1 << 21

_PARTS = "kind int, shard int, block int, a binary, b binary"
_REPLIES = "block int, shard int, a binary, b binary, n long"
#: Keys of the first pass that are no contexts.
_TOKENS, _DOCS, _BYTES = -1, -2, -3


def pack(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values).tobytes(), 1)


def unpack(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), kind)


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted unsigned numbers, by their differences."""
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, "<u8"), dtype=np.uint64)


def counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


class Level:
    """The contexts of one length: per n-gram its count; per context its total, its distinct bytes
    and what its bytes count for in the next shorter context."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, shorter: Level | None):
        self.grams, self.counts = grams, counts
        contexts = grams >> np.uint64(8)
        first = np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]])) if len(grams) else np.zeros(0, np.int64)
        self.contexts = contexts[first]
        self.totals = np.add.reduceat(counts, first) if len(grams) else counts
        self.distinct = np.diff(np.append(first, len(grams)))
        self.excluded = np.zeros(len(first))
        if shorter is not None and len(grams):
            bits = np.uint64((1 << 8 * shorter.length) - 1) if shorter.length < 8 else np.uint64(~np.uint64(0))
            there = shorter.counts[np.searchsorted(shorter.grams, grams & bits)]
            self.excluded = np.add.reduceat(there.astype(np.float64), first)
        self.length = 1

    @staticmethod
    def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        return at, (keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool))


def levels_of(grams: np.ndarray, counts: np.ndarray, longest: int, shortest: int, below: list[Level]) -> list[Level]:
    """Levels of contexts of ``shortest`` to ``longest`` bytes, after those in ``below``."""
    made = list(below)
    for k in range(shortest, longest + 1):
        bits = np.uint64((1 << 8 * (k + 1)) - 1)
        level = Level(*counted(grams & bits, counts), made[-1] if made else None)
        level.length = k + 1
        made.append(level)
    return made


def log10_probabilities(grams: np.ndarray, levels: list[Level]) -> np.ndarray:
    """Of the last byte of each n-gram after the bytes before it."""
    out = np.zeros(len(grams))
    open_ = np.ones(len(grams), bool)
    off_total, off_distinct = np.zeros(len(grams)), np.zeros(len(grams))
    for level in reversed(levels):
        wanted = grams & np.uint64((1 << 8 * level.length) - 1)
        at, has = Level.find(level.contexts, wanted >> np.uint64(8))
        spot, hit = Level.find(level.grams, wanted)
        has &= open_
        hit &= has
        if len(level.contexts):
            total, distinct = level.totals[at] - off_total, level.distinct[at] - off_distinct
            out[hit] += np.log10((level.counts[spot[hit]] - 0.5) / total[hit])
            escaped = has & ~hit & (distinct > 0)
            out[escaped] += np.log10(0.5 * distinct[escaped] / total[escaped])
            off_total = np.where(has, level.excluded[at], 0.0)
            off_distinct = np.where(has, level.distinct[at], 0)
        open_ &= ~hit
    seen = len(levels[0].grams) if levels else 0
    out[open_] -= log10(max(1, 256 - seen))
    return out


class Texts:
    """Texts as the model reads them: their words, numbered bytewise, and their bytes with end marks."""

    def __init__(self, texts: pa.Array, order: int):
        words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(unsliced(texts).cast(pa.large_string()), "")))
        flat = words.flatten()
        # white space at the start or end of a text leaves an empty word there
        full = pc.not_equal(pc.binary_length(flat), 0)
        counts = pc.list_value_length(words).to_numpy().astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[np.concatenate([[0], np.cumsum(counts)])]
        self.n_words = np.diff(upto)
        flat = flat.filter(full)
        coded = flat.dictionary_encode()
        distinct = coded.dictionary.cast(pa.large_binary())
        order_of = pc.array_sort_indices(distinct)  # a dictionary is in order of appearance, which another order of rows changes
        self.words = distinct.take(order_of).to_pylist()
        self.of_word = np.argsort(order_of.to_numpy())[coded.indices.to_numpy()]
        self.of_doc = np.repeat(np.arange(len(counts)), self.n_words)
        spans = pc.binary_length(flat).to_numpy().astype(np.int64) + 1  # each word and the mark after it
        ends = np.concatenate([[0], np.cumsum(spans)])
        self.lengths = order + np.maximum(1, ends[upto[1:]] - ends[upto[:-1]])
        starts = np.cumsum(self.lengths) - self.lengths
        marks = ends[1:] - 1 + np.repeat(starts + order - ends[upto[:-1]], self.n_words)
        self.raw = np.zeros(int(self.lengths.sum()), np.uint8)
        self.raw[marks] = 32
        for k in range(order):
            self.raw[starts + k] = 10
        self.raw[starts + self.lengths - 1] = 10
        data = flat.cast(pa.large_binary())
        at, upto_byte = (np.frombuffer(data.buffers()[1], np.int64)[data.offset + k] for k in (0, len(data))) if len(data) else (0, 0)
        if upto_byte > at:
            self.raw[self.raw == 0] = np.frombuffer(data.buffers()[2], np.uint8)[at:upto_byte]
        self.order = order

    def chunks(self, order: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """n-grams of the order that end in a predicted byte, and the document of each, some at a time."""
        order = self.order if order is None else order
        doc_of = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)
        predicted = np.ones(len(self.raw), bool)
        starts = np.cumsum(self.lengths) - self.lengths
        for k in range(self.order):
            predicted[starts + k] = False
        for at in range(0, max(0, len(self.raw) - order), _CHUNK):
            piece = self.raw[at : at + _CHUNK + order].astype(np.uint64)
            n = len(piece) - order
            grams = piece[:n].copy()
            for j in range(1, order + 1):
                grams <<= np.uint64(8)
                grams |= piece[j : n + j]
            here = slice(at + order, at + order + n)
            yield grams[predicted[here]], doc_of[here][predicted[here]]

    def distinct_grams(self, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct n-grams in order, how often they occur, and how often in documents to learn from."""
        keys, counts = [], []
        for grams, doc in self.chunks():
            some, n = np.unique(grams << np.uint64(1) | learn[doc], return_counts=True)
            keys.append(some)
            counts.append(n)
        if not keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, counts = counted(np.concatenate(keys), np.concatenate(counts))
        taught = keys & np.uint64(1) == 1
        grams, all_ = counted(keys >> np.uint64(1), counts)
        of_taught = np.zeros(len(grams), np.int64)
        of_taught[np.searchsorted(grams, keys[taught] >> np.uint64(1))] = counts[taught]
        return grams, all_, of_taught


class Lookup:
    """Positions of keys in a sorted array: a table by hash, where frequent keys win a slot, then search."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - max(8, 3 + len(keys).bit_length()))
        self.table = np.zeros(1 << 64 - int(self.shift), np.int32)
        order = np.argsort(counts, kind="stable")
        self.table[self._slot(keys[order])] = order

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        at = self.table[self._slot(wanted)]
        missed = np.flatnonzero(self.keys[at] != wanted)
        at[missed] = np.searchsorted(self.keys, wanted[missed])
        return at


def gram_shards(grams: np.ndarray, shards: int) -> np.ndarray:
    """By the last three bytes of the context."""
    mixed = (grams >> np.uint64(8) & np.uint64(0xFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def by_shard(shard: np.ndarray, shards: int) -> list[np.ndarray]:
    """Positions of each shard's elements, in their order."""
    order = np.argsort(shard, kind="stable")
    return np.split(order, np.searchsorted(shard[order], np.arange(1, shards)))


def word_shards(words: list[bytes], shards: int) -> np.ndarray:
    return np.array([zlib.crc32(w) % shards for w in words], np.int64)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 1 modulo 5; a null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


def _first_pass(order: int):
    """Counts of the n-grams of the low contexts, and of tokens and documents, to learn from; all bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 0, 8 << 20):
                learn = ~some.column(1).to_numpy(zero_copy_only=False)
                texts = Texts(some.column(0), order)
                keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for grams, doc in texts.chunks(LOW):
                    distinct, n = np.unique(grams[learn[doc]].astype(np.uint32), return_counts=True)
                    keys.append(distinct.astype(np.int64))
                    counts.append(n)
                keys, counts = counted(np.concatenate(keys), np.concatenate(counts))
                extra = [int(texts.n_words[learn].sum()), int(learn.sum()), int(texts.lengths.sum())]
                keys, counts = np.append(keys, [_TOKENS, _DOCS, _BYTES]), np.append(counts, extra)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])

    return run


def _ask(order: int, shards: int):
    """A block's n-grams and words with training counts, one row of each for every shard."""

    def run(block: pa.Table) -> pa.Table:
        number = block.column("block")[0].as_py()
        texts = Texts(block.column("text").combine_chunks(), order)
        learn = ~block.column("held_out").to_numpy()
        grams, _, counts = texts.distinct_grams(learn)
        rows = []
        for shard, at in enumerate(by_shard(gram_shards(grams, shards), shards)):
            rows.append((0, shard, number, pack_sorted(grams[at]), pack(counts[at].astype("<u4"))))
        said = np.bincount(texts.of_word[learn[texts.of_doc]], minlength=len(texts.words))
        for shard, at in enumerate(by_shard(word_shards(texts.words, shards), shards)):
            rows.append((1, shard, number, zstandard.compress(b" ".join(texts.words[k] for k in at), 1), pack(said[at].astype("<u4"))))
        return _table(rows, _PARTS)

    return run


_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}


def _table(rows: list[tuple], schema: str) -> pa.Table:
    fields = [x.strip().split() for x in schema.split(",")]
    return pa.table({name: pa.array([r[k] for r in rows], _ARROW[kind]) for k, (name, kind) in enumerate(fields)})


def _answer(order: int, low: tuple[bytes, bytes]):
    """A shard's code lengths and word counts for every block that asked, in the order it asked."""
    keys, sums = np.frombuffer(low[0], "<u8"), np.frombuffer(low[1], "<i8")
    below = levels_of(keys, sums, LOW, 0, [])

    def run(shard: pa.Table) -> pa.Table:
        number = shard.column("shard")[0].as_py()
        rows = list(zip(*(shard.column(c).to_pylist() for c in ("kind", "block", "a", "b"))))
        asked = [(block, unpack_sorted(a), unpack(b, "<u4")) for kind, block, a, b in rows if kind == 0]
        lengths = {}
        if asked:
            grams, counts = counted(np.concatenate([g for _, g, _ in asked]), np.concatenate([c for *_, c in asked]).astype(np.int64))
            used = counts > 0
            known = log10_probabilities(grams, levels_of(grams[used], counts[used], order, LOW + 1, below))
            lengths = {block: pack(known[np.searchsorted(grams, g)].astype("<f4")) for block, g, _ in asked}
        words: Counter[bytes] = Counter()
        spoken = [(block, zstandard.decompress(a).split(), unpack(b, "<u4").tolist()) for kind, block, a, b in rows if kind == 1]
        for _, some, counts in spoken:
            for word, n in zip(some, counts):
                words[word] += n
        said = {block: pack(np.array([words[w] for w in some], "<u8")) for block, some, _ in spoken}
        distinct = sum(n > 0 for n in words.values())
        return _table([(block, number, lengths[block], said[block], distinct) for block in sorted(said)], _REPLIES)

    return run


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _sum_up(order: int, shards: int, tokens: int, taught: int):
    """Scores of a block's documents from the answers of the shards."""

    def run(block: pa.Table, replies: pa.Table) -> pa.Table:
        if not block.num_rows:
            return _table([], _SCORES)
        texts = Texts(block.column("text").combine_chunks(), order)
        n_docs = block.num_rows
        answer = {s: (a, b) for s, a, b in zip(*(replies.column(c).to_pylist() for c in ("shard", "a", "b")))}
        grams, times, _ = texts.distinct_grams(np.zeros(n_docs, bool))
        known = np.zeros(len(grams))
        for shard, at in enumerate(by_shard(gram_shards(grams, shards), shards)):
            known[at] = unpack(answer[shard][0], "<f4")
        scores = np.zeros(n_docs)
        if len(grams):
            lookup = Lookup(grams, times)
            for some, doc in texts.chunks():
                scores += np.bincount(doc, known[lookup(some)], n_docs)
        counts = np.zeros(len(texts.words), np.int64)
        for shard, at in enumerate(by_shard(word_shards(texts.words, shards), shards)):
            counts[at] = unpack(answer[shard][1], "<u8")
        distinct = sum(replies.column("n").to_pylist()) + (taught > 0)
        n_tokens = texts.n_words + 1
        sums = np.bincount(texts.of_doc, np.log10(counts + 0.5)[texts.of_word], n_docs) + log10(taught + 0.5)
        base = sums - n_tokens * log10(tokens + taught + 0.5 * (distinct + 1))
        n_known = np.bincount(texts.of_doc, (counts > 0)[texts.of_word], n_docs).astype(np.int64) + (taught > 0)
        columns = [block.column("doc_id"), block.column("held_out"), *map(pa.array, (n_tokens, n_known, base, scores))]
        return pa.table(columns, names=[x.split()[0] for x in _SCORES.split(", ")])

    return run


def ppm_scores(docs: DataFrame, held: Column, *, order: int = ORDER, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Scores of all rows by a model of those where ``held`` is false: doc_id, held_out, n_tokens,
    n_known, train_tokens, base_score (an additive unigram model of the words) and score.

    Null and empty texts hold the end alone; repeated rows are learnt as often as they
    occur and scored alike; without a row to learn from every byte has probability
    1/256; an empty table gives no rows; other columns are ignored.
    """
    if not LOW < order <= 6:
        raise ValueError("order is 3 to 6")
    texts = docs.select(F.col("doc_id").cast("long"), "text", held.alias("held_out"))
    first = texts.select("text", "held_out").mapInArrow(_first_pass(order), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # at most 2**24 + 3 rows
    keys, sums = counted(first.column(0).to_numpy(), first.column(1).to_numpy())
    extra = dict(zip(keys[keys < 0].tolist(), sums[keys < 0].tolist()))
    tokens, taught, size = (extra.get(k, 0) for k in (_TOKENS, _DOCS, _BYTES))
    blocks, shards = ceil(size / block_bytes) or 1, ceil(sqrt(size / shard_bytes)) or 1
    low = keys[keys >= 0].astype("<u8").tobytes(), sums[keys >= 0].astype("<i8").tobytes()
    dealt = texts.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    asked = dealt.groupBy("block").applyInArrow(_ask(order, shards), _PARTS)
    answers = asked.groupBy("shard").applyInArrow(_answer(order, low), _REPLIES)
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_sum_up(order, shards, tokens, taught), _SCORES)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens + taught).cast("long").alias("train_tokens"), "base_score", "score")


def op1_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_scores(table(spark, sf_dir, "documents"), held_out(F.col("doc_id")))


QUERIES = {"op1_ppm": op1_ppm}
ORACLES: dict[str, str] = {}
