"""Packing by power-of-two decomposition.

Each document's token ids are cut into pieces whose lengths are powers of two:
as many pieces of ``max_len`` as fit, then the binary digits of the rest from
high to low. Every piece is a whole sequence of its bucket, so no sequence
crosses documents and none needs padding; a training step takes sequences of
one bucket.

The tokenizer drops white space and merges only within a word's letters or marks,
so the ids of a text are the ids of such parts one after another. A batch's
parts are told apart by Arrow, and a worker keeps the ids of parts it has met (a plain
cache, emptied when it is full). Parts that the tokenizer takes as they are, nearly all,
go to its model many at a time as one text and are kept as Arrow arrays; the tokenizer
gets each other part by itself. A worker lives on through later stages with what it keeps,
so the cache is bounded in bytes. Texts that hold one of the tokenizer's special tokens,
which it reads as such, go to it whole.

Defined results: null and empty texts hold only the end id and give one piece
of length 1; repeated rows give the same pieces each; an empty table gives no
rows; other columns are ignored; a null doc_id is carried as null.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.session import table

END_ID = 2
MAX_LEN = 4096
#: Parts of texts whose ids one Python worker keeps, as long as they fit in so many bytes:
#: half of them for plain parts, half for others, each up to that number.
CACHED_PARTS = 500_000
CACHED_BYTES = 48 << 20
#: What a dict takes for an entry, besides its key and value.
_ENTRY_BYTES = 100
#: Text whose parts are told apart at once.
SLICE_BYTES = 4 << 20

_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


#: Texts without these characters are lower-cased and split here as the tokenizer's file says
#: (contractions, letters, single digits, runs of other marks); NFC leaves them as they are.
#: Words of other texts go to the tokenizer whole.
_OTHER = r"[^\t\n\x0B\f\r -~ªµºÀ-ÖØ-öø-ÿ]"
_EDGES = r"('(?:s|t|re|ve|m|ll|d)|[!-/:-@\[-`{-~]+|[0-9])"
#: Parts that the tokenizer neither changes nor splits any further.
_PLAIN = r"^(?:'(?:s|t|re|ve|m|ll|d)|[a-zªµºß-öø-ÿ]+|[!-/:-@\[-`{-~]+|[0-9])$"
#: Plain parts that the model gets as one text, and such texts at a time.
_JOINED_PARTS = 256
_JOINED_TEXTS = 16
_NO_PARTS = pa.array([], pa.large_string())
_NO_IDS = pa.array([], pa.large_list(pa.uint32()))


class WordTokenizer:
    """Ids of whole texts from a tokenizers file, by way of the parts that it never merges across."""

    def __init__(self, path: str, cached_parts: int = CACHED_PARTS, cached_bytes: int = CACHED_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already keep all cores busy
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        self._model = Tokenizer(self._tokenizer.model)
        self._model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix, vocab = getattr(self._tokenizer.model, "end_of_word_suffix", None), self._tokenizer.get_vocab()
        self._ends_word = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self._ends_word[i] = suffix and token.endswith(suffix)
        self._special = "|".join(re.escape(t.content) for t in self._tokenizer.get_added_tokens_decoder().values())
        self._limit = cached_parts
        self._limit_bytes = cached_bytes // 2  # for plain parts, and for others
        self._plain, self._plain_ids = _NO_PARTS, _NO_IDS
        self._ids: dict[str, bytes] = {}
        self._bytes = 0

    def _of_parts(self, parts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of distinct parts."""
        found = list(map(self._ids.get, parts))
        new = [k for k, ids in enumerate(found) if ids is None]
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            for k, e in zip(some, self._tokenizer.encode_batch_fast([parts[k] for k in some], add_special_tokens=False)):
                found[k] = array("I", e.ids).tobytes()
                self._keep(parts[k], found[k])
        return found

    def _of_plain(self, parts: pa.Array) -> pa.LargeListArray:
        """Ids of plain parts. Many make one text, as an id tells whether it ends a word."""
        ids, counts = [np.empty(0, np.uint32)], [np.zeros(1, np.int64)]
        step = _JOINED_PARTS * _JOINED_TEXTS
        for at in range(0, len(parts), step):
            some = parts.slice(at, step).to_pylist()
            joined = [some[k : k + _JOINED_PARTS] for k in range(0, len(some), _JOINED_PARTS)]
            for own, e in zip(joined, self._model.encode_batch_fast(list(map(" ".join, joined)), add_special_tokens=False)):
                of_text = np.array(e.ids, np.uint32)
                ends = np.flatnonzero(self._ends_word[of_text]) + 1
                if len(ends) != len(own):  # a file whose words have no ends
                    blobs = self._of_parts(own)
                    of_text = np.frombuffer(b"".join(blobs), np.uint32)
                    ends = np.cumsum([len(b) // 4 for b in blobs])
                ids.append(of_text)
                counts.append(np.diff(ends, prepend=0))
        return pa.LargeListArray.from_arrays(np.cumsum(np.concatenate(counts)), np.concatenate(ids))

    def _of_distinct(self, parts: pa.Array) -> pa.LargeListArray:
        """Ids of distinct parts: those of known plain ones, new plain ones and others, put in order."""
        place = pc.index_in(parts, value_set=self._plain)
        new = place.is_null()
        some = parts.filter(new)
        is_plain = pc.match_substring_regex(some, _PLAIN)
        plain = some.filter(is_plain)
        plain_ids = self._of_plain(plain)
        blobs = self._of_parts(some.filter(pc.invert(is_plain)).to_pylist())
        upto = np.cumsum([0, *(len(b) // 4 for b in blobs)])
        other_ids = pa.LargeListArray.from_arrays(upto, np.frombuffer(b"".join(blobs), np.uint32))
        ids = pa.concat_arrays([self._plain_ids, plain_ids, other_ids])
        place = place.fill_null(0).to_numpy(zero_copy_only=False).copy()
        of_new, is_plain = np.flatnonzero(new), is_plain.to_numpy(zero_copy_only=False)
        place[np.concatenate([of_new[is_plain], of_new[~is_plain]])] = np.arange(len(self._plain), len(ids))
        self._keep_plain(plain, plain_ids)
        return ids.take(pa.array(place))

    def _keep_plain(self, parts: pa.Array, ids: pa.Array) -> None:
        for known, known_ids in (self._plain, self._plain_ids), (self._plain[:0], self._plain_ids[:0]):
            if len(known) + len(parts) <= self._limit and known.nbytes + known_ids.nbytes + parts.nbytes + ids.nbytes <= self._limit_bytes:
                self._plain, self._plain_ids = pa.concat_arrays([known, parts]), pa.concat_arrays([known_ids, ids])
                return
        self._plain, self._plain_ids = _NO_PARTS, _NO_IDS

    def _keep(self, part: str, ids: bytes) -> None:
        more = sys.getsizeof(part) + sys.getsizeof(ids) + _ENTRY_BYTES
        if len(self._ids) >= self._limit or self._bytes + more > self._limit_bytes:
            self._ids = {}
            self._bytes = 0
        if more <= self._limit_bytes:
            self._ids[part] = ids
            self._bytes += more

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has."""
        texts = pc.fill_null(unsliced(texts).cast(pa.large_string()), "")
        special = pc.match_substring_regex(texts, self._special) if self._special else None
        if special is None or not pc.any(special).as_py():
            return self._by_parts(texts)
        ids, counts = self._by_parts(pc.if_else(special, "", texts))
        apart = np.split(ids, np.cumsum(counts)[:-1])
        for k in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist():
            apart[k] = np.array(self._tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(apart), np.array([len(x) for x in apart])

    def _by_parts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.replace_substring_regex(pc.utf8_lower(texts), _EDGES, r" \1 ")
        texts = pc.if_else(pc.match_substring_regex(texts, _OTHER), texts, split)
        words = pc.ascii_split_whitespace(texts)
        distinct = words.flatten().dictionary_encode()
        ids = self._of_distinct(distinct.dictionary).take(distinct.indices)
        upto = ids.offsets.to_numpy()[words.offsets.to_numpy() - words.offsets[0].as_py()]
        return ids.flatten().to_numpy(), np.diff(upto)


_tokenizers: dict[tuple[str, int, int], WordTokenizer] = {}


def unsliced(texts: pa.Array) -> pa.Array:
    """A copy with offsets from 0: Arrow's ascii_lower misreads the cast of a slice."""
    return pa.concat_arrays([texts])


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about so many bytes in a text column, a row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    slot = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(slot)) + 1).tolist(), len(batch)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def power_of_two_lengths(n: int, max_len: int) -> list[int]:
    """Lengths, longest first, of the pieces of n tokens."""
    whole, rest = divmod(n, max_len)
    return [max_len] * whole + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack_power_of_two(docs: DataFrame, tokenizer_path: str, *, max_len: int = MAX_LEN, end_id: int = END_ID, with_ids: bool = True, cached_parts: int = CACHED_PARTS, cached_bytes: int = CACHED_BYTES, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket
    (log2 of the length) and, with_ids, token_ids.

    ``max_len`` must be a power of two. A sequence is one piece, so offset is 0. A larger
    cache and larger slices cost memory and save time; they never change a result.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = tokenizer_path, cached_parts, cached_bytes
        tokenizer = _tokenizers.get(key) or _tokenizers.setdefault(key, WordTokenizer(*key))
        for batch in batches:
            for some in slices(batch, 1, slice_bytes):
                ids, counts = tokenizer.encode(some.column(1))
                raw, at = ids.astype("<u4").tobytes(), 0
                rows: list[tuple] = []
                pieces: list[bytes] = []
                for doc_id, n_ids in zip(some.column(0).to_pylist(), counts.tolist()):
                    own = raw[at : at + 4 * n_ids] + end
                    at += 4 * n_ids
                    start = 0
                    for n in power_of_two_lengths(n_ids + 1, max_len):
                        piece = own[4 * start : 4 * (start + n)]
                        rows.append((doc_id, start, n, zlib.crc32(piece), n_ids + 1))
                        if with_ids:
                            pieces.append(piece)
                        start += n
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in pieces])]).astype(np.int32)
                    flat = np.frombuffer(b"".join(pieces), "<u4").astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
            pa.default_memory_pool().release_unused()  # else Arrow keeps what a batch took, into later stages too

    schema = _SCHEMA + (", token_ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema).withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "bucket": F.log2("length").cast("int")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder of equal-length sequences for each bucket."""
    pieces.write.partitionBy("bucket").parquet(path)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_power_of_two(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False, cached_parts=1_000_000, cached_bytes=256 << 20, slice_bytes=32 << 20)


QUERIES = {"op3_packing": op3_packing}
ORACLES: dict[str, str] = {}
