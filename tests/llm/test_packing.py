import json
import sys
import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from netloom.llm.packing import WordTokenizer, op3_packing, pack_power_of_two, power_of_two_lengths

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " \t\n", "a", "Don't STOP!! l'été it'LL .'s o'd've ÀÉ ß µ ªº ²½ 12,5 x y é ΣΑΣ İstanbul 漢字 <|endoftext|> ###a### _x_ 'S", "́ x y\x1cz", "word " * 30000, "w" * 3000, "<|endoftext|> x", "a<|STARTOFTEXT|>b<|startoftext|>c", "<|endoftext|>"]


@cache
def whole():
    return Tokenizer.from_file(PATH)


def test_ids_of_words_are_the_ids_of_the_text(spark, tiny):
    texts = ODD + [r[0] for r in spark.read.parquet(f"{tiny}/documents.parquet").select("text").collect()]
    for cached in (800_000, 50):
        own = WordTokenizer(PATH, cached)
        ids, counts = own.encode(pa.array(texts))
        for text, some in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            assert some.tolist() == whole().encode(text or "", add_special_tokens=False).ids


def test_slices_of_a_batch_are_read_like_the_batch():
    docs = pa.array([f"Some Words {k} é" * (k % 5) for k in range(50)])
    own = WordTokenizer(PATH)
    apart = np.concatenate([own.encode(docs.slice(k, 10))[0] for k in range(0, 50, 10)])
    assert (apart == own.encode(docs)[0]).all()


def test_the_cache_is_bounded_in_bytes_and_never_changes_ids():
    letters = ["".join(chr(97 + k // 26**j % 26) for j in range(5)) * 8 for k in range(280_000)]
    texts = pa.array([" ".join(letters[at : at + 1000]) for at in range(0, len(letters), 1000)])
    own = WordTokenizer(PATH)
    ids = own.encode(texts)[0]
    assert sum(sys.getsizeof(x) for entry in own._ids.items() for x in entry) < 48 << 20
    small = WordTokenizer(PATH, cached_bytes=1000)
    assert (small.encode(texts.slice(0, 9))[0] == ids[: len(small.encode(texts.slice(0, 9))[0])]).all()
    assert len(small._ids) < 10


class Seen:
    """A tokenizer that notes the texts it gets."""

    def __init__(self, own):
        self._own, self.texts = own, []

    def encode_batch_fast(self, texts, **how):
        self.texts += texts
        return self._own.encode_batch_fast(texts, **how)


def test_plain_parts_share_texts_and_are_kept():
    """One text for each part took most of the packing's time."""
    words = ["".join(chr(97 + k // 26**j % 26) for j in range(4)) + "éß"[: k % 3] for k in range(9000)]
    plain, other = " ".join(words) + " It's 12,5 x... don't 'Sé ªº µ", "漢字 x漢 İI abc don't"
    texts = pa.array([plain, other, None, ""])
    own = WordTokenizer(PATH)
    own._tokenizer, own._model = each, joined = Seen(own._tokenizer), Seen(own._model)
    for _ in range(2):
        ids, counts = own.encode(texts)
        for text, some in zip(texts.to_pylist(), np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            assert some.tolist() == whole().encode(text or "", add_special_tokens=False).ids
        assert len(each.texts) < 10 and len(joined.texts) < 50
    assert len(own._plain) == len(own._plain_ids) > 9000


def test_plain_parts_are_kept_within_bounds():
    words = ["".join(chr(97 + k // 26**j % 26) for j in range(5)) for k in range(20_000)]
    for cached, most, how_many in ((5000, 48 << 20, 5000), (500_000, 200_000, 20_000), (500_000, 1000, 100)):
        own = WordTokenizer(PATH, cached, most)
        kept = set()
        for at in [*range(0, 20_000, 1000), 0, 500, 19_000]:
            some = words[at : at + 1000]
            ids = own.encode(pa.array([" ".join(some)]))[0]
            assert ids.tolist() == whole().encode(" ".join(some), add_special_tokens=False).ids
            assert len(own._plain) == len(own._plain_ids) <= how_many and own._plain.nbytes + own._plain_ids.nbytes <= most // 2
            kept.add(len(own._plain))
        assert (len(kept) > 2) == (most > 1000)


def test_models_whose_words_have_no_ends(tmp_path):
    """Boundaries of parts that share a text are then asked for one by one."""
    file = json.loads(open(PATH, encoding="utf-8").read())
    file["model"] |= {"end_of_word_suffix": None, "merges": []}
    path = tmp_path / "no_ends.json"
    path.write_text(json.dumps(file), encoding="utf-8")
    ids = WordTokenizer(str(path)).encode(pa.array(["It's été 12 abc abc", "漢"]))[0]
    assert ids.tolist() == [i for text in ("It's été 12 abc abc", "漢") for i in Tokenizer.from_file(str(path)).encode(text, add_special_tokens=False).ids]


def test_lengths_are_powers_of_two():
    assert power_of_two_lengths(4096 * 2 + 13, 4096) == [4096, 4096, 8, 4, 1]
    assert power_of_two_lengths(4096, 4096) == [4096]


def test_pieces_are_whole_documents_cut(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD + ["a", "a"])], "doc_id long, text string, length string")
    docs = docs.union(docs.filter("doc_id = 3"))
    pieces = pack_power_of_two(docs, PATH).collect()
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    seen = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.length == 1 << p.bucket == len(p.token_ids) <= 4096 and p.offset == 0
        assert p.ids_crc32 == zlib.crc32(np.array(p.token_ids, "<u4").tobytes())
        if p.doc_id != 3:
            assert p.start == len(seen.setdefault(p.doc_id, []))
            seen[p.doc_id] += p.token_ids
    for i, ids in seen.items():
        assert ids == whole().encode((ODD + ["a", "a"])[i] or "", add_special_tokens=False).ids + [2]
    assert sum(p.doc_id == 3 for p in pieces) == 2


def test_empty_table_and_bad_length(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pack_power_of_two(docs, PATH).count() == 0
    with pytest.raises(ValueError):
        pack_power_of_two(docs, PATH, max_len=1000)


def test_special_tokens_are_read_as_the_file_says():
    ids, counts = WordTokenizer(PATH).encode(pa.array(["b", "<|endoftext|> x", None, "a"]))
    assert np.split(ids, np.cumsum(counts)[:-1])[1].tolist() == whole().encode("<|endoftext|> x", add_special_tokens=False).ids == [49407, 343]


def test_rows_without_an_id_are_packed(spark):
    rows = pack_power_of_two(spark.createDataFrame([(None, "a b c"), (None, None)], "doc_id long, text string"), PATH).collect()
    assert {r.doc_id for r in rows} == {None} and sum(r.length for r in rows) == 5


def test_query_against_brute_force(spark, tiny):
    """Every id of every document lies in exactly one piece, and sequences are gapless and not padded."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    rows = op3_packing(spark, tiny).collect()
    upto = dict.fromkeys(texts, 0)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        ids = whole().encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert r.start == upto[r.doc_id] and r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        upto[r.doc_id] += r.length
        assert r.offset == 0 and r.length <= 4096 and r.length & (r.length - 1) == 0
    assert all(upto[i] == len(whole().encode(t or "", add_special_tokens=False).ids) + 1 for i, t in texts.items())
    assert len({r.sequence_id for r in rows}) == len(rows)
