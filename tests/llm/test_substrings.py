import hashlib
import random

import pytest

from netloom.llm import buckets, substrings
from netloom.llm.substrings import drop_repeats, gram_widths, op4_substring_dedup, pieces, stretches_of


def brute(docs, window):
    first = {}
    for doc_id, text in docs:
        words = (text or "").encode().split()
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            if doc_id is not None:
                first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in docs:
        words = (text or "").encode().split()
        gone = set()
        for k in range(len(words) - window + 1):
            if doc_id is not None and first[tuple(words[k : k + window])] < doc_id:
                gone.update(range(k, k + window))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((doc_id, len(words), len(gone), kept.decode()))
    return out


def same(spark, docs, window, gram, **how):
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, mark string")
    rows = drop_repeats(frame, window=window, gram=gram, **how).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, rows), key=key) == sorted(brute(docs, window), key=key)


@pytest.mark.parametrize(("window", "gram", "seed"), [(5, 2, 1), (8, 3, 2), (50, 8, 3)])
def test_random_texts_with_shared_passages(spark, window, gram, seed):
    r = random.Random(seed)
    words = ["a", "b", "c", "é", "x\x1cy"] if window < 10 else [f"w{k}" for k in range(300)]
    passages = [" ".join(r.choices(words, k=r.randint(window - 2, 3 * window))) for _ in range(6)]
    docs = [(k, "\n".join(r.choice([" ".join(r.choices(words, k=r.randint(0, 2 * window))), r.choice(passages)]) for _ in range(r.randint(0, 5)))) for k in range(60)]
    docs += [(100 + k, docs[7][1]) for k in range(5)] + [docs[9], docs[9], (docs[3][0], docs[4][1]), (None, docs[5][1]), (None, None), (99, None), (98, ""), (97, " \t")]
    docs.append((-5, passages[0]))
    docs.append((96, "aa " * (20 * window)))
    docs.append((95, "aa " * (7 * window)))
    same(spark, docs, window, gram)


def test_a_passage_in_very_many_documents(spark):
    r = random.Random(4)
    passage = " ".join(f"p{k}" for k in range(30))
    docs = [(k, " ".join(f"{r.random()}" for _ in range(9)) + " " + passage + " " + str(k)) for k in range(700)]
    same(spark, docs, 20, 4)


def test_empty_table(spark):
    assert drop_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_against_brute_force(spark, tiny):
    docs = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in brute(docs, 50))
    assert sorted(map(tuple, op4_substring_dedup(spark, tiny).collect())) == want
    assert any(x[2] for x in want)


def skewed_documents():
    r = random.Random(6)
    text = lambda n: " ".join(f"w{r.randint(0, 400)}" for _ in range(n))
    line, copy = text(12), text(60)
    docs = [(k, f"{text(9)} {line} {text(r.randint(0, 9))}") for k in range(60)]
    docs += [(100 + k, copy) for k in range(60)] + [(200 + k, f"{text(3)} {copy} {text(4)}") for k in range(20)]
    return docs + [(300, " ".join(["x", "y"] * 300)), (301, " ".join(["y", "x"] * 40)), (302, "z " * 500), (303, "z " * 30)]


@pytest.mark.parametrize(("group_words", "hot"), [(40, 1000), (400, 1000), (1, 5), (100_000, 20)])
def test_groups_that_split_and_hot_grams(spark, monkeypatch, group_words, hot):
    monkeypatch.setattr(buckets, "HOT_LEAST", hot)
    same(spark, skewed_documents(), 14, 3, group_words=group_words)


def test_bits_that_all_groups_share(spark, monkeypatch):
    monkeypatch.setattr(substrings, "_bits_of", lambda keys: ~substrings.np.zeros(1 << substrings.FLAG_BITS >> 6, substrings.np.uint64))
    same(spark, skewed_documents(), 14, 3, group_words=200)


def test_widths_double_up_to_the_window():
    assert gram_widths(50, 8) == [8, 16, 32, 50]
    assert gram_widths(5, 5) == [5]


def test_a_long_text_is_cut_without_losing_a_window():
    r = random.Random(7)
    words = [f"{r.randint(0, 10**r.randint(1, 9))}".encode() for _ in range(900)]
    text = b" \t".join(words)
    windows = []
    for some in pieces([b"short text", text, b""], 20, 300):
        for k, before, part in some:
            own = part.split()
            windows += [(k, before + j, tuple(own[j : j + 20])) for j in range(len(own) - 19)]
    assert sorted(windows) == [(1, j, tuple(words[j : j + 20])) for j in range(881)]


def test_a_repeated_phrase_is_one_stretch():
    of, *_ = stretches_of([b"so it goes " * 5000], 50, [8], [])
    assert len(of) == 1


def thue_morse(n, swap=False):
    return ["ab"[(k.bit_count() + swap) % 2] for k in range(n)]


def test_words_and_texts_that_collide_in_a_polynomial_hash(spark):
    """The Thue-Morse word and its complement have one polynomial hash modulo 2 ** 64, whatever the base."""
    rest = " ".join(f"w{k}" for k in range(49))
    docs = [(k, "".join(thue_morse(2048, k == 2)) + " " + rest) for k in (1, 2)]
    docs += [(3, " ".join(thue_morse(4096))), (4, " ".join(thue_morse(4096, True))), (5, " ".join(thue_morse(300)) + " z " + " ".join(thue_morse(2100, True)))]
    same(spark, docs, 50, 8)
    same(spark, docs, 50, 8, group_words=1)
    assert {r.doc_id: r.n_removed for r in drop_repeats(spark.createDataFrame(docs[:2], "doc_id long, text string")).collect()} == {1: 0, 2: 0}


def test_equal_suffixes_are_one_stretch_only_if_their_words_are():
    _, _, digest, low, high = stretches_of([b"a " * 70 + b"b " + b"a " * 80], 50, [50], [])
    found = dict(zip(low.tolist(), high.tolist()))
    assert found[0] == 20 and found[71] == 101 and len(set(digest)) == len(digest) - 1
