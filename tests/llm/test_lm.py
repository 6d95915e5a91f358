import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from netloom.llm.lm import Lookup, Texts, _answer, _ask, _first_pass, _sum_up, held_out, levels_of, log10_probabilities, op1_ppm, ppm_scores


def lower(text):
    return (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()


def is_held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def brute(docs, order):
    """Scores by a dictionary of contexts, a byte at a time."""
    counts = defaultdict(Counter)
    words = Counter()
    for doc_id, text in docs:
        if not is_held(doc_id):
            words.update(lower(text) + [b"\n"])
            raw = b"\n" * order + b" ".join(lower(text)) + b"\n"
            for k in range(order, len(raw)):
                for n in range(order + 1):
                    counts[raw[k - n : k]][raw[k]] += 1

    def chance(context, byte):
        out, gone = 0.0, set()
        for n in range(len(context), -1, -1):
            seen = {b: c for b, c in counts[context[len(context) - n :]].items() if b not in gone} if context[len(context) - n :] in counts else {}
            if not seen:
                continue
            total = sum(seen.values())
            if byte in seen:
                return out + math.log10((seen[byte] - 0.5) / total)
            out += math.log10(0.5 * len(seen) / total)
            gone |= set(seen)
        return out - math.log10(max(1, 256 - len(counts.get(b"", {}))))

    n, v = sum(words.values()), len(words)
    rows = []
    for doc_id, text in docs:
        tokens = lower(text) + [b"\n"]
        raw = b"\n" * order + b" ".join(lower(text)) + b"\n"
        score = sum(chance(raw[k - order : k], raw[k]) for k in range(order, len(raw)))
        base = sum(math.log10((words[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
        rows.append((doc_id, is_held(doc_id), len(tokens), sum(words[t] > 0 for t in tokens), n, base, score))
    return rows


def compare(rows, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6), round(r[6], 2))
    rows, want = sorted(map(tuple, rows), key=key), sorted(want, key=key)
    assert [r[:5] for r in rows] == [r[:5] for r in want]
    for r, w in zip(rows, want):
        assert r[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9) and r[6] == pytest.approx(w[6], rel=1e-5, abs=1e-5)


@pytest.mark.parametrize("order", [3, 5])
def test_scores_are_those_of_a_dictionary_of_contexts(spark, order):
    r = random.Random(order)
    docs = [(k, " ".join(r.choice(["the", "The", "then", "été", "x\x00y", "a"]) + r.choice(["", "s", "."]) for _ in range(r.randint(0, 30)))) for k in range(60)]
    docs += [(70, None), (71, ""), (72, " \t\n "), (73, " lead and trail  "), (None, "the null"), docs[5], docs[5], (80, "\u6f22\u5b57 zzz"), (81, "q" * 3000)]
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, block int").repartition(3)
    compare(ppm_scores(frame, held_out(F.col("doc_id")), order=order, block_bytes=700, shard_bytes=300).collect(), brute(docs, order))


def test_nothing_to_learn_from_and_nothing_at_all(spark):
    frame = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    (row,) = ppm_scores(frame, F.lit(True)).collect()
    assert row.score == pytest.approx(3 * math.log10(1 / 256)) and row.base_score == 0 and row.n_known == 0
    assert ppm_scores(frame.limit(0), F.lit(False)).count() == 0


def test_probabilities_of_all_bytes_sum_to_one():
    texts = Texts(pa.array(["abra cadabra abra", "cad abra"]), 4)
    grams, _, counts = texts.distinct_grams(np.ones(2, bool))
    levels = levels_of(grams, counts, 4, 0, [])
    for context in (b"\n\n\n\n", b"abra", b"zzra", b"cada", b"qqqq"):
        head = int.from_bytes(context, "big") << 8
        total = (10 ** log10_probabilities(np.array([head | b for b in range(256)], np.uint64), levels)).sum()
        assert total == pytest.approx(1)


def test_slices_of_a_batch_are_read_like_the_batch():
    docs = pa.array([f"Some Words {k} é" * (k % 5) for k in range(50)])
    apart = [Texts(docs.slice(k, 10), 3) for k in range(0, 50, 10)]
    assert b"".join(x.raw.tobytes() for x in apart) == Texts(docs, 3).raw.tobytes()
    assert [n for x in apart for n in x.n_words] == list(Texts(docs, 3).n_words)


def test_a_block_may_be_summed_up_in_another_order_of_rows_than_it_asked_in():
    r = random.Random(7)
    docs = [(k, " ".join(r.choice(["the", "The", "q\u00e9", "then", f"w{k}", f"w{r.randint(0, 40)}"]) for _ in range(r.randint(0, 20)))) for k in range(40)]
    ids, texts = [k for k, _ in docs], [t for _, t in docs]
    held = [is_held(k) for k in ids]
    (first,) = _first_pass(3)(iter([pa.record_batch([pa.array(texts), pa.array(held)], names=["text", "held_out"])]))
    sums = dict(sorted(zip(first.column(0).to_pylist(), first.column(1).to_pylist())))
    low = np.array([k for k in sums if k >= 0], "<u8").tobytes(), np.array([n for k, n in sums.items() if k >= 0], "<i8").tobytes()
    block = pa.table({"doc_id": ids, "text": texts, "held_out": held, "block": pa.array([0] * len(ids), pa.int32())})
    asked = _ask(3, 2)(block)
    replies = pa.concat_tables([_answer(3, low)(asked.filter(pc.equal(asked["shard"], s))) for s in range(2)])
    n_tokens, n_docs = sums[-1], sums[-2]
    for order in (range(40), range(39, -1, -1), r.sample(range(40), 40)):
        scored = _sum_up(3, 2, n_tokens, n_docs)(block.take(list(order)), replies).to_pylist()
        rows = [(x["doc_id"], x["held_out"], x["n_tokens"], x["n_known"], n_tokens + n_docs, x["base_score"], x["score"]) for x in scored]
        compare(rows, brute(docs, 3))


def test_lookup_finds_every_key():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 5000, dtype=np.uint64))
    assert (Lookup(keys, np.arange(len(keys)) % 7)(keys[::-1]) == np.arange(len(keys))[::-1]).all()


def test_query_against_brute_force(spark, tiny):
    docs = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    compare(op1_ppm(spark, tiny).collect(), brute(docs, 5))


def test_query_beats_the_base_on_held_out_documents(spark, tiny):
    held = op1_ppm(spark, tiny.replace("sf0.001", "sf0.1")).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]
