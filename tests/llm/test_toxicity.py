import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from netloom.llm.toxicity import Examples, op12_toxicity, score_toxicity, telling_terms, terms_of


def test_terms_of_a_word():
    assert terms_of(b"Trash###") == ["trash", "tras*"]
    assert terms_of("«Öffentlich,".encode()) == ["öffentlich", "öffe*", "öffen*", "öffent*", "öffentl*"]
    assert terms_of(b"---") == [] and terms_of(b"\xff") == []


@pytest.mark.parametrize("block", [1, 3, 64])
def test_nearest_against_every_example(block):
    r = random.Random(block)
    idf = np.array([r.choice([0.0, 0.5, 1.0, 2.5]) for _ in range(40)])
    vectors = [(sorted(r.sample(range(40), r.randint(0, 9))), []) for _ in range(300)]
    vectors = [(t, [r.randint(1, 4) for _ in t]) for t, _ in vectors]
    ids = r.sample(range(5000), 300)
    index = Examples(ids, [r.randint(0, 1) for _ in ids], vectors, idf, block)

    def weights(terms, counts):
        raw = {t: (1 + math.log(n)) * idf[t] for t, n in zip(terms, counts) if idf[t] > 0}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {t: x / norm for t, x in raw.items()}

    whole = [weights(*v) for v in vectors]
    for without in (None, ids[7]):
        for query in [*vectors[:60], ([], []), ([0, 1, 2], [9, 9, 9])]:
            own = weights(*query)
            cosines = [(-sum(x * w.get(t, 0) for t, x in own.items()), i) for i, w in zip(ids, whole) if i != without]
            want = sorted(x for x in cosines if x[0] < 0)[:15]
            got = [(c, int(index.ids[at])) for c, at in index.nearest(*query, without=without)]
            assert [c for c, _ in got] == pytest.approx([-c for c, _ in want], abs=1e-9)
            clear = [k for k in range(len(want)) if all(abs(want[k][0] - c) > 1e-9 for c, i in cosines if i != want[k][1])]
            assert all(got[k][1] == want[k][1] for k in clear)


def made(r, n, languages=("", "x")):
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(n):
        toxic = r.random() < 0.2
        text = r.choices(words, k=r.randint(5, 80))
        if toxic:
            text += r.choices(["vileword", "nastystem" + r.choice("abcdefg"), "FOUL!"], k=r.randint(2, 6))
            r.shuffle(text)
        rows.append((k, " ".join(text), int(toxic)))
    return rows


def test_scores_of_odd_tables(spark):
    r = random.Random(4)
    rows = made(r, 400)
    texts = [(i, t, "s", 1.0) for i, t, _ in rows] + [(1000, None, "s", 1.0), (1001, "", "s", 1.0), (None, "vileword FOUL!", "s", 1.0), (rows[3][0], rows[3][1], "s", 1.0), (1002, "plain " * 100_000 + "vileword foul nastystemq", "s", 1.0)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, toxic string, score double").repartition(5)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, None), (None, 1), (99_999, 1), (rows[0][0], rows[0][2])], "doc_id long, toxic int")
    found = score_toxicity(docs, labels).collect()
    assert len(found) == len(texts) and all(0 <= x.score <= 1 for x in found)
    score = {}
    for x in found:
        assert score.setdefault(x.doc_id, x.score) == x.score
    assert all((score[i] >= 0.3) == bool(y) for i, _, y in rows)
    assert score[1000] == score[1001] < 0.2 and score[None] > 0.5 and score[1002] > 0.3
    near = next(x for x in found if x.doc_id is None).evidence
    assert len(near) == 15 and all(e.toxic == 1 for e in near[:5]) and [e.cosine for e in near] == sorted((e.cosine for e in near), reverse=True)
    again = score_toxicity(docs.repartition(3), labels).select("doc_id", "score").collect()
    assert sorted(map(str, ((x.doc_id, x.score) for x in again))) == sorted(map(str, ((x.doc_id, x.score) for x in found)))
    assert score_toxicity(docs.limit(0), labels).count() == 0
    assert {x.score for x in score_toxicity(docs, labels.limit(0)).collect()} == {0.0}


def test_terms_are_those_that_tell(spark):
    r = random.Random(2)
    rows = made(r, 500)
    terms = telling_terms(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert {"vileword", "foul", "nastys*"} <= set(terms) and sum(t[0] == "w" for t in terms) <= 1
    n = Counter(t for _, text, y in rows if y for t in {"vileword"} & set(text.split()))
    assert n["vileword"] > 3


def test_query_leaves_held_out_labels_alone_and_finds_toxic_documents(spark):
    sf = "/root/testdata/sf0.1"
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op12_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in label]
    caught = [r.predicted for r in held if label[r.doc_id]]
    clean = [r.predicted for r in held if not label[r.doc_id]]
    assert sum(caught) >= 0.9 * len(caught) > 50 and sum(clean) <= 0.03 * len(clean)
