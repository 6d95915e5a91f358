import random
import re
from itertools import permutations

from netloom.llm import audit
from netloom.llm.audit import audit_filters


def fails_of(rows):
    """The letters of the filters that each row (doc_id, lang, text) fails."""
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = []
    for i, _, t in rows:
        text = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and first[text] < i}
        out.append({f for f, bad in failed.items() if bad})
    return out


def slow(rows, labels):
    """Every order walked row by row."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    failed, out = fails_of(rows), {}
    for part in {lang or "" for _, lang, _ in rows}:
        own = [(i, f) for (i, lang, _), f in zip(rows, failed) if (lang or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                total[x] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(x in f for _, f in own) - len(gone), sum(f == {x} for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def found(frame):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = frame.collect()
    out = {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in rows}
    assert len(out) == len(rows)
    return out


KIND = "doc_id long, lang string, text string, part string, n int, first int, digest string"


def test_orders_against_a_walk_of_each(spark, monkeypatch):
    r = random.Random(8)
    word = lambda: r.choice(["lower", "Upper", "é", "x#y", f"w{r.randint(0, 9999)}", f"v{r.randint(0, 9999)}"])
    texts = [" ".join(word() for _ in range(r.choice([3, 150, 200, 260, 400]))) for _ in range(25)] + [" ".join(f"p{k}" for k in range(250)), "q " * 300, "q " * 100, None, "", " \t", "CAPS " * 210]
    rows = [(k, r.choice(["en", "en", "de", None, "", "fr"]), r.choice(texts)) for k in range(160)] + [(500 + k, "en", texts[25]) for k in range(90)]
    rows += [rows[4]] * 30 + [(None, "en", texts[25]), (None, "en", None), (4, "en", texts[0]), (-1, "nn", texts[1]), (999, "de", "long " * 60_000)]
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 1, None])) for k in range(0, 600, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (77_777, 1, 1)]
    docs = spark.createDataFrame([(*x, "mine", 1, 2, "d") for x in rows], KIND).repartition(6)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = slow(rows, labels)
    assert found(audit_filters(docs, said)) == want
    monkeypatch.setattr(audit, "least_hot", lambda total: 20)  # texts of more than 20 rows are hot
    assert found(audit_filters(docs, said)) == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "en", "a b", "x", 1, 1, "d")], KIND)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert found(audit_filters(docs, none)) == slow([(1, "en", "a b")], [])
    assert audit_filters(docs.limit(0), none).count() == 0
