import random

import xxhash

from netloom.llm.simhash import drop_near_duplicates, fingerprint, op2_simhash, simhash_components


def slow_fingerprint(text):
    words = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(docs):
    prints = [slow_fingerprint(t) for _, t in docs]
    left, groups = set(range(len(docs))), {}
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            k = todo.pop()
            group.add(k)
            near = {j for j in left if (prints[j] ^ prints[k]).bit_count() <= 3}
            left -= near
            todo += near
        ids = [docs[k][0] for k in group if docs[k][0] is not None]
        groups |= {k: min(ids, default=None) for k in group}
    return [(docs[k][0], f"{prints[k]:016x}", groups[k]) for k in range(len(docs))]


def cases():
    r = random.Random(2)
    docs = [(k, " ".join(r.choice("the a An of été b c d e f g h".split()) for _ in range(r.randint(0, 40)))) for k in range(80)]
    long = [r.choice(["alpha", "beta", "gamma", "Delta", "eps"]) + str(r.randint(0, 9)) for _ in range(400)]
    for k in range(60):  # near copies
        copy = list(long)
        copy[r.randrange(400)] = f"x{k}"
        docs.append((100 + k, " ".join(copy)))
    return docs + [(None, None), (203, ""), (200, " \n"), docs[5], docs[5], (None, docs[7][1]), (201, "w " * 70000)]


def key(row):
    return (row[0] is None, row[0] or 0, row[1])


def test_fingerprints():
    for _, text in cases()[:-1]:
        assert fingerprint(text) == slow_fingerprint(text)


def test_components_are_those_of_all_pairs(spark):
    docs = cases()
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, fp string")
    rows = sorted(map(tuple, simhash_components(frame).collect()), key=key)
    assert rows == sorted(brute(docs), key=key)
    kept = drop_near_duplicates(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r[2] for r in rows})
    assert simhash_components(frame.limit(0)).count() == 0


def test_query_against_brute_force(spark, tiny):
    docs = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op2_simhash(spark, tiny).collect()), key=key) == sorted(brute(docs), key=key)
