from collections import Counter

from netloom.llm.quality import METRICS, RULES, cascade_order, estimate_rules, keep_quality, op8_quality_rules, quality_cascade

BLANKS = " \t\n\x0b\x0c\r"


def slow(text):
    text = text or ""
    words, lines, word = [], text.split("\n"), ""
    for c in text + " ":
        if c in BLANKS:
            words += [word] * bool(word)
            word = ""
        else:
            word += c
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    times = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    with_word = [x for x in lines if x.strip(BLANKS)]
    dup = sum(x in with_word[:k] for k, x in enumerate(with_word))
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_metrics_and_verdicts_of_odd_texts(spark):
    good = " ".join(f"word{k}" for k in range(80))
    texts = [None, "", " \n ", "a b c a b c", "é\x1cé x\n x \nx \n\n x ", good, good + " ###" * 40, good.upper(), "A # b\nA # b\n" * 60, "very " * 100000, good, good, "a a a a", "same line here\n" * 30]
    docs = spark.createDataFrame([(k, t, False) for k, t in enumerate(texts)], "doc_id long, text string, kept boolean")
    rows = quality_cascade(docs, metrics=METRICS).orderBy("doc_id").collect()
    assert [tuple(r[m] for m in METRICS) for r in rows] == [slow(t) for t in texts]
    assert [r.doc_id for r in rows if r.kept] == [5, 10, 11]
    for order in (list(RULES), list(RULES)[::-1]):
        assert [r.kept for r in quality_cascade(docs, order=order).orderBy("doc_id").collect()] == [r.kept for r in rows]
    assert quality_cascade(docs.limit(0)).count() == 0


def test_rules_that_reject_much_for_little_come_first():
    assert cascade_order({"slow": (1.0, 0.5), "fast": (0.1, 0.5), "useless": (0.01, 0.0), "also": (0.1, 0.5)}) == ["also", "fast", "slow", "useless"]


def test_estimates_cover_every_rule(spark, tiny):
    found = estimate_rules(spark.read.parquet(f"{tiny}/documents.parquet"))
    assert set(found) == set(RULES) and all(t > 0 and 0 <= s <= 1 for t, s in found.values())


def test_query_against_brute_force(spark, tiny):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{tiny}/labels.parquet").collect()}
    for r in op8_quality_rules(spark, tiny).collect():
        n, *_, repeat = want = slow(texts[r.doc_id])
        assert tuple(r[m] for m in METRICS) == want
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n) and not (r.kept and r.base_failed)
        if not r.base_failed and r.doc_id in labels:
            assert r.kept == bool(labels[r.doc_id])


def test_rows_go_to_the_rules_with_one_copy_of_their_text(spark):
    good = " ".join(f"word{k}" for k in range(80))
    docs = spark.createDataFrame([(1, good, "a"), (2, None, "b"), (None, good, None)], "doc_id long, text string, kept string")
    kept = keep_quality(docs)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.filter("text IS NOT NULL").collect()))
    node = kept._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "MapInArrow":
        node = node.children().head()
    assert node.children().head().output().size() == 1
