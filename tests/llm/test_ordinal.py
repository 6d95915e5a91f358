import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from netloom.llm.ordinal import OrdinalModel, features, fit_on_sample, fit_ordinal, op9_quality_grade, quality_grade, score_ordinal, slot


def graded(n, seed):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        grade = r.randrange(3)
        words = r.choices([f"w{j}" for j in range(50)], k=40)
        for word in {0: ["junk", "spam"], 1: ["rude"], 2: []}[grade]:
            words.insert(r.randrange(40), word)
        rows.append((k, " ".join(words), grade))
    return rows


def test_held_out_accuracy_and_order_of_the_thresholds(spark):
    frame = spark.createDataFrame(graded(600, 1), "doc_id long, text string, grade int")
    model = fit_on_sample(frame, frame, 3, sample_rows=400)
    assert model.thresholds[0] < model.thresholds[1]
    test = graded(300, 2)
    rows = score_ordinal(spark.createDataFrame(test, "doc_id long, text string, grade int"), model).collect()
    grade = {k: g for k, _, g in test}
    assert np.mean([r.kept == (grade[r.doc_id] == 2) for r in rows]) > 0.97
    assert np.mean([round(r.expected_grade) == grade[r.doc_id] for r in rows]) > 0.95
    assert all(r.p_at_least_1 >= r.p_at_least_2 for r in rows)


def test_sample_is_bounded_and_the_fit_repeats(spark):
    frame = spark.createDataFrame(graded(300, 3), "doc_id long, text string, grade int")
    a, b = fit_on_sample(frame, frame, 3, sample_rows=100), fit_on_sample(frame.repartition(5), frame.repartition(3), 3, sample_rows=100)
    assert (a.weights == b.weights).all() and (a.thresholds == b.thresholds).all()


def test_odd_texts_and_tables(spark):
    model = OrdinalModel(np.zeros(64), np.array([-1.0, 1.0]))
    texts = [None, "", "a", "a", "w" * 100000, "é ñ 漢字"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "1 kept")
    rows = score_ordinal(frame, model).collect()
    assert len(rows) == 6 and all(r.expected_grade == pytest.approx(1.0) for r in rows)
    assert score_ordinal(frame.limit(0), model).count() == 0
    nothing = fit_ordinal(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 3, 64)
    assert (nothing.weights == 0).all() and nothing.thresholds[0] < nothing.thresholds[1]


def test_query_on_the_labelled_documents(spark, tiny):
    small = tiny.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    rows = {r.doc_id: r for r in op9_quality_grade(spark, small).collect()}
    assert len(rows) == 1000
    right = [rows[k].kept == bool(x.quality and not x.toxic) for k, x in labels.items()]
    assert np.mean(right) > 0.9


def test_scores_against_brute_force(spark):
    """Features that share a slot count once, as in the fit."""
    r = np.random.default_rng(3)
    model = OrdinalModel(r.standard_normal(32), np.array([-0.5, 0.7]))
    texts = [None, "", "Some words here, some Words there!", "junk " * 50, *(text for _, text, _ in graded(30, 5))]
    frame = spark.createDataFrame([(k, t, 1.0, "x") for k, t in enumerate(texts)], "doc_id long, text string, expected_grade double, p_at_least_1 string")
    for row in score_ordinal(frame, model).collect():
        score = sum(np.float32(model.weights)[sorted({slot(f, 32) for f in features(texts[row.doc_id])})].astype(float))
        tails = [1 / (1 + np.exp(t - score)) for t in model.thresholds]
        assert [row.p_at_least_1, row.p_at_least_2] == pytest.approx(tails) and row.expected_grade == pytest.approx(sum(tails)) and row.kept == (tails[1] >= 0.5)


def test_held_out_labels(spark, tiny):
    """Fitted on four fifths of the labelled documents, the model grades the others."""
    small = tiny.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    ratings = spark.read.parquet(f"{small}/labels.parquet").select("doc_id", quality_grade(F.col("quality"), F.col("toxic")).alias("grade")).filter("grade IS NOT NULL")
    model = fit_on_sample(docs, ratings.filter("doc_id % 5 <> 0"), 3)
    test = {x.doc_id: x.grade for x in ratings.filter("doc_id % 5 = 0").collect()}
    rows = [x for x in score_ordinal(docs, model).collect() if x.doc_id in test]
    assert len(rows) > 20 and np.mean([x.kept == (test[x.doc_id] == 2) for x in rows]) > 0.85
