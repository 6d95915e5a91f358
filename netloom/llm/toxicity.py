"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over block-max inverted lists.

Terms are words (lower case, without marks around them) and their beginnings of 4 to 7
letters, written with a star. The vector space is that of the terms that tell labels
apart: those of the labelled examples whose likelihood ratio passes a bound corrected
for the number of terms tried, at most ``TERMS``. A term's weight is (1 + ln count) *
ln(documents / documents with it), counted over all documents, and cosines are exact.

Examples are at most ``EXAMPLES`` labelled rows, those with the smallest hashes of their
ids, so their inverted lists have a bounded size and go to every task. Examples are
sorted by their heaviest term and cut into blocks; a list keeps its greatest weight in
each block. A query takes blocks by the bound that these give and ends when no block
left can hold a nearer neighbour than the last of the k it has, so none is missed.

The k nearest vote with a weight that falls with distance, next to one vote for the
share of toxic examples. Votes become probabilities by a logistic fit on the votes that
each example gets from the others. A text without a term gets the share of toxic ones
among the examples without a term.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.session import checkpoint, table, written
from netloom.llm.text import encode

#: Labelled rows that are examples, at most.
EXAMPLES = 1 << 14
#: Terms of the vector space, at most, and the chance that a term that tells nothing is among them.
TERMS, CHANCE = 1024, 0.05
#: Examples with a toxic label that a term must occur in.
AT_LEAST = 3
NEIGHBOURS = 15
BLOCK = 256
THRESHOLD = 0.3
_BEGINNINGS = range(4, 8)
_KEPT_WORDS, _LONG_WORD = 200_000, 64


def terms_of(word: bytes) -> list[str]:
    """A word as written in the text as terms: itself and its beginnings."""
    plain = word.decode("utf-8", "replace").lower()
    first, last = 0, len(plain)
    while first < last and not plain[first].isalnum():
        first += 1
    while first < last and not plain[last - 1].isalnum():
        last -= 1
    plain = plain[first:last]
    return [plain, *(plain[:n] + "*" for n in _BEGINNINGS if n < len(plain))] if plain else []


class TermCounter:
    """Counts what ``known`` makes of terms; the words seen last are remembered."""

    def __init__(self, known: Callable[[list[str]], tuple]):
        self.known, self.seen = known, {}

    def counts(self, text: str | None) -> Counter:
        found: Counter = Counter()
        for word, n in Counter(encode(text).split()).items():
            terms = self.seen.get(word)
            if terms is None:
                terms = self.known(terms_of(word))
                if len(word) <= _LONG_WORD:
                    if len(self.seen) >= _KEPT_WORDS:
                        self.seen.clear()
                    self.seen[word] = terms
            for term in terms:
                found[term] += n
        return found


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, n and toxic: the examples that a term occurs in, of a part of them."""
    counter, every, toxic = TermCounter(tuple), Counter(), Counter()

    def told() -> pa.RecordBatch:
        terms = list(every)
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([every[t] for t in terms], pa.int64()), pa.array([toxic[t] for t in terms], pa.int64())], names=["term", "n", "toxic"])

    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            found = counter.counts(text)
            every.update(dict.fromkeys(found, 1))
            if label:
                toxic.update(dict.fromkeys(found, 1))
            if len(every) > 2_000_000:
                yield told()
                every.clear()
                toxic.clear()
    yield told()


def telling_terms(examples: DataFrame) -> list[str]:
    """The terms that occur more often in toxic examples than chance would have it, the surest first; from examples with text and toxic."""
    total, positive = examples.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < positive < total:
        return []
    counted = examples.mapInArrow(_occurrences, "term string, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    counted = checkpoint(counted.filter(F.col("toxic") >= AT_LEAST))
    tried = counted.count()

    def part(x: Column) -> Column:
        return F.when(x > 0, x * F.log(x.cast("double"))).otherwise(0.0)

    n, p = F.col("n"), F.col("toxic")
    cells = part(p) + part(n - p) + part(positive - p) + part(total - n - positive + p)
    ratio = 2 * (cells - part(n) - part(total - n) + F.lit(total * math.log(total) - positive * math.log(positive) - (total - positive) * math.log(total - positive)))
    sure = counted.withColumn("ratio", ratio).filter((p * total > n * positive) & (F.col("ratio") > 2 * math.log(max(tried, 1) / CHANCE)))
    return [r.term for r in sure.orderBy(F.desc(F.round("ratio", 6)), "term").limit(TERMS).collect()]


def term_vectors(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, terms (their numbers, ascending) and counts of every row."""
    number = {term: k for k, term in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TermCounter(lambda found: tuple(number[t] for t in found if t in number))
        for batch in batches:
            rows = [sorted(counter.counts(text).items()) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([[t for t, _ in r] for r in rows], pa.list_(pa.int32())), pa.array([[n for _, n in r] for r in rows], pa.list_(pa.int32()))], names=["doc_id", "terms", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, terms array<int>, counts array<int>")


class Examples:
    """Inverted lists of example vectors, with the greatest weight of every list in every block of examples."""

    def __init__(self, ids: list[int], labels: list[int], vectors: list[tuple[list[int], list[int]]], idf: np.ndarray, block: int = BLOCK):
        self.idf, self.block = idf, block
        weighed = [self.weights(*v) for v in vectors]
        order = sorted(range(len(ids)), key=lambda k: (int(weighed[k][0][weighed[k][1].argmax()]) if len(weighed[k][0]) else -1, ids[k]))
        self.ids, self.labels = np.array([ids[k] for k in order], np.int64), np.array([labels[k] for k in order], np.float64)
        self.place = {i: k for k, i in enumerate(self.ids.tolist())}
        self.base = float((self.labels.sum() + 0.5) / (len(ids) + 1)) if ids else 0.0
        blocks = -(-len(ids) // block)
        lists: list[list[tuple[int, float]]] = [[] for _ in idf]
        for at, k in enumerate(order):
            for t, w in zip(weighed[k][0].tolist(), weighed[k][1].tolist()):
                lists[t].append((at, w))
        self.postings = [(np.array([a for a, _ in one], np.int64), np.array([w for _, w in one])) for one in lists]
        self.limits = [np.searchsorted(at, np.arange(blocks + 1) * block).tolist() for at, _ in self.postings]
        self.greatest = np.zeros((len(idf), blocks))
        for t, (at, w) in enumerate(self.postings):
            np.maximum.at(self.greatest[t], at // block, w)

    def weights(self, terms: list[int], counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """A vector of length 1; terms of every document weigh nothing."""
        terms_ = np.array(terms, np.int64)
        raw = (1 + np.log(np.array(counts, np.float64))) * self.idf[terms_]
        kept = raw > 0
        norm = math.sqrt(float((raw[kept] ** 2).sum()))
        return terms_[kept], raw[kept] / norm if norm else raw[kept]

    def nearest(self, terms: list[int], counts: list[int], k: int = NEIGHBOURS, without: int | None = None) -> list[tuple[float, int]]:
        """The k examples with the greatest cosine above 0, as (cosine, place), the nearest first; of equal ones those with the smallest ids."""
        own, weight = self.weights(terms, counts)
        if not len(own) or not len(self.ids):
            return []
        bound = weight @ self.greatest[own]
        best: list[tuple[float, int, int]] = []
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or (len(best) == k and bound[b] < -best[-1][0] - 1e-9):
                break
            sums = np.zeros(self.block)
            for t, w in zip(own.tolist(), weight.tolist()):
                low, high = self.limits[t][b], self.limits[t][b + 1]
                if low < high:
                    at, value = self.postings[t]
                    sums[at[low:high] - b * self.block] += w * value[low:high]
            found = [(-round(float(sums[j]), 12), int(self.ids[b * self.block + j]), b * self.block + j) for j in sums.nonzero()[0].tolist()]
            best = sorted(best + [x for x in found if x[1] != without])[:k]
        return [(-c, at) for c, _, at in best]

    def vote(self, near: list[tuple[float, int]]) -> float | None:
        """The share of toxic ones among the neighbours, nearer ones counting more, and one vote for the share among all; null without neighbours."""
        if not near:
            return None
        weight = [1 / (0.05 + 1 - min(c, 1.0)) for c, _ in near]
        return (sum(w * self.labels[at] for w, (_, at) in zip(weight, near)) + self.base) / (sum(weight) + 1)


def calibrated(votes: list[float], labels: list[int], rounds: int = 30) -> tuple[float, float]:
    """Slope and intercept of the logistic fit of labels on the log odds of votes, with a weak pull to slope 1 and intercept 0."""
    x, y = np.log(np.array(votes) / (1 - np.array(votes))), np.array(labels, np.float64)
    theta = np.array([1.0, 0.0])
    design = np.stack([x, np.ones(len(x))], 1) if len(x) else np.zeros((0, 2))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-design @ theta))
        gradient = design.T @ (p - y) + (theta - [1.0, 0.0])
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta = theta - step
        if np.abs(step).max() < 1e-10:
            break
    return float(theta[0]), float(theta[1])


def labelled_examples(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES) -> DataFrame:
    """doc_id, text and toxic of at most ``most`` labelled documents, one text of each id."""
    learnt = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = learnt.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", F.coalesce("text", F.lit("")).alias("text"))
    return texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def score_toxicity(docs: DataFrame, labels: DataFrame, *, most: int = EXAMPLES, k: int = NEIGHBOURS, block: int = BLOCK) -> DataFrame:
    """doc_id, score (the probability of the label 1) and evidence (doc_id, cosine and toxic of the nearest examples) of every row.

    Every row of ``labels`` (doc_id, toxic) may be learnt from: leave out what is held out. Of several labels of a
    document a toxic one counts, of several texts of an id one is the example; labels without a document and nulls are
    not used. Null and empty texts have no terms. Repeated rows get equal scores; a null doc_id stays null. Without examples of both
    kinds every score is the share of toxic ones (0 without examples). An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    examples = written(labelled_examples(docs, labels, most))
    terms = telling_terms(examples)
    vectors = written(term_vectors(docs, terms))
    total = vectors.count()
    idf = np.zeros(len(terms))
    for term, n in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row for each term
        idf[term] = math.log(total / n)
    rows = term_vectors(examples, terms).join(examples.select("doc_id", "toxic"), "doc_id").orderBy("doc_id").toArrow().to_pylist()  # at most ``most`` rows of TERMS numbers
    index = Examples([r["doc_id"] for r in rows], [r["toxic"] for r in rows], [(r["terms"], r["counts"]) for r in rows], idf, block)
    held = spark.sparkContext.broadcast(index)
    # each example's votes of the others; a small table, but much work for each row, so it is dealt out
    tried = term_vectors(examples, terms).join(examples.select("doc_id", "toxic"), "doc_id").repartition(1 + len(rows) // 256).mapInArrow(_votes(held, k), "toxic int, vote double").toArrow().to_pylist()
    voted = [r for r in tried if r["vote"] is not None]
    fit = calibrated([r["vote"] for r in voted], [r["toxic"] for r in voted])
    silent = [r["toxic"] for r in tried if r["vote"] is None]
    without = (sum(silent) + index.base) / (len(silent) + 1)
    return vectors.mapInArrow(_scores(held, k, fit, without), "doc_id long, score double, evidence array<struct<doc_id:long,cosine:double,toxic:int>>")


def _votes(held, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in batches:
            votes = [index.vote(index.nearest(t, n, k, without=i)) for i, t, n in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "terms", "counts")))]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(votes, pa.float64())], names=["toxic", "vote"])

    return run


def _scores(held, k: int, fit: tuple[float, float], without: float):
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known = held.value, {}

        def judged(terms: tuple, counts: tuple) -> tuple[float, list[dict]]:
            near = index.nearest(terms, counts, k)
            vote = index.vote(near)
            score = without if vote is None else 1 / (1 + math.exp(-(fit[0] * math.log(vote / (1 - vote)) + fit[1])))
            return score, [{"doc_id": int(index.ids[at]), "cosine": c, "toxic": int(index.labels[at])} for c, at in near]

        for batch in batches:
            out = []
            for terms, counts in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist()):
                key = (tuple(terms), tuple(counts))
                if key not in known:
                    if len(known) >= 20_000:
                        known.clear()
                    known[key] = judged(*key)
                out.append(known[key])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s for s, _ in out], pa.float64()), pa.array([e for _, e in out], kind)], names=["doc_id", "score", "evidence"])

    return run


def held_out(doc_id: Column) -> Column:
    """Whether a row's label is for tests alone."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out(F.col("doc_id")))
    scored = score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op12_toxicity": op12_toxicity}
ORACLES: dict[str, str] = {}
