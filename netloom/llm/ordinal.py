"""Quality classifier: cumulative-link regression on graded ratings.

Grades 0 .. K-1 share one weight per hashed feature of the text; ordered
thresholds separate them: P(grade >= k) = sigmoid(weights . features -
threshold k). Weights and thresholds are fitted together by Adam on the penalised
likelihood, the gaps of the thresholds in logarithms so that they stay ordered; an
L1 penalty leaves weights to features that tell grades apart in many rows. A
document's expected grade is the sum of its tail probabilities.

Features are present or absent: the text's letter runs in lower case, the first
letters of these (so that inflected forms share evidence), its runs of marks and, in bands, its length, the share of distinct words, of symbols and
of capitals.

The fit is on a bounded sample of labelled rows (``sample_rows``, the ones with
the smallest hashes of their ids); scoring covers all rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.session import table
from netloom.llm.text import encode

FEATURES = 1 << 18
SAMPLE_ROWS = 8000
#: Features whose slot one Python worker keeps.
CACHED_FEATURES = 500_000

_PART = re.compile(r"[^\W\d_]+|[^\w\s]+")
_HEADS = (3, 5, 7)
_CAPITALS = bytes(range(65, 91))
_SYMBOLS = b"#*$%&|<>!"


def _band(part: int, whole: int) -> int:
    """The tenth into which a share falls."""
    return min(10, 10 * part // whole) if whole else 0


def features(text: str | None) -> set[str]:
    """What is present in a text; '' for a text without words."""
    raw = encode(text)
    words = raw.split()
    n = len(words)
    found = set(_PART.findall((text or "").lower()))
    for letters in _HEADS:
        found.update([w[:letters] + "~" for w in found if len(w) >= letters and w[-1] != "~"])
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    found.update((f"0length{n.bit_length()}", f"0distinct{_band(len(set(words)), n)}", f"0symbols{_band(symbols, n)}", f"0capitals{_band(capitals, len(raw))}"))
    return found


def slot(feature: str, slots: int) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace")) % slots


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. K-1, a row for each score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -60, 60)))


def fit_ordinal(indptr: np.ndarray, slots: np.ndarray, grades: np.ndarray, n_grades: int, n_slots: int, *, l1: float = 1.5e-3, l2: float = 1e-5, steps: int = 400, rate: float = 0.05, min_rows: int = 5) -> OrdinalModel:
    """``slots[indptr[i]:indptr[i + 1]]`` are the features of row i, whose grade is grades[i].

    A slot that fewer than ``min_rows`` rows have gets no weight: it would only name those rows.
    """
    rows = len(grades)
    row_of = np.repeat(np.arange(rows), np.diff(indptr))
    often = np.bincount(slots, minlength=n_slots)[slots] >= min_rows
    slots, row_of = slots[often], row_of[often]
    weights, free = np.zeros(n_slots), np.zeros(n_grades - 1)  # first threshold, then log gaps
    if rows:
        share = [(np.count_nonzero(grades >= k) + 1) / (rows + 2) for k in range(1, n_grades)]
        start = [np.log((1 - s) / s) for s in share]
        free[0] = start[0]
        free[1:] = np.log(np.maximum(np.diff(start), 0.1))
    parameters = np.concatenate([weights, free])
    first, second = np.zeros_like(parameters), np.zeros_like(parameters)
    chosen = np.ones(n_slots, bool)

    def thresholds(free: np.ndarray) -> np.ndarray:
        return free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])

    for step in range(1, steps * bool(rows) + 1):
        weights, free = parameters[:n_slots], parameters[n_slots:]
        cuts = thresholds(free)
        scores = np.bincount(row_of, weights[slots], rows)
        # P(grade >= k) with P(>= 0) = 1 and P(>= K) = 0 around
        tail = np.ones((rows, n_grades + 1))
        tail[:, -1] = 0
        tail[:, 1:-1] = 1 / (1 + np.exp(np.clip(cuts[None, :] - scores[:, None], -60, 60)))
        at = np.arange(rows)
        upper, lower = tail[at, grades], tail[at, grades + 1]
        chance = np.maximum(upper - lower, 1e-12)
        slope_upper, slope_lower = upper * (1 - upper), lower * (1 - lower)
        by_score = (slope_lower - slope_upper) / chance / rows
        by_cut = np.zeros(n_grades + 1)
        np.add.at(by_cut, grades, slope_upper / chance / rows)
        np.add.at(by_cut, grades + 1, -slope_lower / chance / rows)
        by_cut = by_cut[1:-1]
        by_free = np.concatenate([[by_cut.sum()], np.exp(free[1:]) * by_cut[::-1].cumsum()[::-1][1:]])
        gradient = np.concatenate([np.bincount(slots, by_score[row_of], n_slots) + l2 * weights, by_free])
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        pace = rate / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        parameters = parameters - pace * first / (1 - 0.9**step)
        if 2 * step <= steps:
            shrunk = np.abs(parameters[:n_slots]) - pace[:n_slots] * l1
            parameters[:n_slots] = np.sign(parameters[:n_slots]) * np.maximum(shrunk, 0)
            if 2 * step + 2 > steps:  # from here on the weights that are left are fitted without it
                chosen = parameters[:n_slots] != 0
        else:
            parameters[:n_slots] *= chosen
    return OrdinalModel(parameters[:n_slots].astype(np.float64), thresholds(parameters[n_slots:]))


def fit_on_sample(docs: DataFrame, ratings: DataFrame, n_grades: int, *, sample_rows: int = SAMPLE_ROWS, n_slots: int = FEATURES) -> OrdinalModel:
    """Fits on at most ``sample_rows`` rows of ``ratings`` (doc_id, grade) and their texts."""

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({slot(f, n_slots) for f in features(t)}) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1), batch.column(2)], names=["slots", "grade", "doc_id"])

    rated = ratings.filter(F.col("doc_id").isNotNull() & F.col("grade").between(0, n_grades - 1)).groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    chosen = F.broadcast(rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))  # bounded by sample_rows
    texts = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("grade").alias("grade"))
    rows = texts.select("text", "grade", "doc_id").mapInArrow(featurise, "slots array<int>, grade int, doc_id long").orderBy("doc_id").toArrow()
    lists = rows.column("slots").combine_chunks()
    indptr = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
    return fit_ordinal(indptr, lists.flatten().to_numpy().astype(np.int64), rows.column("grade").to_numpy().astype(np.int64), n_grades, n_slots)


def score_ordinal(docs: DataFrame, model: OrdinalModel, *, keep_from: int | None = None) -> DataFrame:
    """doc_id, expected_grade, p_at_least_1 .. and kept (P(grade >= keep_from) >= 1/2, by default the
    highest grade) for every row.

    Null and empty texts are scored by their bands alone; repeated rows and ties score
    alike; an empty table gives no rows; other columns are ignored.
    """
    n_slots, k = len(model.weights), len(model.thresholds)
    last = keep_from or k
    shared = docs.sparkSession.sparkContext.broadcast(model.weights.astype(np.float32).tobytes())  # n_slots floats
    cuts = model.thresholds.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.frombuffer(shared.value, np.float32).tolist()
        own = OrdinalModel(np.zeros(0), np.array(cuts))
        known: dict[str, int] = {}
        for batch in batches:
            scores = []
            for text in batch.column(1).to_pylist():
                found = features(text)
                new = found.difference(known)
                if len(known) + len(new) > CACHED_FEATURES:
                    known.clear()
                    new = found
                known.update((f, slot(f, n_slots)) for f in new)
                # a slot counts once, as in the fit, whichever of its features a text has
                scores.append(sum(map(weights.__getitem__, sorted(set(map(known.__getitem__, found))))))
            tails = own.tails(np.array(scores, np.float64))
            columns = [batch.column(0), pa.array(tails.sum(axis=1)), *(pa.array(tails[:, j]) for j in range(k)), pa.array(tails[:, last - 1] >= 0.5)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "expected_grade", *(f"p_at_least_{j + 1}" for j in range(k)), "kept"])

    tails = ", ".join(f"p_at_least_{j + 1} double" for j in range(k))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, expected_grade double, {tails}, kept boolean")


def quality_grade(quality: Column, toxic: Column) -> Column:
    """0 for low quality, 1 for toxic text of quality, 2 for the rest; null without both labels."""
    return F.when(quality == 0, F.lit(0)).when((quality == 1) & (toxic == 1), F.lit(1)).when((quality == 1) & (toxic == 0), F.lit(2))


def op9_quality_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ratings = table(spark, sf_dir, "labels").select("doc_id", quality_grade(F.col("quality"), F.col("toxic")).alias("grade"))
    return score_ordinal(docs, fit_on_sample(docs, ratings, 3))


QUERIES = {"op9_quality_grade": op9_quality_grade}
ORACLES: dict[str, str] = {}
