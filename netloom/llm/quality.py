"""Quality rules as a short-circuit cascade.

Each rule is a cheap test of one document. A bounded sample of the documents
first tells what every rule costs and how many documents it rejects; rules then
run in the order of rejections per second, and a document leaves the cascade at
its first rejection. A rule sees the features computed so far, so a feature is
computed at most once and only if some rule asks for it. The verdict is the
conjunction of all rules: the order changes cost, never results, but for
failed_rule, which names the first rejection met.

Defined results: a null text has no words and fails ``too_short``; ties and
repeated rows are judged alike; an empty table gives no rows; other columns
stay as they are.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.llm.session import table
from netloom.llm.text import BLANK_BYTES, BLANKS, WORD, encode

SYMBOLS = b"#*$%&|<>"
#: At most so many documents time the rules.
SAMPLE_DOCS = 1000


class Features:
    """Counts of one text, each computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.raw = encode(text)

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - (len(self.raw) - len(self.raw.translate(None, BLANK_BYTES)))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        words = self.words
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) == len(windows):
            return 0
        times, covered, end = Counter(windows), 0, 0
        for at, window in enumerate(windows):
            if times[window] > 1:
                covered += at + 3 - max(at, end)
                end = at + 3
        return covered

    @cached_property
    def n_capitals(self) -> int:
        return sum(map(str.isupper, self.text))

    @cached_property
    def top_word(self) -> int:
        return max(Counter(self.words).values(), default=0)


#: name -> whether the rule rejects. Ratios are compared in whole numbers.
RULES: dict[str, Callable[[Features], bool]] = {
    "too_short": lambda f: f.n_words < 50,
    "repeated_phrases": lambda f: 100 * f.n_repeat_words > 50 * f.n_words,
    "symbols": lambda f: 10 * f.n_symbols > f.n_words,
    "capitals": lambda f: 100 * f.n_capitals > 30 * f.word_chars,
    "repeated_lines": lambda f: 100 * f.n_dup_lines > 50 * len(f.lines),
    "word_length": lambda f: not 2 * f.n_words <= f.word_chars <= 20 * f.n_words,
    "one_word": lambda f: 100 * f.top_word > 40 * f.n_words,
}
BASE_RULES = ("too_short", "repeated_phrases")
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def estimate_rules(docs: DataFrame, rules: dict[str, Callable[[Features], bool]] = RULES, sample_docs: int = SAMPLE_DOCS) -> dict[str, tuple[float, float]]:
    """Seconds per document and share of documents rejected, for each rule, on a sample; see ``sampled``."""
    trials = try_rules(sampled(docs, sample_docs), rules)
    n = max(1, len(trials))
    return {name: (sum(t[name][0] for t in trials) / n if trials else 1.0, sum(t[name][1] for t in trials) / n) for name in rules}


def sampled(docs: DataFrame, most: int) -> list[str | None]:
    """At most ``most`` texts: one row in ten of as many partitions as it takes, or of a small table its first rows.
    Spark reads one partition first and more only if that has too few, so no whole scan is spent on it."""
    texts = docs.select("text")
    return [r[0] for r in texts.sample(0.1, seed=11).take(most) or texts.take(most)]


def try_rules(texts: list[str | None], rules: dict[str, Callable[[Features], bool]]) -> list[dict[str, tuple[float, bool]]]:
    """Seconds and verdict of every rule on every text. A rule runs on features that are new but for the
    text's words, which all rules share: they are computed, and timed, before."""
    out = []
    for text in texts:
        timed = {}
        for name, rejects in rules.items():
            features = Features(text)
            features.n_words  # noqa: B018  paid once in a cascade, whichever rule is first
            began = time.perf_counter()
            rejected = rejects(features)
            timed[name] = time.perf_counter() - began, rejected
        out.append(timed)
    return out


def cascade_order(estimates: dict[str, tuple[float, float]]) -> list[str]:
    """Rules by rejection per cost, most first; ties by name."""
    return sorted(estimates, key=lambda n: (-estimates[n][1] / max(estimates[n][0], 1e-9), n))


def quality_cascade(docs: DataFrame, rules: dict[str, Callable[[Features], bool]] = RULES, *, metrics: tuple[str, ...] = (), order: list[str] | None = None, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``docs`` with kept boolean, failed_rule string (the first in the cascade, null if kept) and
    the named metrics as long columns. Columns of these names in ``docs`` are replaced.

    Without ``order`` the rules are timed first.
    """
    docs = docs.drop("kept", "failed_rule", *metrics)
    order = order or cascade_order(estimate_rules(docs, rules, sample_docs))
    return _judged(docs, [docs.columns.index("text")], rules, order, metrics)


def _judged(docs: DataFrame, at: list[int], rules: dict[str, Callable[[Features], bool]], order: list[str], metrics: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with verdicts; ``at`` is where the text is: a column's position, in a struct the field's behind it."""
    schema = T.StructType([*docs.schema.fields, T.StructField("kept", T.BooleanType()), T.StructField("failed_rule", T.StringType()), *(T.StructField(m, T.LongType()) for m in metrics)])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            failed, counts = [], [[] for _ in metrics]
            texts = batch.column(at[0])
            if at[1:]:
                texts = pc.struct_field(texts, at[1:])
            for text in texts:  # one at a time: a batch may have many MB of them
                features = Features(text.as_py())
                failed.append(next((name for name in order if rules[name](features)), None))
                for column, name in zip(counts, metrics):
                    column.append(getattr(features, name))
            arrays = [*batch.columns, pa.array([x is None for x in failed], pa.bool_()), pa.array(failed, pa.string()), *(pa.array(c, pa.int64()) for c in counts)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.mapInArrow(judge, schema)


def keep_quality(docs: DataFrame, rules: dict[str, Callable[[Features], bool]] = RULES, *, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, in their own columns, whatever these are called.

    A row goes to the rules as one struct and its text in no other column: Spark and Python hold each
    batch of them whole, Spark twice."""
    order = cascade_order(estimate_rules(docs, rules, sample_docs))
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return _judged(packed, [0, docs.columns.index("text")], rules, order).filter("kept").select("row.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_cascade(table(spark, sf_dir, "documents").select("doc_id", "text"), metrics=METRICS)
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", *METRICS, base_failed.alias("base_failed"), (F.col("kept") & ~base_failed).alias("kept"))


QUERIES = {"op8_quality_rules": op8_quality_rules}
# What str.isupper calls a capital: the letters of category Lu and, below, the other capitals of Unicode.
_CAPITAL = r"[\p{Lu}\x{2160}-\x{216F}\x{24B6}-\x{24CF}\x{1F130}-\x{1F149}\x{1F150}-\x{1F169}\x{1F170}-\x{1F189}]"
ORACLES: dict[str, str] = {
    "op8_quality_rules": f"""WITH d AS (SELECT doc_id, coalesce(text,'') t, regexp_extract_all(coalesce(text,''), '{WORD}') w FROM documents),
 line AS (SELECT doc_id, unnest(string_split(t, chr(10))) s FROM d),
 lines AS (SELECT doc_id, count(*) n, count(*)-count(DISTINCT s) dup FROM line WHERE regexp_matches(s, '{WORD}') GROUP BY 1),
 word AS (SELECT doc_id, unnest(range(1, len(w)+1)) i, unnest(w) a FROM d),
 next AS (SELECT doc_id, i, a, lead(a, 1) OVER o b, lead(a, 2) OVER o c FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
 win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) n FROM next WHERE c IS NOT NULL),
 again AS (SELECT doc_id, count(DISTINCT i+j) n FROM win, range(3) t(j) WHERE n>1 GROUP BY 1),
 top AS (SELECT doc_id, max(n) n FROM (SELECT doc_id, count(*) n FROM word GROUP BY doc_id, a) GROUP BY 1),
 m AS (SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(length(regexp_replace(t, '{BLANKS}', '', 'g')) AS BIGINT) word_chars, CAST(length(t)-length(translate(t, '#*$%&|<>', '')) AS BIGINT) n_symbols, CAST(coalesce(l.dup,0) AS BIGINT) n_dup_lines, CAST(coalesce(a.n,0) AS BIGINT) n_repeat_words,
  coalesce(l.n,0) n_lines, length(t)-length(regexp_replace(t, '{_CAPITAL}', '', 'g')) capitals, coalesce(top.n,0) top FROM d LEFT JOIN lines l USING (doc_id) LEFT JOIN again a USING (doc_id) LEFT JOIN top USING (doc_id))
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words<50 OR 100*n_repeat_words>50*n_words base_failed,
  NOT (n_words<50 OR 100*n_repeat_words>50*n_words OR 10*n_symbols>n_words OR 100*capitals>30*word_chars OR 100*n_dup_lines>50*n_lines OR NOT (2*n_words<=word_chars AND word_chars<=20*n_words) OR 100*top>40*n_words) kept FROM m""",
}
