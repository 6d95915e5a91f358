"""Filter interaction audit: what each filter removes, in every order of all filters.

A document that passes a set of filters passes them in any order, so every count of an
order's step is a difference of survivors of two sets. The failures of the documents
become cells (part, failures, labels: a bounded number for each part) in one aggregation,
and SQL ``CUBE`` over the failure flags and the part gives, in the grouping set that
keeps just the selected flags, the row in which all of them are false: the survivors
of that set. A step joins the survivors of the filters before it with those of these
and its own.

The failures are column expressions on whole texts, read once. Copies need one slim row
for each document: rows of one text meet as their number and smallest id, and the facts
of a text that very many rows have go to the rows, not the rows to one task.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.buckets import least_hot
from netloom.llm.session import checkpoint, table, written
from netloom.llm.text import WORD, let, word_array

#: The filters in the order of their bits.
FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part and A to E (true: fails) of every row.

    The part is the language, "" for null; a null text is empty. E fails rows whose text a row with a smaller
    doc_id has; a row without a doc_id neither fails E nor makes others fail it.
    """
    text = F.coalesce("text", F.lit(""))
    words = let(word_array(text), lambda w: F.struct(F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("distinct")))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), words.alias("w"), (100 * capitals > 3 * F.length(text)).alias("C"), text.rlike(r"[#$%&*|]").alias("D"))
    rows = written(read.select("doc_id", "part", "digest", (F.col("w.all") < 200).alias("A"), (100 * F.col("w.distinct") < 50 * F.col("w.all")).alias("B"), "C", "D"))
    limit = least_hot(rows.count())
    shared = written(rows.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1"))
    hot = F.broadcast(shared.filter(F.col("n") > limit).select("digest", "first"))  # texts of more than one row in 4096
    rest = rows.join(hot.select("digest"), "digest", "left_anti").join(shared.filter(F.col("n") <= limit).select("digest", "first"), "digest", "left")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return rows.join(hot, "digest").unionByName(rest).select("doc_id", "part", "A", "B", "C", "D", copy.alias("E"))


def cells(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E, n, good and toxic: how many rows fail just these filters, and how many of them are labelled so.

    Repeated labels count if any of them says so; nulls say nothing.
    """
    said = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    # repeated rows meet as their number before they are joined with their labels
    counted = failed.groupBy("doc_id", "part", *FILTERS).agg(F.count("*").alias("n"))
    labelled = counted.join(said, "doc_id", "left")
    return labelled.groupBy("part", *FILTERS).agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")))


def survivors(made: DataFrame) -> DataFrame:
    """part, mask (bits of the filters), n, good and toxic: rows that pass all filters of the mask, zeros included."""
    grouped = made.cube(*FILTERS, "part").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")), F.grouping("part").alias("every_part"), *(F.grouping(f).alias(f"any_{f}") for f in FILTERS))
    passing = grouped.filter("every_part = 0")
    for f in FILTERS:
        passing = passing.filter((F.col(f"any_{f}") == 1) | ~F.col(f))
    mask = sum(((1 - F.col(f"any_{f}").cast("int")) * (1 << k) for k, f in enumerate(FILTERS)), F.lit(0))
    found = passing.select("part", mask.alias("mask"), "n", "good", "toxic")
    whole = made.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(ALL))).alias("mask"))
    return whole.join(found, ["part", "mask"], "left").na.fill(0, ["n", "good", "toxic"])


def lost_between(passing: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` of masks (low, high) for every part, with kept (rows that pass high) and removed, good_lost and
    toxic_lost (those that pass low and don't pass high)."""
    low = passing.select("part", F.col("mask").alias("low"), *(F.col(c).alias(f"low_{c}") for c in ("n", "good", "toxic")))
    high = passing.withColumnRenamed("mask", "high")
    met = pairs.join(low, "low").join(high, ["part", "high"])
    lost = {"removed": "n", "good_lost": "good", "toxic_lost": "toxic"}
    return met.select("part", *pairs.columns, F.col("n").alias("kept"), *((F.col(f"low_{c}") - F.col(c)).alias(name) for name, c in lost.items()))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley.

    A row for each part, each of the 120 orders and each step. Repeated rows count each, and are copies of
    one another only if their ids differ. Texts of any length are read whole; an empty table gives no rows; other columns are ignored.
    """
    spark, bit = docs.sparkSession, {f: 1 << k for k, f in enumerate(FILTERS)}
    steps = []
    for order in map("".join, permutations(FILTERS)):
        masks = [sum(bit[f] for f in order[:k]) for k in range(len(order) + 1)]
        steps += [(order, k + 1, order[k], masks[k], masks[k + 1]) for k in range(len(order))]
    passing = checkpoint(survivors(checkpoint(cells(failures(docs), labels))))
    by_step = lost_between(passing, spark.createDataFrame(steps, "filter_order string, step int, filter string, low int, high int")).drop("low", "high")
    alone = lost_between(passing, spark.createDataFrame([(f, 0, bit[f]) for f in FILTERS], "filter string, low int, high int"))
    last = lost_between(passing, spark.createDataFrame([(f, ALL - bit[f], ALL) for f in FILTERS], "filter string, low int, high int"))
    of_filter = by_step.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    for found, name in ((alone, "fails"), (last, "unique_fails")):
        of_filter = of_filter.join(found.select("part", "filter", F.col("removed").alias(name)), ["part", "filter"])
    whole = by_step.join(of_filter, ["part", "filter"]).withColumn("redundant", F.col("fails") - F.col("removed"))
    return whole.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


QUERIES = {"op13_filter_audit": op13_filter_audit}
_LETTERS = "(SELECT unnest(['A','B','C','D','E']) {0}) {0}"
ORACLES: dict[str, str] = {
    # each order is walked: a row is kept while none of the filters so far is among those it fails
    "op13_filter_audit": f"""WITH d AS (SELECT doc_id, coalesce(lang,'') part, coalesce(text,'') t, regexp_extract_all(coalesce(text,''), '{WORD}') w, min(doc_id) OVER (PARTITION BY coalesce(text,'')) first FROM documents),
 f AS (SELECT doc_id, part, concat(CASE WHEN len(w)<200 THEN 'A' END, CASE WHEN 100*len(list_distinct(w))<50*len(w) THEN 'B' END, CASE WHEN 100*length(regexp_replace(t,'[^A-Z]','','g'))>3*length(t) THEN 'C' END, CASE WHEN regexp_matches(t,'[#$%&*|]') THEN 'D' END, CASE WHEN doc_id>first THEN 'E' END) fails FROM d),
 l AS (SELECT doc_id, max(CAST(quality=1 AS INT)) good, max(CAST(toxic=1 AS INT)) toxic FROM labels GROUP BY 1),
 c AS (SELECT part, fails, count(*) n, coalesce(sum(good),0) good, coalesce(sum(toxic),0) toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
 o AS (SELECT concat(a,b,c,d,e) filter_order FROM {', '.join(_LETTERS.format(x) for x in "abcde")} WHERE len(list_distinct([a,b,c,d,e]))=5),
 s AS (SELECT *, filter_order[step] x, regexp_matches(fails, concat('[-', filter_order[1:step-1], ']')) gone, contains(fails, filter_order[step]) hit FROM o, (SELECT CAST(unnest(range(1,6)) AS INT) step), c),
 r AS (SELECT part, filter_order, step, x, sum(n) FILTER (NOT gone AND NOT hit) kept, sum(n) FILTER (NOT gone AND hit) removed, sum(n) FILTER (gone AND hit) redundant, sum(n) FILTER (fails=x) unique_fails, sum(good) FILTER (NOT gone AND hit) good_lost, sum(toxic) FILTER (NOT gone AND hit) toxic_lost FROM s GROUP BY 1, 2, 3, 4)
 SELECT part, filter_order, step, {', '.join(f"CAST(coalesce({n},0) AS BIGINT) {n}" for n in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))}, CAST(coalesce(sum(removed) OVER (PARTITION BY part, x),0) AS BIGINT) shapley FROM r""",
}
