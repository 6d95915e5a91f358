"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each source gets a target of tokens. Document rates are the ones closest to 1,
in entropy over tokens, that meet the targets: rate = exp(sum of the multipliers
of the document's groups). The multipliers minimise the convex dual, by Newton
iterations on a table of group totals (the Hessian of one grouping is diagonal,
so a step is (target - mass) / mass for each of its groups; several groupings
take turns).

Rates become whole copies without drawing lots. Documents of one source and one
size form a class. Along the classes of a source from large to small, copies
follow the running sum of rate times documents, which leaves an error of about
one long document; then each source moves copies in the class that brings it
nearest to its target, until no move does. Within a class the documents with the
smallest hashes get the odd copies; rows that are equal in all share a hash, and as
many of them as are due get one. So reruns agree, and no table that is grouped
or ranked by a hot source is larger than its number of distinct sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from netloom.llm.buckets import join_unevenly, least_hot
from netloom.llm.session import checkpoint, table
from netloom.llm.text import WORD, word_count

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
#: High bits of the hash by which a large class is ranked in parts, and these in parts.
PART_BITS = (8, 16, 24)


def source_key(source: Column) -> Column:
    """A key that is never null, so that null is a source of its own."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def ranked(sources: DataFrame) -> DataFrame:
    """Adds rank from 0 by code point, null last, without sorting all in one task."""
    order = F.col("source").asc_nulls_last()
    parts = checkpoint(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    before = parts.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(W.orderBy("part")) - F.col("n"))
    within = parts.withColumn("within", F.row_number().over(W.partitionBy("part").orderBy(order)) - 1)
    return within.join(before.drop("n"), "part").withColumn("rank", F.col("within") + F.col("before")).drop("part", "within", "before")


def share_targets(sources: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds target to a table with weight and source_size: ``share`` of all sizes by weight, where no
    target exceeds ``most`` times its source's size and what is over goes to the rest by weight."""
    whole = (sources.agg(F.sum("source_size")).first()[0] or 0) * share
    limit = F.col("source_size") * most
    level, before = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("weight") * level > limit
        got = sources.agg(F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weight"))), F.sum(full.cast("long"))).first()
        if got[2] == before or not got[1]:
            break
        before, level = got[2], (whole - (got[0] or 0.0)) / got[1]
    return sources.withColumn("target", limit if level is None else F.least(F.col("weight") * level, limit))


def entropy_balance(cells: DataFrame, targets: dict[str, DataFrame], *, size: str = "size", tolerance: float = 1e-9, rounds: int = 60) -> DataFrame:
    """Adds log_rate to ``cells``, rows with a total ``size`` that belong to one group of each key in ``targets``.

    ``targets`` has, for each key column, a table of that key and target. Cells of
    size 0 keep a rate of 1 and groups with target 0 get rate 0. With several keys
    the targets must agree in their totals.
    """
    cells = checkpoint(cells.withColumn("log_rate", F.lit(0.0)))
    for _ in range(rounds):
        gap = 0.0
        for key, target in targets.items():
            mass = cells.groupBy(key).agg(F.sum(F.col(size) * F.exp("log_rate")).alias("mass"))
            steps = checkpoint(mass.join(target.select(key, "target"), key).filter("mass > 0").select(key, "target", ((F.col("target") - F.col("mass")) / F.col("mass")).alias("step")))
            cells = checkpoint(cells.join(steps, key, "left").withColumn("log_rate", F.col("log_rate") + F.coalesce(F.when(F.col("target") <= 0, F.lit(float("-inf"))).otherwise(F.least("step", F.lit(1.0))), F.lit(0.0))).drop("target", "step"))
            worst = steps.filter("target > 0").agg(F.max(F.abs("step"))).first()[0]
            gap = max(gap, worst or 0.0)
        if gap < tolerance:
            break
    else:
        if gap > 1e-6:
            raise ValueError(f"the targets are not met after {rounds} rounds: a step of {gap:.3g} is left")
    return cells


def class_copies(classes: DataFrame, sources: DataFrame, *, most: float = MOST) -> DataFrame:
    """Adds copies (of all n documents of a class together) to the classes key, size, n.

    A move gives or takes as many copies of one class as bring its source nearest to its target; moves end
    when none brings any source nearer. ``sources`` has key, target and log_rate.
    """
    along = W.partitionBy("key").orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, 0)
    limit = (F.col("n") * most).cast("long")
    paced = classes.join(sources.select("key", F.exp("log_rate").alias("rate")), "key").withColumn("upto", F.sum("n").over(along))
    first = F.round(F.col("rate") * F.col("upto")) - F.round(F.col("rate") * (F.col("upto") - F.col("n")))
    classes = checkpoint(paced.withColumn("copies", F.least(first.cast("long"), limit)).select("key", "size", "n", "copies"))
    targets = sources.select("key", "target")
    while True:
        missing = classes.groupBy("key").agg(F.sum(F.col("copies") * F.col("size")).alias("taken")).join(targets, "key").select("key", (F.col("target") - F.col("taken")).alias("missing"))
        room = F.when(F.col("missing") > 0, limit - F.col("copies")).otherwise(F.col("copies"))
        step = F.least(room, F.greatest(F.round(F.abs("missing") / F.col("size")).cast("long"), F.lit(1)))
        moves = classes.filter("size > 0").join(missing, "key").withColumn("step", step)
        moves = moves.withColumn("left", F.abs(F.abs("missing") - F.col("step") * F.col("size"))).filter((F.col("step") > 0) & (F.col("left") < F.abs("missing")))
        best = checkpoint(moves.groupBy("key").agg(F.min_by(F.struct("size", (F.signum("missing").cast("long") * F.col("step")).alias("move")), F.struct("left", "size")).alias("best")).select("key", "best.size", "best.move"))
        if best.isEmpty():
            return classes
        classes = checkpoint(classes.join(best, ["key", "size"], "left").withColumn("copies", F.col("copies") + F.coalesce("move", F.lit(0))).drop("move"))


def odd_copies(slim: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds each (copies every document gets), until (documents below this hash get one more), equal (rows with
    this hash) and due (how many of them get one more).

    Which hash that is, is found in the part of the class, by the high bits of the hash, that holds it, and
    in that part of the part: no more than 2 ** -24 of a class's hashes are ranked in one task.
    """
    split = classes.withColumns({"each": F.floor(F.col("copies") / F.col("n")), "odd": F.col("copies") % F.col("n")})
    turn = split.filter("odd > 0").select("key", "size", F.col("odd").alias("at"))
    inside, keys = slim.select("key", "size", "hash"), ["key", "size"]
    for bits in PART_BITS:
        inside = inside.join(turn.select(*keys), keys, "left_semi") if bits != PART_BITS[0] else inside
        inside = inside.withColumn("part", F.shiftrightunsigned("hash", 64 - bits))
        counts = inside.groupBy("key", "size", "part").agg(F.count("*").alias("m"))
        upto = counts.withColumn("upto", F.sum("m").over(W.partitionBy("key", "size").orderBy("part")))
        turn = upto.join(turn.select("key", "size", "at"), ["key", "size"]).filter((F.col("upto") >= F.col("at")) & (F.col("upto") - F.col("m") < F.col("at")))
        turn = checkpoint(turn.select("key", "size", "part", (F.col("at") - F.col("upto") + F.col("m")).alias("at")))
        keys = ["key", "size", "part"]
    unsigned = F.col("hash").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    equal = inside.groupBy(*keys, unsigned.alias("until")).agg(F.count("*").alias("equal"))  # rows of one hash meet as their number
    upto = equal.join(turn, keys).withColumn("upto", F.sum("equal").over(W.partitionBy("key", "size").orderBy("until")))
    due = F.col("at") - F.col("upto") + F.col("equal")
    until = upto.withColumn("due", due).filter((F.col("due") > 0) & (F.col("due") <= F.col("equal"))).select("key", "size", "until", "equal", "due")
    return split.join(until, ["key", "size"], "left").select("key", "size", "n", "each", "until", "equal", "due")


def plan_mix(docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents without their texts (doc_id, source, key, size, hash), the classes (key, size,
    n, each, until) and the sources (key, n_docs, source_size, target, log_rate)."""
    slim = checkpoint(sized(docs).select("doc_id", "source", "key", "size", "hash"))
    classes = checkpoint(slim.groupBy("key", "size").agg(F.first("source").alias("source"), F.count("*").alias("n")))
    sources = classes.groupBy("key").agg(F.first("source").alias("source"), F.sum("n").alias("n_docs"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    turn = F.get(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int"))
    weighed = checkpoint(ranked(sources).withColumn("weight", turn))
    targets = checkpoint(share_targets(weighed, share, most).select("key", "n_docs", "source_size", "target"))
    rates = entropy_balance(targets.select("key", "source_size"), {"key": targets}, size="source_size")
    sources = checkpoint(rates.select("key", "log_rate").join(targets, "key"))
    return slim, checkpoint(odd_copies(slim, class_copies(classes.drop("source"), sources, most=most))), sources


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with key, size and hash."""
    return docs.withColumns({"key": source_key(F.col("source")), "size": word_count(F.col("text")), "hash": F.xxhash64("doc_id", "text")})


def copies_of(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds copies to rows with key, size and hash."""
    unsigned = F.col("hash").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    total = classes.agg(F.sum("n")).first()[0] or 0
    names = [F.col(f"`{c}`") for c in rows.columns]
    joined = join_unevenly(rows, classes, ["key", "size"], "n", least_hot(total))
    alike = F.coalesce((unsigned == F.col("until")) & (F.col("due") < F.col("equal")), F.lit(False))
    more = F.coalesce(unsigned <= F.col("until"), F.lit(False)).cast("long")
    whole = joined.filter(~alike).select(*names, (F.col("each") + more).alias("copies"))
    if classes.filter("due < equal").isEmpty():
        return whole
    # equal rows differ only in where they are: they are kept as they lie, and counted part by part
    lying = checkpoint(joined.filter(alike).withColumn("part", F.spark_partition_id()))
    of_class = W.partitionBy("key", "size").orderBy("part")
    before = lying.groupBy("key", "size", "part").agg(F.count("*").alias("m")).withColumn("before", F.sum("m").over(of_class) - F.col("m")).drop("m")
    place = F.row_number().over(W.partitionBy("key", "size", "part").orderBy("until")) + F.col("before")
    placed = lying.join(before, ["key", "size", "part"]).withColumn("place", place)
    return whole.unionByName(placed.select(*names, (F.col("each") + (F.col("place") <= F.col("due")).cast("long")).alias("copies")))


def mix_sources(docs: DataFrame, **how) -> DataFrame:
    """``docs`` in the mix: each row as often as it has copies, in its own columns.

    Null sources are one source, the last; null and empty texts have size 0; of repeated
    rows, which share a hash, as many get an odd copy as are due; an empty table gives no
    rows; columns named key, size or hash would clash and are set aside by position.
    """
    names = docs.columns
    packed = docs.select("doc_id", "source", "text", F.struct(*names).alias("row"))
    _, classes, _ = plan_mix(packed, **how)
    chosen = copies_of(sized(packed), classes).filter("copies > 0")
    return chosen.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def _taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim, classes, sources = plan_mix(table(spark, sf_dir, "documents"))
    taken = copies_of(slim, classes).withColumn("taken", F.col("copies") * F.col("size"))
    total = sources.agg(F.sum("n_docs")).first()[0] or 0
    return join_unevenly(taken, sources, ["key"], "n_docs", least_hot(total))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _taken(spark, sf_dir).select("doc_id", "size", "source_size", "target", "taken")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op6's result SQL can tell: all but which documents are taken more often. ``near``: its source's
    taken words are within half its longest document (2 words at least) of the target; ``within``: taken whole
    times, not more than twice."""
    rows = _taken(spark, sf_dir)
    of_source = rows.groupBy("key").agg(F.sum("taken").alias("all"), F.max("size").alias("longest"))
    near = F.abs(F.col("all") - F.col("target")) <= F.greatest(F.lit(2.0), 0.5 * F.col("longest"))
    within = (F.col("taken") <= 2 * F.col("size")) & ((F.col("size") == 0) | (F.col("taken") % F.col("size") == 0))
    return rows.join(of_source, "key").select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), near.alias("near"), within.alias("within"))


QUERIES = {"op6_mixing": op6_mixing, "mixing_targets": mixing_targets}
ORACLES: dict[str, str] = {
    # a source that is full takes twice its size, and what is over is shared again, until none is
    "mixing_targets": f"""WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text,''), '{WORD}')) AS BIGINT) AS size FROM documents),
 s AS (SELECT source, sum(size) n, (ARRAY[{','.join(map(str, WEIGHTS))}])[CAST((row_number() OVER (ORDER BY source IS NULL, encode(source))-1) % {len(WEIGHTS)} AS INT)+1] w FROM d GROUP BY source),
 fill AS (SELECT 0 round, CAST(0.0 AS DOUBLE) level UNION ALL SELECT round+1, CAST(({SHARE}*(SELECT sum(n) FROM s) - (SELECT coalesce(sum({MOST}*n) FILTER (w*level>{MOST}*n), 0) FROM s)) / nullif((SELECT sum(w) FILTER (NOT w*level>{MOST}*n) FROM s), 0) AS DOUBLE) FROM fill WHERE round < (SELECT count(*)+1 FROM s) AND level IS NOT NULL),
 t AS (SELECT source, n, least(w*(SELECT max(level) FROM fill), {MOST}*n) target FROM s)
 SELECT doc_id, size, CAST(n AS BIGINT) source_size, round(target, 3) target, true near, true "within" FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source""",
}
