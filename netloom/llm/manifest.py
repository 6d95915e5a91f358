"""A Merkle manifest of a dataset: a tree of digests for each part, a tree of these, and every row's proof.

``leaf_digest`` hashes a row's columns, each with its length, so no two rows run into
one another. The leaves of a part, in order, are the lowest level of its tree; each
level hashes runs of ``ARITY`` nodes into one, and the last run may be shorter.

Trees are built in blocks of ``ARITY ** LEVELS`` leaves. The nodes of a block are one
ordered array; ``block_levels`` collapses it level by level with ``aggregate`` over
``transform`` over ``sequence`` and ``slice``. The roots of the blocks are the leaves of
the next round, so a round makes the table 1024 times smaller, and no array is longer
than a block however many rows a part has. A block that is one of several collapses
all its levels, even with one leaf, as the whole tree's levels would; a part's only
block ends at its root. Proofs go down again: what a node lacks within its block, then
what its block's root lacks above. Both directions join or group by (part, block), which
never holds more than a block.

Places come from ranges: rows are sorted by part and order in ranges, and the ranges'
sizes tell where each begins, so a part that holds most rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.llm.buckets import join_unevenly, least_hot
from netloom.llm.session import checkpoint, table, written

ARITY = 2
#: Levels that one block collapses: 1024 leaves.
LEVELS = 10
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: A row is altered in the tamper test where this divides the CRC-32 of its id.
TAMPERED = 7


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts one after another, in lowercase hex digits."""
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """A value with its length in bytes, "-" for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: list[Column]) -> Column:
    return digest(*map(framed, columns))


def placed_leaves(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Adds total (the leaves of the part) and at (the leaf's place among them, from 0) to rows with part.

    Equal rows may take each other's places.
    """
    kept = written(leaves)  # ranges are found by sampling, which would else make the leaves once more
    keys = [F.col("part"), *map(F.col, order), F.col("_lying")]  # where equal rows lie keeps them from being one range
    ranges = kept.withColumn("_lying", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*keys).sortWithinPartitions(*keys)
    sorted_ = written(ranges.withColumn("_id", F.monotonically_increasing_id()).drop("_lying"))
    within, range_ = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)), F.shiftright("_id", 33)
    of_range = sorted_.groupBy(range_.alias("_range"), "part").agg(F.count("*").alias("n"), F.min(within).alias("first"))
    # ranges of one part follow each other: as many rows as there are ranges and parts
    of_range = checkpoint(of_range.withColumn("before", F.sum("n").over(W.partitionBy("part").orderBy("_range")) - F.col("n")).withColumn("start", F.col("before") - F.col("first")))
    totals = of_range.groupBy("part").agg(F.sum("n").alias("total"))
    starts = of_range.join(totals, "part").select("_range", "part", "n", "start", "total")
    limit = least_hot(totals.agg(F.sum("total")).first()[0] or 0)
    here = join_unevenly(sorted_.withColumn("_range", range_), starts, ["_range", "part"], "n", limit)
    return here.withColumn("at", within + F.col("start")).drop("_id", "_range", "n", "start")


def block_levels(nodes: Column, levels: Column, arity: int) -> Column:
    """All levels of a block above and with the given one: an array of arrays of nodes."""

    def run(level: Column, k: Column) -> Column:
        return F.sha2(F.array_join(F.slice(level, k * arity + 1, F.lit(arity)), ""), 256)

    def rise(made: Column, _: Column) -> Column:
        last = F.element_at(made, -1)
        return F.concat(made, F.array(F.transform(F.sequence(F.lit(0), F.ceil(F.size(last) / arity).cast("int") - 1), lambda k: run(last, k))))

    counted = F.slice(F.sequence(F.lit(1), F.lit(64)), F.lit(1), levels)
    return F.aggregate(counted, F.array(nodes), rise)


def levels_of(total: Column, levels: int, arity: int) -> Column:
    """The levels from so many nodes to their root, but no more than a block's."""
    smaller = F.filter(F.array(*(F.lit(arity**k) for k in range(levels))), lambda size: size < total)
    return F.size(smaller)


def siblings(made: Column, at: Column, arity: int) -> Column:
    """What the node at a place of the lowest level lacks on the way up: for each level the nodes of its run
    before and after it (left and right)."""

    def of_level(level: Column, k: Column) -> Column:
        own = F.floor(at / F.pow(F.lit(float(arity)), k)).cast("int")
        first = own - own % arity
        left = F.array_join(F.slice(level, first + 1, own - first), "")
        right = F.array_join(F.slice(level, own + 2, first + arity - own - 1), "")
        return F.struct(left.alias("left"), right.alias("right"))

    return F.transform(F.slice(made, F.lit(1), F.size(made) - 1), of_level)


def blocked(nodes: DataFrame, levels: int, arity: int) -> DataFrame:
    """part, block, total (blocks of the part) and items (at, node and what else the rows have, in order) of
    every block of the nodes (part, total, at, node)."""
    size = arity**levels
    others = [c for c in nodes.columns if c not in ("part", "total", "at", "node")]
    item = F.struct((F.col("at") % size).cast("int").alias("at"), "node", *others)
    blocks = nodes.groupBy("part", "total", F.floor(F.col("at") / size).alias("block")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return blocks.withColumn("total", F.ceil(F.col("total") / size))


def with_levels(blocks: DataFrame, levels: int, arity: int) -> DataFrame:
    """Adds made, the levels of each block: all that a block has, or those up to the root of a part's only block."""
    rising = F.when(F.col("total") > 1, F.lit(levels)).otherwise(levels_of(F.size("items"), levels, arity))
    return blocks.withColumn("made", block_levels(F.transform("items", lambda x: x["node"]), rising, arity))


def roots_of(blocks: DataFrame) -> DataFrame:
    """The roots of blocks as the nodes of the next round."""
    return blocks.select("part", "total", F.col("block").alias("at"), F.get(F.element_at("made", -1), F.lit(0)).alias("node"))


_PROOF = "array<struct<left:string,right:string>>"


def tree_proofs(leaves: DataFrame, *, levels: int = LEVELS, arity: int = ARITY, above: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The leaves (part, total, at, node and others) with subroot, root and proof: what each lacks, level by level.

    ``above`` takes the parts' roots (part, node) and adds root and proof to them; without it a part's root is the root.
    """
    rounds, nodes = [], leaves
    while True:
        blocks = with_levels(written(blocked(nodes, levels, arity)), levels, arity)  # levels are made again rather than kept
        rounds.append(blocks)
        nodes = checkpoint(roots_of(blocks))
        if nodes.filter("total > 1").isEmpty():
            break
    tops = nodes.select("part", "node")
    tops = above(tops) if above else tops.withColumns({"root": F.col("node"), "proof": F.array().cast(_PROOF)})
    known = nodes.select("part", "at").join(tops.withColumnRenamed("node", "subroot"), "part")
    for blocks in reversed(rounds):
        inside = F.transform("items", lambda x: F.struct(x.alias("x"), siblings(F.col("made"), x["at"], arity).alias("lacks")))
        here = blocks.join(known.withColumnRenamed("at", "block"), ["part", "block"]).select("part", "block", "subroot", "root", "proof", F.explode(inside).alias("y"))
        place = F.col("block") * arity**levels + F.col("y.x.at")
        known = here.select("part", place.alias("at"), "subroot", "root", F.concat("y.lacks", "proof").alias("proof"), F.col("y.x").alias("x"))
        if blocks is not rounds[0]:
            known = known.drop("x")
    others = [c for c in leaves.columns if c not in ("part", "total", "at")]
    return known.select("part", "at", "subroot", "root", "proof", *(F.col(f"x.`{c}`") for c in others))


def folded(node: Column, proof: Column) -> Column:
    """The root that a node leads to with a proof."""
    return F.aggregate(proof, node, lambda so_far, step: digest(step["left"], so_far, step["right"]))


def proof_digest(proof: Column) -> Column:
    """The digest of all nodes of a proof, from the lowest level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def part_key(value: Column) -> Column:
    """A key that is never null and sorts null first, then by bytes."""
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), value))


def dataset_manifest(docs: DataFrame, *, levels: int = LEVELS, arity: int = ARITY) -> DataFrame:
    """doc_id, lang, leaf, altered, subroot, root and proof of every row.

    Parts are the languages, null first, then by their bytes; leaves ascend by doc_id (null first), rows of
    one id by their leaf. ``altered`` is the leaf with 1 added to n_chars where the tamper test picks the row, else
    null (n_chars null: the leaf itself). Repeated rows are leaves of their own, next to each other. A null or empty text is
    hashed as such, a long one whole. An empty table gives no rows. Columns beyond the five are ignored.
    """
    fields = [F.col(c) for c in COLUMNS]
    picked = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % TAMPERED == 0
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in COLUMNS]
    made = docs.select("doc_id", "lang", part_key(F.col("lang")).alias("part"), leaf_digest(fields).alias("node"), F.when(F.col("doc_id").isNotNull() & picked, leaf_digest(changed)).alias("altered"))

    def parts_tree(tops: DataFrame) -> DataFrame:
        # one tree over the parts: each part's root is a leaf of it
        numbered = placed_leaves(tops.select(F.lit("").alias("part"), F.col("part").alias("name"), "node"), ["name"])
        found = tree_proofs(numbered, levels=levels, arity=arity)
        return found.select(F.col("name").alias("part"), "node", "root", "proof")

    proofs = tree_proofs(placed_leaves(made, ["doc_id", "node"]), levels=levels, arity=arity, above=parts_tree)
    return proofs.select("doc_id", "lang", "at", F.col("node").alias("leaf"), "altered", "subroot", "root", "proof")


def verified(manifest: DataFrame) -> DataFrame:
    """A manifest with folded_root, made from each altered leaf or else the leaf and its proof, and verified."""
    found = manifest.withColumn("folded_root", folded(F.coalesce("altered", "leaf"), F.col("proof")))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = verified(dataset_manifest(table(spark, sf_dir, "documents").select(*COLUMNS)))
    return checked.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


QUERIES = {"op11_manifest": op11_manifest}
_CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(x)+1), lambda i: CAST(ascii(x[i]) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda y, j: xor(y >> 1, CASE WHEN y & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END))), CAST(4294967295 AS BIGINT))"
_LEAF = "sha256(concat({}))"
_FRAMED = "CASE WHEN {0} IS NULL THEN '-' ELSE concat(octet_length(encode(CAST({0} AS VARCHAR))), ':', {0}) END"


def _sql_leaf(changed: str) -> str:
    return _LEAF.format(", ".join(_FRAMED.format(f"({changed})" if c == "n_chars" else c) for c in COLUMNS))


_RISE = "list_transform(range(CAST(ceil(len(nodes)/2) AS BIGINT)), lambda i: sha256(array_to_string(nodes[2*i+1:2*i+2], '')))"
# a sibling on the left is marked L, on the right R, none N; the node comes first
_FOLD = "list_reduce(list_prepend({}, path), lambda x, s: CASE s[1] WHEN 'L' THEN sha256(concat(s[2:], x)) WHEN 'R' THEN sha256(concat(x, s[2:])) ELSE sha256(x) END)"
_SIDE = "CASE WHEN (pos >> lvl) & 1 = 1 THEN concat('L', nodes[pos >> lvl]) WHEN (pos >> lvl)+2 <= len(nodes) THEN concat('R', nodes[(pos >> lvl)+2]) ELSE 'N' END"
ORACLES: dict[str, str] = {
    "op11_manifest": f"""WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE concat('=', lang) END part, {_sql_leaf("n_chars")} leaf, CASE WHEN x IS NOT NULL AND {_CRC} % {TAMPERED} = 0 THEN {_sql_leaf("n_chars+1")} END altered FROM (SELECT *, CAST(doc_id AS VARCHAR) x FROM documents)),
 placed AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf)-1 pos FROM d),
 tree AS (SELECT part, 0 lvl, list(leaf ORDER BY pos) nodes FROM placed GROUP BY part UNION ALL SELECT part, lvl+1, {_RISE} FROM tree WHERE len(nodes)>1),
 sub AS (SELECT part, nodes[1] subroot FROM tree WHERE len(nodes)=1),
 part AS (SELECT part, subroot, row_number() OVER (ORDER BY encode(part))-1 pos FROM sub),
 top AS (SELECT 0 lvl, list(subroot ORDER BY pos) nodes FROM part UNION ALL SELECT lvl+1, {_RISE} FROM top WHERE len(nodes)>1),
 upper AS (SELECT part, coalesce(list(s ORDER BY lvl) FILTER (s IS NOT NULL), []) ups FROM (SELECT part, lvl, {_SIDE} s FROM part JOIN top ON len(nodes)>1 UNION ALL SELECT part, -1, NULL FROM part) GROUP BY part),
 lower AS (SELECT p.part, p.pos, list(s ORDER BY lvl) FILTER (s IS NOT NULL) lows FROM (SELECT placed.part, pos, lvl, {_SIDE} s FROM placed JOIN tree ON placed.part=tree.part AND len(nodes)>1 UNION ALL SELECT part, pos, -1, NULL FROM placed) p GROUP BY ALL),
 proof AS (SELECT doc_id, leaf, altered, subroot, list_concat(coalesce(lows, []), ups) path FROM placed JOIN lower USING (part, pos) JOIN upper USING (part) JOIN sub USING (part)),
 told AS (SELECT doc_id, leaf, subroot, (SELECT nodes[1] FROM top WHERE len(nodes)=1) root, sha256(array_to_string(list_transform(path, lambda s: s[2:]), '')) proof_sha256, {_FOLD.format("coalesce(altered, leaf)")} folded_root FROM proof)
 SELECT *, folded_root=root verified FROM told""",
}
