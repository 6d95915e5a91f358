"""Secret scans that link the parts of a credential, in SQL expressions only.

Strong findings stand alone: assignments to a secret's name, access identifiers
with a fixed head, and long runs of hex digits. Weak parts are reported only
when a complementary part lies within reach: an account identifier or an
endpoint near a secret, a bare random-looking token near an identifier or an
endpoint. The interval join of parts is made inside the row, where both sides
are the sorted spans of one text and the scope is ``reach`` code points around a
span: for each part the other side is searched by halving. No shuffle, no key
that could be hot.

Spans are found without positions from the regex engine: the pieces between the
matches (``split``) and the matches (``regexp_extract_all``) alternate, so the
running sum of their lengths gives starts and ends in code points. Patterns run
only over texts that match them at all.

Defined results: a null text is empty and has no spans; an empty table gives no
rows; repeated rows are scanned alike; other columns stay as they are, but
``find_secrets`` replaces a column named ``spans`` (``redact_secrets`` keeps it).
A text with very many spans costs little more than in proportion: sorted spans
are searched by halving, and places are running sums made in rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.session import table
from netloom.llm.text import let, running

#: Kinds in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "ident", "endpoint", "bare")
BASE_KINDS = KINDS[:3]
REACH = 200

_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ACCESS = r"AKIA[A-Z0-9]{16,}"
_HEX = r"[0-9a-f]{24,}"
_IDENT = r"""((?i:user_?name|user_?id|login|account_?id|client_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})"""
_ENDPOINT = r"""(?i:https?|wss?|amqps?|ldaps?|redis|mysql|postgres(?:ql)?|mongodb(?:\+srv)?)://[^\x20\x09-\x0D"'<>]{4,}"""
_BARE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+"


_SPAN = "array<struct<start:int,kind:int,end:int>>"


def pattern_spans(text: Column, pattern: str, kind: str, *, group: int = 0, at_least: int = 0) -> Column:
    """The leftmost matches that don't overlap; those whose group is shorter than at_least are dropped."""
    number = F.lit(KINDS.index(kind))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    measured = F.transform(parts, lambda x: F.struct(F.length(x["p"]).alias("before"), F.coalesce(F.length(x["m"]), F.lit(0)).alias("own"), x["m"].alias("m")))

    def spans(pieces: Column) -> Column:
        ends = running(F.transform(pieces, lambda x: x["before"] + x["own"]))
        placed = F.zip_with(pieces, ends, lambda x, end: F.struct((end - x["own"]).alias("start"), number.alias("kind"), end.alias("end"), x["m"].alias("m")))

        def kept(x: Column) -> Column:  # a match alone matches like in its text
            return x["m"].isNotNull() & (F.length(F.regexp_extract(x["m"], pattern, group)) >= at_least) if at_least else x["m"].isNotNull()

        return F.transform(F.filter(placed, kept), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))

    return F.when(text.rlike(pattern), let(measured, spans)).otherwise(F.array().cast(_SPAN))


def starting_before(spans: Column, place: Column) -> Column:
    """How many of the spans, which are sorted, start before a place: by halving."""
    n = F.size(spans)

    def halve(range_: Column, _: Column) -> Column:
        middle = F.floor((range_["low"] + range_["high"]) / 2).cast("int")
        right = (range_["low"] < range_["high"]) & (F.get(spans, middle)["start"] < place)
        left = (range_["low"] < range_["high"]) & ~right
        return F.struct(F.when(right, middle + 1).otherwise(range_["low"]).alias("low"), F.when(left, middle).otherwise(range_["high"]).alias("high"))

    rounds = F.sequence(F.lit(1), F.ceil(F.log2(n + F.lit(1))).cast("int") + 1)
    return F.aggregate(rounds, F.struct(F.lit(0).alias("low"), n.alias("high")), halve, lambda range_: range_["low"])


def meets(span: Column, others: Column, reach: int = 0) -> Column:
    """Whether a span is within reach of one of the others, which are sorted and don't overlap each other: of
    those that start soon enough the last also ends last."""
    last = F.get(others, starting_before(others, span["end"] + reach) - 1)
    return (F.size(others) > 0) & F.coalesce(last["end"] > span["start"] - reach, F.lit(False))


def near(spans: Column, kinds: list[Column], reach: int) -> Column:
    """The spans that have a span of one of the kinds within reach."""
    return F.filter(spans, lambda s: reduce(Column.__or__, (meets(s, others, reach) for others in kinds)))


def apart(spans: Column, kinds: list[Column]) -> Column:
    """The spans that overlap none of the kinds."""
    return F.filter(spans, lambda s: ~reduce(Column.__or__, (meets(s, others) for others in kinds)))


def credential_spans(text: Column, reach: int = REACH) -> Column:
    """All spans of a text, sorted by start, then kind."""
    text = F.coalesce(text, F.lit(""))
    empty = F.array().cast(_SPAN)
    assign = pattern_spans(text, _ASSIGN, "assign", group=2, at_least=6)
    access = pattern_spans(text, _ACCESS, "access")
    hexes = pattern_spans(text, _HEX, "hex")
    weak = F.struct(
        pattern_spans(text, _IDENT, "ident").alias("ident"),
        pattern_spans(text, _ENDPOINT, "endpoint").alias("endpoint"),
        # without an identifier or an endpoint in the text a bare token can't be linked
        F.when(text.rlike(f"{_IDENT}|{_ENDPOINT}|{_ACCESS}"), pattern_spans(text, _BARE, "bare")).otherwise(empty).alias("bare"),
    )

    def link(x: Column) -> Column:
        base = [x["assign"], x["access"], x["hex"]]

        def parts(p: Column) -> Column:
            secrets = [x["assign"], x["hex"], p["bare"]]
            return F.concat(
                *base,
                near(p["ident"], secrets, reach),
                near(p["endpoint"], [*secrets, x["access"]], reach),
                near(p["bare"], [x["access"], p["ident"], p["endpoint"]], reach),
            )

        free = F.struct(
            apart(x["weak"]["ident"], base).alias("ident"),
            apart(x["weak"]["endpoint"], base).alias("endpoint"),
            apart(x["weak"]["bare"], [*base, x["weak"]["ident"], x["weak"]["endpoint"]]).alias("bare"),
        )
        return F.when(F.size(x["weak"]["ident"]) + F.size(x["weak"]["endpoint"]) + F.size(x["weak"]["bare"]) > 0, let(free, parts)).otherwise(F.concat(*base))

    return F.array_sort(let(F.struct(assign.alias("assign"), access.alias("access"), hexes.alias("hex"), weak.alias("weak")), link))


def find_secrets(docs: DataFrame, *, reach: int = REACH) -> DataFrame:
    """``docs`` with spans: array of struct(start, kind (its place in KINDS), end)."""
    return docs.withColumn("spans", credential_spans(F.col("text"), reach))


def listed(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def redact_secrets(docs: DataFrame, *, reach: int = REACH, mark: str = "[SECRET]") -> DataFrame:
    """``docs``, in its own columns, whose text has a mark in place of every span; overlapping spans get one mark."""
    found = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).withColumn("spans", credential_spans(F.col("text"), reach))
    # what is kept before each span that begins beyond all before it, and at the end
    bounds = F.concat("spans", F.array(F.struct(F.length("text").alias("start"), F.lit(-1).alias("kind"), F.length("text").alias("end"))))
    reached = running(F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["end"])), F.greatest)
    gaps = F.filter(F.zip_with(reached, bounds, lambda at, s: F.struct(at.alias("from"), s["start"].alias("to"))), lambda gap: gap["to"] >= gap["from"])
    clean = F.array_join(F.transform(gaps, lambda gap: F.substring(F.col("text"), gap["from"] + 1, gap["to"] - gap["from"])), mark)
    names = docs.columns
    hidden = F.when(F.size("spans") > 0, clean).otherwise(F.col("text"))
    return found.select(*(hidden.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names))


def count_of(spans: Column, kind: str) -> Column:
    """How many of the spans are of a kind."""
    number = KINDS.index(kind)
    return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("long")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] < len(BASE_KINDS))
    counts = (count_of(F.col("spans"), name).alias(f"n_{name}") for name in BASE_KINDS)
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _either_case(words: str) -> str:
    """A pattern for the words in either case of A-Z alone."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() and c.isascii() else c for c in words)


def _sql_spans(kind: str, pattern: str, *, group: int = 0, kept: str = "true") -> str:
    """SQL for the spans of a pattern in the texts t of d: rid, k, s, e."""
    pattern = pattern.replace("'", "''")
    return f"""SELECT rid, {KINDS.index(kind)} k, s, s+length(m) e FROM (SELECT rid, m, g, CAST(sum(length(p)+before) OVER (PARTITION BY rid ORDER BY i) AS BIGINT) s FROM
 (SELECT rid, i, ms[i] m, gs[i] g, ps[i] p, CASE WHEN i>1 THEN length(ms[i-1]) ELSE 0 END before FROM (SELECT rid, string_split_regex(t, '{pattern}') ps, regexp_extract_all(t, '{pattern}', 0) ms, regexp_extract_all(t, '{pattern}', {group}) gs FROM d), unnest(range(1, len(ms)+1)) u(i))) WHERE {kept}"""


_SQL_ASSIGN = "(" + _either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_SQL_IDENT = "(" + _either_case("user_?name|user_?id|login|account_?id|client_?id|access_?key_?id") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})"""
_SQL_ENDPOINT = "(?:" + _either_case(r"https?|wss?|amqps?|ldaps?|redis|mysql|postgres(?:ql)?|mongodb(?:\+srv)?") + r""")://[^\x20\x09-\x0D"'<>]{4,}"""
_NAMES = "[" + ",".join(f"'{k}'" for k in KINDS) + "]"
QUERIES = {"op5_secret_scan": op5_secret_scan}
ORACLES: dict[str, str] = {
    "op5_secret_scan": f"""WITH d AS (SELECT row_number() OVER () rid, doc_id, coalesce(text,'') t FROM documents),
 assign AS ({_sql_spans("assign", _SQL_ASSIGN, group=2, kept="length(g)>=6")}), access AS ({_sql_spans("access", _ACCESS)}), hex AS ({_sql_spans("hex", _HEX)}),
 ident0 AS ({_sql_spans("ident", _SQL_IDENT)}), endpoint0 AS ({_sql_spans("endpoint", _SQL_ENDPOINT)}),
 bare0 AS ({_sql_spans("bare", "[A-Za-z0-9+/_-]{20,}", kept="regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')")}),
 base AS (SELECT * FROM assign UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hex),
 ident AS (SELECT * FROM ident0 x WHERE NOT EXISTS (SELECT 1 FROM base o WHERE o.rid=x.rid AND x.s<o.e AND o.s<x.e)),
 endpoint AS (SELECT * FROM endpoint0 x WHERE NOT EXISTS (SELECT 1 FROM base o WHERE o.rid=x.rid AND x.s<o.e AND o.s<x.e)),
 bare AS (SELECT * FROM bare0 x WHERE NOT EXISTS (SELECT 1 FROM (SELECT * FROM base UNION ALL SELECT * FROM ident0 UNION ALL SELECT * FROM endpoint0) o WHERE o.rid=x.rid AND x.s<o.e AND o.s<x.e)),
 part AS (SELECT *, k<>1 secret FROM base UNION ALL SELECT *, false FROM ident UNION ALL SELECT *, false FROM endpoint UNION ALL SELECT *, true FROM bare),
 span AS (SELECT rid, k, s, e FROM part x WHERE k<3 OR EXISTS (SELECT 1 FROM part o WHERE o.rid=x.rid AND x.s<o.e+{REACH} AND o.s<x.e+{REACH} AND CASE x.k WHEN 3 THEN o.secret WHEN 4 THEN o.secret OR o.k=1 ELSE o.k IN (1,3,4) END)),
 told AS (SELECT rid, count(*) FILTER (k=0) n_assign, count(*) FILTER (k=1) n_access, count(*) FILTER (k=2) n_hex, string_agg(concat_ws(':', {_NAMES}[k+1], s, e), ',' ORDER BY s, k) spans, string_agg(concat_ws(':', {_NAMES}[k+1], s, e), ',' ORDER BY s, k) FILTER (k<3) base FROM span GROUP BY rid)
 SELECT doc_id, coalesce(n_assign,0) n_assign, coalesce(n_access,0) n_access, coalesce(n_hex,0) n_hex, sha256(coalesce(base,'')) base_sha256, coalesce(spans,'') spans FROM d LEFT JOIN told USING (rid)""",
}
