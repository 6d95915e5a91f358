"""From raw documents to packed training sequences, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and
read again as the next stage's documents; all but the last return the columns of
the documents, whatever these are called (``kept``, ``spans``, ``row`` and the like are
kept as they are), and the last only those of the pieces.

Defined results: documents with a null or empty text fail the first stage, and so do
texts of under 50 words; a null doc_id or source is kept like any other value; of
repeated rows one stays; texts of any length are handled whole; an empty table gives
no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import quality
from netloom.llm.mixing import mix_sources
from netloom.llm.packing import pack_power_of_two
from netloom.llm.secrets import redact_secrets
from netloom.llm.session import table, written
from netloom.llm.simhash import drop_near_duplicates


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass all quality rules."""
    return quality.keep_quality(docs)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every SimHash component."""
    return drop_near_duplicates(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; n_chars follows the text."""
    hidden = redact_secrets(docs)
    return hidden.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else hidden


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target mix takes it."""
    return mix_sources(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token sequences."""
    import public_tokenizers

    return pack_power_of_two(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", keep_quality),
    ("near-duplicates", keep_one_of_near_duplicates),
    ("secrets", hide_secrets),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL can't express near-duplicates and tokens; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what each returns is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, written(docs) if number else docs, sf_dir)
    return docs
