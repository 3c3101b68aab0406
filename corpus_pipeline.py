"""Training-data pipeline over ``documents``: five stages, each of one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's ``docs``.  All but the last return the
columns of ``documents``; the last adds the ids of the text and whether they
decode to it.  Where a stage changes texts, ``n_chars`` (if there is one) follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bonusledger.llm import decontaminate, minmax, personal, pieces, quality
from bonusledger.llm.common import land, table


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and toxic ones; the labels teach what is toxic."""
    return quality.keep_good(docs, labels=table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (5-word shingles, 0.8)."""
    return minmax.keep_one(docs, 5, 0.8)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut; documents that are mostly benchmark go."""
    return _counted(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets."""
    return _counted(personal.redact(docs))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, their number, and whether decoding gives the text back
    (U+2581 as a space, null as empty)."""
    rows = pieces.decode(pieces.encode(docs, out="ids"), out="__back")
    same = F.col("__back") == F.coalesce(F.translate("text", pieces.SPACE, " "), F.lit(""))
    return rows.withColumn("n_tokens", F.size("ids").cast("long")).withColumn("decoded", same).drop("__back")


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", cut_benchmark),
    ("PII", mask_personal),
    ("SentencePiece", encode_pieces),
]

# No SQL: SQL expresses neither the classifier nor the transducer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = land(stage(spark, docs, sf_dir), "pipeline")
    return docs
