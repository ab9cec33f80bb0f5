"""A corpus from documents to packed sequences, stage by stage; each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowledger.llm import mixing, nearcopies, packing, secrets, toxicity
from rowledger.llm.common import absent, discard, materialized, scratch_scope, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the cut; labels train it. Null and empty texts stay; rows that share an
    id are judged each by its own text; columns of any name are kept."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the document with the smallest id.
    Null and empty texts are copies of each other; ids that are null or repeat lose no other text."""
    return nearcopies.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; n_chars follows the text where it changes, if there is such a column.
    Null and empty texts stay as they are; columns of any name are kept."""
    before, *_ = absent(docs.columns, "_n")
    masked = secrets.redact(docs.withColumn(before, F.length("text")))
    if "n_chars" in docs.columns:
        n = F.length("text")
        masked = masked.withColumn("n_chars", F.when(n != F.col(before), n.cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return masked.select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those without a word have nothing to take and go."""
    return mixing.resample(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their places and a checksum of their ids. A null or empty text is one piece."""
    return packing.pack(docs, digest=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_copies),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No SQL: scores of compression, minimum hashes and a trained network are not SQL's; tests/llm holds run() against plain
#: Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written, then what it was made from goes."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch_scope(spark):
            made = stage(spark, docs, sf_dir)
            docs, path = materialized(made, f"pipeline-{name}", keep=True)
        if before:
            discard(spark, before)
        before = path
    return docs
