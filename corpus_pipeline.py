"""Documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns what the next one reads; ``run`` writes each
result as Parquet to the shared folder, so a lost executor costs no more than a stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cellgrid.llm import co_training, exact_dedup, order_minhash, packing, secret_ledger
from cellgrid.llm.common import configure, materialise, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents the classifier rejects (quality under 0.5)."""
    configure(spark)
    model = co_training.fit_quality(docs, table(spark, sf_dir, "labels"))
    return co_training.score_quality(docs, model, carry=COLUMNS, only_kept=True)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group equal but for white space."""
    configure(spark)
    return exact_dedup.drop_copies(docs).select(COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class."""
    configure(spark)
    return order_minhash.drop_near_copies(docs).select(COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks found secrets; a document stays, its ``n_chars`` follows the text."""
    configure(spark)
    found = secret_ledger.new_ledger(spark).mask(docs)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2048 ids: one row a piece, with its ids."""
    configure(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("secrets", secrets), ("packing", pack)]

# The classifier, the min-hash classes and the tokenizer are beyond SQL: tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last result without the ids."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs.drop("ids")
