"""The corpus pipeline: toxicity and quality filters, near-duplicate removal, pseudonyms, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns of
docs, whatever they are named. All stages read texts whole, however long, take an empty table to an empty table, and treat
repeated rows alike.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfacts.llm._common import Scratch, unused
from docfacts.llm.minhash import keep_one
from docfacts.llm.packing import pack
from docfacts.llm.pii import pseudonymise
from docfacts.llm.quality import QualityModel
from docfacts.llm.toxicity import ToxicityModel

def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; null and empty texts score as texts without toxic words."""
    model = ToxicityModel.fit(docs, _labels(spark, sf_dir))
    score = unused("score", docs.columns)
    return model.score(docs, *docs.columns, name=score).where(F.col(score) < 0.5).drop(score)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.5 or more; null texts score as empty ones. Without any labels all stay."""
    model = QualityModel.fit(docs, _labels(spark, sf_dir))
    score = unused("score", docs.columns)
    return model.score(docs, *docs.columns, name=score).where(F.col(score) >= 0.5).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near-duplicates on five-word shingles.

    Null and empty texts have no duplicates, rows with a null doc_id stay, of rows that share a doc_id the least stays.
    """
    return keep_one(spark, docs, k=5)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by pseudonyms; n_chars follows the new text, null texts stay as they are."""
    found = unused("pii", docs.columns)
    made = pseudonymise(docs, key="docfacts", found=found).drop(found)
    size = F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return made.withColumn("n_chars", size).select(*[f"`{c}`" for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 4096 tokens; a null text is its end id alone."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_dedup", near_dedup), ("pii", pii), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are a written table that the next one reads."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.table(docs)
            if i:
                scratch.drop(before)
    return docs
