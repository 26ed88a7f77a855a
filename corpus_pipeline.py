"""The corpus pipeline: stages that each apply one operator to all that the one before kept.

Documents without a learnt language go and null languages are named; of equal texts the smallest id stays, of groups of
near copies too; personal data is masked; what is left is packed into token sequences. Stages are Parquet tables to one another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm import exact_dedup, language_id, packing, pii, simhash
from inkspan.llm.common import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject texts that are null, hold no letter, or are of 100 letters or more and in no learnt language by their score;
    name null languages by the prediction. Without labels, all that hold a letter stay as they are."""
    return language_id.accept(docs, language_id.train(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies: sets of five-word shingles of an exact Jaccard similarity of 0.8 or more."""
    return simhash.keep_one(docs)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask spans as <KIND>; n_chars follows the text."""
    masked = pii.mask(docs, pii.train(docs))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    import public_tokenizers

    return packing.pack(packing.cut_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False))


STAGES = [("language", language), ("exact", exact), ("near", near), ("personal", personal), ("pack", pack)]
#: Language models, links within a Hamming radius, the span model and packing have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
