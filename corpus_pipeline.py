"""A corpus pipeline of five stages; each reads what the one before it wrote.

quality_classifier  documents that the classifier rejects (a probability of good quality below REJECT) go
near_dedup          one document of each near-duplicate group (five words, 80 %) stays
suffix_dedup        every repeated 200-byte string is cut from the texts (partial characters at a cut go with it)
mixing              sources are brought to their target weights, documents repeated or left out
packing             the mix is tokenised and packed into sequences of 2048 ids

Stages 1 to 4 return the columns of documents; the last returns a row per piece.

Null and empty texts and very long ones pass like any others: an empty text has a score, is nobody's duplicate, loses
nothing, is mixed with size 0 (so it isn't emitted unless its rank crosses an integer) and packs as one id.  Null ids
and sources are values of their own.  Of equal rows near_dedup keeps one, if they hold a word; ties go to the least id.
An empty table gives an empty result of the same columns at each stage.  Further columns are carried along unchanged,
whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm import byte_cnn, minhash, mixing, packing, suffix_dedup
from sextant.llm.common import fold, fresh, scratch, table

#: The classifier's own decision.
REJECT = 0.5


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 3) != 1)
    name = fresh(docs, "quality")[0]
    scored = byte_cnn.score(docs, byte_cnn.fit(docs, labels), docs.columns, name)
    return scored.where(F.col(name) >= REJECT).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicate(docs, minhash.Rule(5, 80))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = suffix_dedup.suffix_dedup(docs, with_text=True).withColumnRenamed("kept_text", "text")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emit(mixing.mix(docs), docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_array_dedup),
    ("mixing", source_mixing),
    ("packing", best_fit_packing),
]

#: Neither the network nor the packing can be told in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = scratch(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
