"""The registered queries of the training-data operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm import align, bpe, byte_cnn, license_scan, minhash, mixing, packing, ppm, ranked, suffix_dedup, topk
from sextant.llm import toxicity as tox
from sextant.llm.common import table
from sextant.llm.quality_rules import quality_rules


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    out = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), trusted)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ints = topk.integers(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.exact_topk(ints, ints.where("vec_id % 50 = 0"), 5)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tox.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_cnn.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"))


def op10_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.scored(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_suffix_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return align.digests(table(spark, sf_dir, "documents"), *paths)


def op12_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), 20)


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_toxicity, op3_minhash, op4_byte_cnn, op5_exact_topk, op6_license_scan, op7_mixing, op8_packing, op9_suffix_dedup, op10_ppm, op11_tree_bpe, op12_block_max_wand, op13_suffix_transducer)}
ORACLE_SQL = {"op3_minhash": minhash.SQL, "op5_exact_topk": topk.SQL, "op7_mixing": mixing.SQL, "op12_block_max_wand": ranked.SQL}
