"""Ranks, fusion and normalisation over result lists keyed by query_id."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of a score that ranks go by: the order in which terms are summed shows only beyond them.
PLACES = 10


def ranked(df: DataFrame, *order: Column, name: str = "rank", k: int | None = None) -> DataFrame:
    """Position within a query, from 1; with k, the first k only (the limit is pushed below the window's shuffle)."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return out if k is None else out.where(F.col(name) <= k)


def distance_to_score(d: Column) -> Column:
    return F.when(d.isNull(), F.lit(0.0)).when(d <= 0, F.lit(1.0)).otherwise(1.0 / (1.0 + d))


def _per_query(df: DataFrame, *aggregates: Column) -> DataFrame:
    """df with aggregates of its query: joined, so that a long list isn't brought to one task."""
    of = df.groupBy(F.col("query_id").alias("_q")).agg(*aggregates)
    return df.join(of, F.col("query_id").eqNullSafe(F.col("_q"))).drop("_q")


def min_max(df: DataFrame, col: str = "score", out: str = "norm") -> DataFrame:
    low, high = F.col("_low"), F.col("_high")
    both = _per_query(df, F.min(col).alias("_low"), F.max(col).alias("_high"))
    return both.withColumn(out, F.when(high == low, F.lit(1.0)).otherwise((F.col(col) - low) / (high - low))).drop("_low", "_high")


def rank_norm(df: DataFrame, rank: str = "rank", out: str = "norm") -> DataFrame:
    both = _per_query(df, F.count("*").alias("_rows"))
    return both.withColumn(out, 1.0 - (F.col(rank) - 1) / F.greatest(F.col("_rows") - 1, F.lit(1))).drop("_rows")


def rrf(vector: DataFrame, lexical: DataFrame, k: int = 60, alpha: float | Column = 0.5, beta: float | Column = 0.5) -> DataFrame:
    """Weighted reciprocal rank fusion of two lists (query_id, doc_id, rank, score); ties keep the vector list's order.

    Weights may be columns of query_id.  Ranks go by the unrounded sums."""
    v = vector.select("query_id", "doc_id", F.col("rank").alias("v_rank"), F.col("score").alias("distance"))
    b = lexical.select("query_id", "doc_id", F.col("rank").alias("b_rank"), F.col("score").alias("bm25_score"))
    part = lambda w, r: F.coalesce(w / (k + F.col(r)), F.lit(0.0))
    out = v.join(b, ["query_id", "doc_id"], "full_outer")
    out = out.withColumn("score", part(F.lit(alpha), "v_rank") + part(F.lit(beta), "b_rank"))
    return ranked(out, F.desc("score"), F.asc_nulls_last("v_rank"), F.asc_nulls_last("b_rank")).withColumn("score", F.round("score", 6))
