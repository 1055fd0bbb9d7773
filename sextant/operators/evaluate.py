"""Retrieval metrics over query tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hit_rate(expected: Column, got: Column, k: int) -> Column:
    """Share of expected ids among the first k, in percent; 0 if either is empty."""
    top = F.slice(got, 1, k)
    share = 100.0 * F.size(F.filter(expected, lambda x: F.array_contains(top, x))) / F.size(expected)
    return F.when((F.size(expected) > 0) & (F.size(got) > 0), share).otherwise(F.lit(0.0))


def matched(keywords: Column, text: Column) -> Column:
    return F.size(F.filter(keywords, lambda x: F.contains(F.lower(text), F.lower(x))))


def per_query(queries: DataFrame, results: DataFrame, k: int = 10) -> DataFrame:
    """query_id, hit_rate, relevance, noise_ratio of each query (query_id, keywords, expected), 0 where it has no result.

    results: query_id, pos, doc_id, text.
    """
    per = results.join(queries.select("query_id", "keywords"), "query_id")
    n, m = F.size("keywords"), matched(F.col("keywords"), F.col("text"))
    per = per.withColumn("rel", F.when(n > 0, m / n).otherwise(0.0)).withColumn("noise", (m == 0).cast("double"))
    got = F.transform(F.array_sort(F.collect_list(F.struct("pos", "doc_id"))), lambda x: x["doc_id"])
    agg = per.groupBy("query_id").agg(F.avg("rel").alias("rel"), F.avg("noise").alias("noise"), got.alias("got"))
    hit = hit_rate(F.col("expected"), F.coalesce("got", F.array().cast(dict(queries.dtypes)["expected"])), k)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return queries.join(agg, "query_id", "left").select("query_id", hit.alias("hit_rate"), zero("rel").alias("relevance"), zero("noise").alias("noise_ratio"))


def evaluate(queries: DataFrame, results: DataFrame, k: int = 10) -> DataFrame:
    """One row of means over all queries."""
    mean = (F.round(F.avg(c), 6).alias(c) for c in ("hit_rate", "relevance", "noise_ratio"))
    return per_query(queries, results, k).agg(*mean, F.count("*").alias("queries"))


def questions(df: DataFrame, category: str | None = None, ids: list | None = None) -> DataFrame:
    """The questions of a category, of some ids, or both."""
    df = df if category is None else df.where(F.col("category") == category)
    return df if ids is None else df.where(F.col("query_id").isin(ids))
