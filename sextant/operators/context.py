"""Context assembly over result lists: query_id, pos, doc_id, text, score, source."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions.scoring import ranked
from sextant.operators import lists


def dedup_exact(df: DataFrame) -> DataFrame:
    """The first of equal texts within a query.  Equality goes by a 256-bit hash, so that texts aren't sorted."""
    first = Window.partitionBy("query_id", F.sha2("text", 256)).orderBy("pos")
    return df.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def merge_consecutive(df: DataFrame) -> DataFrame:
    """Neighbours in the list with the same source (null equals null) become one: texts joined, first id and score.

    Where the list has start and end, a merged row spans from the first start to the last end, 0 standing for null; a row
    without such a neighbour keeps its own.
    """
    n = lists.parts(df)
    g = lists.runs(df, "source", F.col("pos"), ranges=n).repartition(n, "query_id", "_run")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    both = F.count("*") > 1
    spans = {"start": F.min_by("start", "pos"), "end": F.max_by("end", "pos")} if {"start", "end"} <= set(df.columns) else {}
    return g.groupBy("query_id", "_run", "source").agg(
        F.min("pos").alias("pos"), F.min_by("doc_id", "pos").alias("doc_id"), F.min_by("score", "pos").alias("score"), F.array_join(parts, "\n").alias("text"), F.count("*").alias("chunks_merged"),
        *(F.when(both, F.coalesce(c, F.lit(0))).otherwise(c).alias(name) for name, c in spans.items()),
    ).drop("_run")


def keep_best(df: DataFrame) -> DataFrame:
    """One row per document over the variants of a query: the highest score, at the place of the first sighting."""
    w = Window.partitionBy("query_id", "doc_id")
    best = df.withColumn("first_pos", F.min("pos").over(w)).withColumn("_n", F.row_number().over(w.orderBy(F.desc("score"), "pos")))
    return best.where("_n = 1").drop("_n", "pos").withColumnRenamed("first_pos", "pos")


def build(df: DataFrame, limit: int, remove_duplicates: bool = True, merge: bool = False) -> DataFrame:
    df = merge_consecutive(df) if merge else df
    df = dedup_exact(df) if remove_duplicates else df
    return ranked(df, F.desc("score"), F.col("pos"), k=limit)
