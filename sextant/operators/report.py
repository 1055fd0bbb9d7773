"""Counters and reports: benchmark configurations, tasks, index runs, migrations."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def benchmark_report(results: DataFrame) -> DataFrame:
    """Per config of results (config, latency, score, rerank_score): means, extremes, place by latency and the fastest.

    The rerank score counts where there is one.  latency_rank runs from 0 (least mean latency) to 1; ties go by name.
    """
    score = F.coalesce("rerank_score", "score")
    per = results.groupBy("config").agg(
        F.count("*").alias("results"), F.avg(score).alias("avg_score"), F.avg("latency").alias("avg_latency"), F.min("latency").alias("min_latency"), F.max("latency").alias("max_latency")
    )
    every = Window.partitionBy(F.lit(0))  # one row per config
    place = F.row_number().over(every.orderBy("avg_latency", "config"))
    n = F.count("*").over(every)
    return per.withColumn("latency_rank", (place - 1) / F.greatest(n - 1, F.lit(1))).withColumn("fastest", place == 1)


def is_active(status: Column) -> Column:
    return F.coalesce(status.isin("pending", "running"), F.lit(False))


def completed_on(status: Column, finished: Column, day: Column) -> Column:
    return F.coalesce((status == "completed") & (F.to_date(finished) == day), F.lit(False))


def task_counts(tasks: DataFrame, day: Column) -> DataFrame:
    """One row of tasks (status, finished): active, completed_today, total."""
    active, done = is_active(F.col("status")), completed_on(F.col("status"), F.col("finished"), day)
    return tasks.agg(F.count_if(active).alias("active"), F.count_if(done).alias("completed_today"), F.count("*").alias("total"))


def index_counters(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: files indexed (no skip_reason), files skipped, chunks made.

    Where files have an error column, those with an error are neither indexed nor skipped, and `errors` counts them.
    """
    failed = F.col("error").isNotNull() if "error" in files.columns else F.lit(False)
    skipped = F.col("skip_reason").isNotNull()
    f = files.agg(F.count_if(~failed & ~skipped).alias("files_indexed"), F.count_if(~failed & skipped).alias("files_skipped"), *([F.count_if(failed).alias("errors")] if "error" in files.columns else []))
    return f.withColumn("chunks_created", chunks.agg(F.count("*")).scalar())


def change_counters(changes: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """One row for changes (source, change_type) and the chunks (source) before and after: files by kind, chunks that come and go."""
    kinds = {"added": "files_added", "modified": "files_updated", "deleted": "files_deleted"}
    gone = old.join(changes.where("change_type in ('modified', 'deleted')").select("source"), "source", "left_semi")
    come = new.join(changes.where("change_type in ('added', 'modified')").select("source"), "source", "left_semi")
    out = changes.agg(*(F.count_if(F.col("change_type") == k).alias(name) for k, name in kinds.items()))
    return out.withColumn("chunks_added", come.agg(F.count("*")).scalar()).withColumn("chunks_removed", gone.agg(F.count("*")).scalar())


def indexed_hashes(index: DataFrame, order: str = "seq") -> DataFrame:
    """source, content_hash of the last stored chunk of each source."""
    return index.groupBy("source").agg(F.max_by("content_hash", order).alias("content_hash"))


def content_changed(index: DataFrame, scanned: DataFrame, order: str = "seq") -> DataFrame:
    """source, changed: whether a scanned file's hash differs from that of its first stored chunk; unknown files have changed."""
    first = index.groupBy("source").agg(F.min_by("content_hash", order).alias("_old"))
    same = F.coalesce(F.col("content_hash") == F.col("_old"), F.lit(False))
    return scanned.join(first, "source", "left").select("source", (~same).alias("changed"))


def migration_report(collections: DataFrame) -> DataFrame:
    """One row of per-collection results (collection, documents, error): totals, and how many failed."""
    return collections.agg(F.count("*").alias("collections"), F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.count("error").alias("errors"))


def progress_ratio(df: DataFrame, group: str, order: str) -> DataFrame:
    """df with progress: which share of its group is done at each row."""
    w = Window.partitionBy(group)
    return df.withColumn("progress", F.row_number().over(w.orderBy(order)) / F.count("*").over(w))


def progress_marks(df: DataFrame, group: str, order: str, every: int = 10) -> DataFrame:
    """group, done, total at each `every` rows of a group and at its end."""
    w = Window.partitionBy(group)
    out = df.select(group, F.row_number().over(w.orderBy(order)).alias("done"), F.count("*").over(w).alias("total"))
    return out.where((F.col("done") % every == 0) | (F.col("done") == F.col("total")))
