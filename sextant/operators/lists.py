"""Lists of any length (rows of one query_id in an order), laid out in ranges: no task holds a whole list."""

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.sources.files import materialize

#: Bytes of a part as the mean goes, a row's columns beside its text counting as ROW.
PART, ROW = 1 << 25, 100
#: Ends of ranges that are sent to all tasks; more are met by a join.
SMALL = 100_000


def parts(df: DataFrame) -> int:
    """Partitions for a table, by its rows and the bytes of its texts; as many as there are cores at least."""
    text = F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) if "text" in df.columns else F.lit(0)
    size = df.agg((F.count("*") * ROW + text).alias("n")).first()["n"]
    return max(df.sparkSession.sparkContext.defaultParallelism, ceil(size / PART))


def laid_out(df: DataFrame, *order: Column, ranges: int | None = None) -> DataFrame:
    """df with _part and _at, written in ranges of query_id and the order: a list's ranges follow each other, _at is the order."""
    rows = df.repartitionByRange(ranges or parts(df), "query_id", *order).sortWithinPartitions("query_id", *order)
    rows = materialize(rows.withColumn("_at", F.monotonically_increasing_id()))
    # A struct of a null equals itself, so that the lists are joined and dealt by one key.
    return rows.withColumns({"_part": F.shiftright("_at", 33), "_list": F.struct("query_id")})


def with_ends(rows: DataFrame, ends: DataFrame, ranges: int | None = None) -> DataFrame:
    """Rows with what ends (one row a range and list: _part, _list, ...) say about theirs; ranges: rows aren't dealt by them yet."""
    ends = materialize(ends)
    if ends.count() <= SMALL:
        return rows.join(F.broadcast(ends), ["_part", "_list"])
    return (rows.repartition(ranges, "_part", "_list") if ranges else rows).join(ends.hint("merge"), ["_part", "_list"])


def numbered(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """scoring.ranked() for long lists: the place within a range, and the rows of the list in the ranges before it."""
    ranges = parts(df)
    rows = laid_out(df, *order, ranges=ranges)
    ends = rows.groupBy("_part", "_list").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_list").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    place = (F.col("_at") - F.col("_first") + F.col("_before") + 1).cast("int")
    return with_ends(rows, ends, ranges).withColumn(name, place).drop("_at", "_part", "_list", "_first", "_before")


def runs(df: DataFrame, value: str, *order: Column, ranges: int) -> DataFrame:
    """df with _run: neighbours in a list whose values are equal (null equals null) have the same number within it.

    Steps from value to value are counted within each range, then ranges are put together by their first and last values.
    """
    rows = laid_out(df, *order, ranges=ranges)
    w = Window.partitionBy("_part", "_list").orderBy("_at")
    step = lambda now, last, over: F.when(F.row_number().over(over) == 1, 0).otherwise((~now.eqNullSafe(F.lag(last).over(over))).cast("int"))
    dealt = rows.repartition(ranges, "_part", "_list")
    inside = dealt.withColumn("_step", step(F.col(value), value, w)).withColumn("_in", F.sum("_step").over(w)).drop("_step")
    ends = inside.groupBy("_part", "_list").agg(F.min_by(value, "_at").alias("_one"), F.max_by(value, "_at").alias("_last"), F.max("_in").alias("_n"))
    v = Window.partitionBy("_list").orderBy("_part")
    ends = ends.withColumn("_between", step(F.col("_one"), "_last", v))
    before = F.sum("_between").over(v) + F.coalesce(F.sum("_n").over(v.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select("_part", "_list", before.alias("_before"))
    return with_ends(inside, ends).withColumn("_run", F.col("_in") + F.col("_before")).drop("_at", "_part", "_list", "_in", "_before")
