"""Collections as tables: upsert, update, delete, incremental sync, copy and its verification."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert_latest(df: DataFrame, key: str, seq: str) -> DataFrame:
    """The row with the greatest seq of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(seq))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def insert_absent(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def update(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Columns of new that aren't null replace those of old; unknown ids are ignored."""
    cols = [c for c in new.columns if c != key]
    j = old.alias("o").join(new.alias("n"), key, "left")
    return j.select(key, *(F.coalesce(f"n.{c}", f"o.{c}").alias(c) if c in cols else F.col(f"o.{c}") for c in old.columns if c != key))


def delete(df: DataFrame, condition) -> DataFrame:
    """Rows for which the condition isn't true."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def delete_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def page(df: DataFrame, key: str, limit: int, offset: int) -> DataFrame:
    """One page, by sorting; for several pages of a large table write Pages once."""
    return df.orderBy(key).offset(offset).limit(limit)


class Pages:
    """A table laid out for pages: in ranges of its key, each with the number of rows before it.

    A page is the rows of the ranges that it touches, cut by their numbers: nothing is sorted again and no other file is
    read.  Rows of one key are ordered by a hash of the row, which also divides a key that many rows share.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        counts = spark.read.schema("_range int, n long").parquet(f"{path}/ranges").orderBy("_range").collect()  # one row a range
        self.schema = spark.read.parquet(f"{path}/schema").schema
        self.starts, self.total = [], 0
        for r in counts:
            self.starts.append((r["_range"], self.total, r["n"]))
            self.total += r["n"]

    @classmethod
    def write(cls, df: DataFrame, key: str, path: str, ranges: int | None = None) -> "Pages":
        keyed = df.withColumn("_h", F.xxhash64(*df.columns))
        keyed = keyed.repartitionByRange(*([ranges] if ranges else []), key, "_h").sortWithinPartitions(key, "_h")
        number = F.monotonically_increasing_id()  # the partition, and 33 bits of the row's place in it
        rows = keyed.drop("_h").withColumn("_at", number.bitwiseAND(F.lit((1 << 33) - 1))).withColumn("_range", F.shiftright(number, 33).cast("int"))
        rows.write.mode("overwrite").partitionBy("_range").parquet(f"{path}/rows")
        rows.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/schema")
        kept = df.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")
        kept.groupBy("_range").agg(F.count("*").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges")
        return cls(df.sparkSession, path)

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")
        held = [(r, max(0, offset - at), min(n, offset + limit - at)) for r, at, n in self.starts if at < offset + limit and at + n > offset]
        cond = F.lit(False)
        for r, low, high in held:
            cond = cond | ((F.col("_range") == r) & (F.col("_at") >= low) & (F.col("_at") < high))
        return rows.where(F.col("_range").isin([r for r, _, _ in held]) & cond).drop("_range", "_at")

    def paged(self, size: int) -> DataFrame:
        """All rows, each with the number of its page (from 0): one plan, however many pages there are."""
        starts = self.spark.createDataFrame([(r, at) for r, at, _ in self.starts], "_range int, _before long")
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows").join(F.broadcast(starts), "_range")  # one row a range
        return rows.withColumn("page", F.floor((F.col("_before") + F.col("_at")) / F.lit(size))).drop("_range", "_at", "_before")

    def batches(self, size: int):
        """Every page of a given size in turn, for a copy batch by batch; a plan a page (paged() is one for all)."""
        return (self.page(size, at) for at in range(0, self.total, size))


def sync_diff(indexed: DataFrame, scanned: DataFrame) -> DataFrame:
    """source, change_type of (source, content_hash) tables: added, modified, deleted or unchanged, by one full join."""
    i = indexed.select("source", F.col("content_hash").alias("old"), F.lit(True).alias("i"))
    s = scanned.select("source", F.col("content_hash").alias("new"), F.lit(True).alias("s"))
    kind = F.when(F.col("i").isNull(), "added").when(F.col("s").isNull(), "deleted").when(~F.col("old").eqNullSafe(F.col("new")), "modified").otherwise("unchanged")
    return i.join(s, "source", "full_outer").select("source", kind.alias("change_type"))


def verify_copy(source: DataFrame, target: DataFrame, name: str = "collection") -> DataFrame:
    """Per collection: both counts and whether they agree."""
    a = source.groupBy(name).agg(F.count("*").alias("source_count"))
    b = target.groupBy(name).agg(F.count("*").alias("target_count"))
    j = a.join(b, name, "full_outer").na.fill(0, ["source_count", "target_count"])
    return j.withColumn("ok", F.col("source_count") == F.col("target_count"))


def collection_stats(df: DataFrame, name: str) -> DataFrame:
    per = df.groupBy(name).agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("collections"), F.coalesce(F.sum("n"), F.lit(0)).alias("documents"), F.coalesce(F.floor(F.avg("n") + 0.5), F.lit(0)).cast("long").alias("average"))


def collections(df: DataFrame, name: str) -> DataFrame:
    """The listing: each collection with its number of documents."""
    return df.groupBy(F.col(name).alias("collection")).agg(F.count("*").alias("documents"))


def clear(df: DataFrame, name: str, collection: str) -> DataFrame:
    """The table without the rows of one collection."""
    return delete(df, F.col(name) == collection)


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of new replace those of old as a whole (a null in new stays null); unknown ids come in."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def get(df: DataFrame, ids: DataFrame | None = None, where=None, key: str = "id", limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows by ids, by a condition, or both; a limit takes a page in the order of the key."""
    out = df if ids is None else df.join(ids.select(key).distinct(), key, "left_semi")
    out = out if where is None else out.where(where)
    return out if limit is None and not offset else page(out, key, limit if limit is not None else 2**31 - 1, offset)


def migrate(source: DataFrame, path: str, name: str = "collection") -> DataFrame:
    """Copy all collections in one job to a table partitioned by collection; both counts of each, read back."""
    source.write.mode("overwrite").partitionBy(name).parquet(path)
    target = source.sparkSession.read.schema(source.schema).parquet(path)
    return verify_copy(source, target, name)


def surrogate_id(*cols) -> Column:
    """An id that a retried task makes again: sha256 of the values (null as the empty text), a zero byte between them."""
    return F.sha2(F.concat_ws("\0", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols)), 256)


class Collections:
    """Collections as tables of the session's catalogue, under a common prefix."""

    def __init__(self, spark: SparkSession, prefix: str = "collection_"):
        self.spark, self.prefix = spark, prefix

    def exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(self.prefix + name)

    def create(self, name: str, schema: str) -> None:
        if self.exists(name):
            raise ValueError(f"collection {name} exists already")
        self.spark.createDataFrame([], schema).write.saveAsTable(self.prefix + name)

    def add(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").saveAsTable(self.prefix + name)

    def read(self, name: str) -> DataFrame:
        if not self.exists(name):
            raise ValueError(f"no collection {name}; there are {self.names()}")
        return self.spark.table(self.prefix + name)

    def names(self) -> list[str]:
        return sorted(x.name[len(self.prefix) :] for x in self.spark.catalog.listTables() if x.name.startswith(self.prefix))

    def drop(self, name: str) -> bool:
        found = self.exists(name)
        self.spark.sql(f"DROP TABLE IF EXISTS `{self.prefix}{name}`")
        return found

    def reset(self) -> int:
        return sum(self.drop(name) for name in self.names())
