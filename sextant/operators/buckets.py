"""A keyed table whose writes touch only the buckets of the keys they change, each write applied once.

Rows lie in buckets by a hash of the key.  A write reads the buckets that its keys fall into, writes them anew in a folder of
its own, and then commits by putting one small ledger file in place, which names the folder of every bucket and the
batches that were applied.  Readers follow the latest ledger file, so a write that fails half way changes nothing, and
a batch that is replayed after a failure finds itself in the ledger and does nothing.  Writers are one at a time, as
micro-batches are: of two that commit the same number the second one fails.

    held = Buckets(spark, path, "source")
    held.create(rows)
    held.upsert(rows)                       # SNK2: whole rows; unknown keys come in
    held.update(rows)                       # SNK4: columns that aren't null, known keys alone
    held.delete(keys)                       # SNK5, SNK6
    held.apply(changes, chunks, batch="q:7")
    held.sync(chunks)                       # JN8-10: what the scan doesn't hold goes
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ledger:
    """folders: bucket to folder; batches: the last batch of each stream; counts: of the last write."""

    number: int
    schema: str
    buckets: int
    folders: dict[str, str]
    batches: dict[str, int]
    counts: dict[str, int]


class Buckets:
    def __init__(self, spark: SparkSession, path: str, key: str = "id"):
        self.spark, self.path, self.key = spark, path, key

    def _at(self, *names: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def ledger(self, number: int | None = None) -> Ledger:
        """The latest ledger, or that of an earlier number."""
        if number is None:
            at, fs = self._at("ledger")
            found = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
            numbers = [int(n.split(".")[0]) for n in found if n.endswith(".json") and n[0].isdigit()]
            if not numbers:
                raise ValueError(f"no table at {self.path}")
            number = max(numbers)
        at, _ = self._at("ledger", f"{number:012d}.json")
        text = "\n".join(r[0] for r in self.spark.read.text(at.toString()).collect())
        return Ledger(number, **json.loads(text))

    def _commit(self, new: Ledger) -> Ledger:
        """Put the ledger file in place; a number that is taken is an error."""
        at, fs = self._at("ledger", f"{new.number:012d}.json")
        part, _ = self._at("ledger", f"part-{uuid.uuid4().hex}")
        out = fs.create(part)
        out.write(bytearray(json.dumps({c: getattr(new, c) for c in ("schema", "buckets", "folders", "batches", "counts")}).encode()))
        out.close()
        if fs.exists(at) or not fs.rename(part, at):
            fs.delete(part, False)
            raise RuntimeError(f"write {new.number} of {self.path} was made by another writer")
        return new

    def _bucket(self, col: str, n: int):
        return F.pmod(F.xxhash64(F.col(col)), F.lit(n)).cast("int")

    def create(self, rows: DataFrame, buckets: int = 64) -> None:
        """Write the first version; rows of one key lie together."""
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        self._commit(self._write(Ledger(0, schema, buckets, {}, {}, {}), rows, None))

    def _write(self, base: Ledger, rows: DataFrame, touched: list[int] | None) -> Ledger:
        """The ledger in which the touched buckets (None: all) hold rows and nothing else."""
        folder = f"data/{base.number:012d}-{uuid.uuid4().hex[:8]}"
        rows = rows.withColumn("_bucket", self._bucket(self.key, base.buckets)).repartition(F.col("_bucket"))
        rows.write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        at, fs = self._at(folder)
        written = {f.getPath().getName().split("=")[1]: folder for f in fs.listStatus(at) if "=" in f.getPath().getName()}
        kept = {} if touched is None else {b: f for b, f in base.folders.items() if int(b) not in touched}
        return replace(base, folders=kept | written)

    def read(self, ledger: Ledger | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of the latest ledger or a given one; only: of some buckets."""
        ledger = ledger or self.ledger()
        paths = [f"{self.path}/{f}/_bucket={b}" for b, f in sorted(ledger.folders.items()) if only is None or int(b) in only]
        if not paths:
            return self.spark.createDataFrame([], ledger.schema)
        return self.spark.read.schema(ledger.schema).parquet(*paths)

    def change(self, keys: DataFrame, make: Callable[[DataFrame], DataFrame], batch: str | None = None, counts: Callable[[DataFrame], dict] | None = None) -> Ledger:
        """Put make(rows) in place of the rows of all buckets that keys (key) fall into.

        batch: "<stream>:<number>"; numbers grow, and one that isn't above the last applied of its stream changes nothing.
        """
        base = self.ledger()
        stream, _, number = (batch or ":").rpartition(":")
        if batch and int(number) <= base.batches.get(stream, -1):
            return base
        touched = [r[0] for r in keys.select(self._bucket(self.key, base.buckets).alias("b")).distinct().collect()]
        base = replace(base, number=base.number + 1, batches=base.batches | ({stream: int(number)} if batch else {}), counts={})
        if touched:
            old = self.read(base, touched)
            base = replace(self._write(base, make(old), touched), counts=counts(old) if counts else {})
        return self._commit(base)

    def upsert(self, rows: DataFrame, batch: str | None = None) -> Ledger:
        return self.change(rows, lambda old: old.join(rows.select(self.key), self.key, "left_anti").unionByName(rows), batch)

    def update(self, rows: DataFrame, batch: str | None = None) -> Ledger:
        """Columns of rows that aren't null replace those of known keys; a key has one row here."""
        cols = [c for c in rows.columns if c != self.key]

        def make(old: DataFrame) -> DataFrame:
            j = old.alias("o").join(rows.alias("n"), self.key, "left")
            return j.select(*(self.key if c == self.key else F.coalesce(f"n.{c}", f"o.{c}").alias(c) if c in cols else F.col(f"o.{c}") for c in old.columns))

        return self.change(rows, make, batch)

    def delete(self, keys: DataFrame, batch: str | None = None) -> Ledger:
        return self.change(keys, lambda old: old.join(keys.select(self.key), self.key, "left_anti"), batch)

    def apply(self, changes: DataFrame, chunks: DataFrame, batch: str | None = None) -> Ledger:
        """Change events by key (key, event_type: created, modified or deleted) with the chunks of the files as they are now.

        Deleted sources leave.  Created and modified ones are replaced if their content_hash differs from the kept one;
        one without chunks leaves as well.  counts: sources added, modified, deleted and unchanged, chunks removed and added.
        """
        k = self.key
        changes = changes.groupBy(k).agg(F.max("event_type").alias("event_type"))
        now = chunks.join(changes.where("event_type <> 'deleted'"), k, "left_semi")

        def diff(old: DataFrame) -> DataFrame:
            """key, event_type, was, now, n_old, n_new of every changed source."""
            was = old.groupBy(k).agg(F.max("content_hash").alias("was"), F.count("*").alias("n_old"))
            new = now.groupBy(k).agg(F.max("content_hash").alias("now"), F.count("*").alias("n_new"))
            return changes.join(was, k, "left").join(new, k, "left").na.fill(0, ["n_old", "n_new"])

        same = (F.col("event_type") != "deleted") & F.col("was").isNotNull() & (F.col("was") == F.col("now"))

        def make(old: DataFrame) -> DataFrame:
            moved = diff(old).where(~F.coalesce(same, F.lit(False))).select(k)
            return old.join(moved, k, "left_anti").unionByName(now.join(moved, k, "left_semi").select(*old.columns))

        def counts(old: DataFrame) -> dict:
            d = diff(old).withColumn("same", F.coalesce(same, F.lit(False)))
            had, has = F.col("n_old") > 0, F.col("n_new") > 0
            of = lambda c: F.count_if(c)
            row = d.agg(
                of(~had & has).alias("added"), of(had & has & ~F.col("same")).alias("modified"), of(had & ~has).alias("deleted"), of("same").alias("unchanged"),
                F.coalesce(F.sum(F.when(~F.col("same"), F.col("n_old"))), F.lit(0)).alias("chunks_removed"), F.coalesce(F.sum(F.when(~F.col("same"), F.col("n_new"))), F.lit(0)).alias("chunks_added"),
            ).first()
            return row.asDict()

        return self.change(changes, make, batch, counts)

    def sync(self, chunks: DataFrame, root: str | None = None, batch: str | None = None) -> Ledger:
        """Reconcile with a whole scan: sources that it doesn't hold are deleted, new and changed ones are put in place.

        root: only kept sources below it count as deleted.  Buckets without a difference aren't written.
        """
        k = self.key
        kept = self.read().groupBy(k).agg(F.max("content_hash").alias("was"))
        scan = chunks.groupBy(k).agg(F.max("content_hash").alias("now"))
        below = F.lit(True) if root is None else F.col(k).startswith(root.rstrip("/") + "/")
        both = kept.join(scan, k, "full_outer").where((F.col("now").isNotNull() | below) & ~F.col("was").eqNullSafe(F.col("now")))
        return self.apply(both.select(k, F.when(F.col("now").isNull(), "deleted").when(F.col("was").isNull(), "created").otherwise("modified").alias("event_type")), chunks, batch)

    def sink(self, load: Callable[[DataFrame], DataFrame], stream: str = "changes") -> Callable[[DataFrame, int], None]:
        """For foreachBatch: each micro-batch of changes is applied once; load gives the chunks of its changed files."""
        return lambda changes, number: self.apply(changes, load(changes), f"{stream}:{number}") and None

    def vacuum(self, keep: int = 1) -> int:
        """Delete the folders that none of the last `keep` ledgers name; how many there were."""
        last = self.ledger().number
        named = {f for n in range(max(0, last - keep + 1), last + 1) for f in self.ledger(n).folders.values()}
        at, fs = self._at("data")
        old = [f.getPath() for f in fs.listStatus(at) if f"data/{f.getPath().getName()}" not in named]
        return sum(fs.delete(p, True) for p in old)
