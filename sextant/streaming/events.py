"""File events: their source and filter, debounce sessions and the fold of a path's events, in batch and as a stream."""

import json
import re
import time
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor

from sextant.functions.text import excluded, extension
from sextant.sources.files import scratch


def debounce(events: DataFrame, seconds: int) -> DataFrame:
    """The events of files with their session (from 0) by watcher: a new one after `seconds` of silence.

    Events of folders don't count and are left out.  Events of one interval of that length belong together, so that only
    the intervals of a busy watcher meet in a window.  Every event of a file goes on with its session here; stream_fold also
    knows that a deletion which cancels a pending creation doesn't.
    """
    gap = seconds * 1_000_000
    e = events.where("not coalesce(is_directory, false)") if "is_directory" in events.columns else events
    e = e.withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("_slot", F.floor(F.col("_at") / gap))
    slots = e.groupBy("watcher", "_slot").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    w = Window.partitionBy("watcher").orderBy("_slot")
    fresh = F.coalesce(F.col("_first") - F.lag("_last").over(w) > gap, F.lit(False)).cast("int")
    slots = slots.withColumn("_f", fresh).select(F.col("watcher").alias("_w"), F.col("_slot").alias("_s"), F.sum("_f").over(w).alias("session"))
    same = e["watcher"].eqNullSafe(slots["_w"]) & e["_slot"].eqNullSafe(slots["_s"])
    return e.join(slots, same).drop("_at", "_slot", "_w", "_s")


def step(state: Column, kind: Column) -> Column:
    """Pending event after one more event of a path (null: none)."""
    return (
        F.when(state.isNull(), F.when(kind == "modified", "created").otherwise(kind))
        .when(kind == "created", F.lit("created"))
        .when(kind == "modified", F.when(state == "deleted", "created").otherwise(F.lit("modified")))
        .otherwise(F.when(state == "created", F.lit(None).cast("string")).otherwise(F.lit("deleted")))
    )


def coalesce_events(events: DataFrame) -> DataFrame:
    """watcher, session, path, event_type: what is left of each path's events; cancelled paths have no row."""
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"])
    folded = F.aggregate(kinds, F.lit(None).cast("string"), step)
    out = events.where("not coalesce(is_directory, false)").groupBy("watcher", "session", "path").agg(folded.alias("event_type"))
    return out.where("event_type is not null")


def fold_one(kind: str | None, new: str) -> str | None:
    """step() for one value: the pending event of a path after one more."""
    if new == "deleted":
        return None if kind == "created" else "deleted"
    return "created" if kind in (None, "deleted") or new == "created" else "modified"


FOLDED = "watcher string, start timestamp, path string, event_type string"


class Debounce(StatefulProcessor):
    """Sessions of one watcher with timers of event time.

    Events that the watermark hasn't passed wait; passed ones are folded in the order of time and id, whatever the order in
    which they came.  Each folded event sets the timer anew, except a deletion that cancels a pending creation; when the
    timer has run out, what is left of the paths is given out.  Kept are the waiting events and the pending paths alone.
    """

    def __init__(self, seconds: float):
        self.gap = round(seconds * 1e6)

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts long, event_id long, path string, event_type string")
        self.pending = handle.getMapState("pending", "path string", "event_type string")
        self.timer = handle.getValueState("timer", "start long, last long")

    def handleInputRows(self, key, rows, timerValues):
        held = []
        for part in rows:
            at = part["ts"].astype("datetime64[us]").astype("int64")
            held += list(zip(at.tolist(), part["event_id"].tolist(), part["path"].tolist(), part["event_type"].tolist()))
        if held:
            self.waiting.appendList(held)
            self.handle.registerTimer(_above(min(h[0] for h in held), timerValues.getCurrentWatermarkInMs()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get(), key=lambda r: (r[0], r[1])) if self.waiting.exists() else []
        ripe = [r for r in rows if r[0] <= now * 1000]
        timer = tuple(self.timer.get()) if self.timer.exists() else None
        pending = {k[0]: v[0] for k, v in self.pending.iterator()} if self.pending.exists() else {}
        out = []

        def close():
            out.extend((key[0], timer[0], path, kind) for path, kind in pending.items())
            pending.clear()

        for ts, _, path, kind in ripe:
            if timer and ts > timer[1] + self.gap:
                close()
                timer = None
            had = pending.pop(path, None)
            new = fold_one(had, kind)
            if new is not None:
                pending[path] = new
                timer = (timer[0] if timer else ts, ts)
        if timer and now * 1000 > timer[1] + self.gap:
            close()
            timer = None
        self.waiting.clear()
        self.pending.clear()
        if left := rows[len(ripe) :]:
            self.waiting.put(left)
            self.handle.registerTimer(_above(left[0][0], now))
        for path, kind in pending.items():
            self.pending.updateValue((path,), (kind,))
        if timer:
            self.timer.update(timer)
            self.handle.registerTimer(_above(timer[1] + self.gap + 1, now))
        else:
            self.timer.clear()
        if out:
            import pandas as pd

            frame = pd.DataFrame(out, columns=["watcher", "start", "path", "event_type"])
            yield frame.assign(start=pd.to_datetime(frame["start"], unit="us"))

    def close(self) -> None:
        pass


def _above(micros: int, watermark: int) -> int:
    """The first millisecond not before micros at which a timer can still run out."""
    return max(-(-micros // 1000), watermark + 1)


def stream_fold(stream: DataFrame, delay: str = "1 hour", seconds: float = 1.0) -> DataFrame:
    """watcher, start, path, event_type of a stream of events (watcher, path, ts, event_id, event_type), session by session.

    start: the time of the session's first event that is still pending or set its timer.  Folder events (is_directory) don't
    count.  Events later than the delay are lost, as the watermark says.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    e = stream.where("not coalesce(is_directory, false)") if "is_directory" in stream.columns else stream
    e = e.select("watcher", "path", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"), "event_type").withWatermark("ts", delay)
    return e.groupBy("watcher").transformWithStateInPandas(Debounce(seconds), FOLDED, "Append", "EventTime")


def apply_changes(index: DataFrame, changes: DataFrame, chunks: DataFrame) -> DataFrame:
    """index and chunks by source: changed and deleted sources leave, chunks of created and modified ones come in."""
    gone = index.join(changes.select(F.col("path").alias("source")), "source", "left_anti")
    fresh = chunks.join(changes.where("event_type <> 'deleted'").select(F.col("path").alias("source")), "source", "left_semi")
    return gone.unionByName(fresh)


def resolve(path: Column) -> Column:
    """An absolute path without empty, `.` and `..` steps."""
    start = F.array().cast("array<string>")
    up = lambda acc: F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
    parts = F.aggregate(F.split(path, "/"), start, lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", up(acc)).otherwise(F.concat(acc, F.array(x))))
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def accepted(path: Column, types: list[str], dirs: list[str]) -> Column:
    """Whether a watcher looks at a path: no part of it is an excluded folder, and its type is listed (if any is)."""
    ok = ~excluded(path, dirs) if dirs else F.lit(True)
    return ok & extension(path).isin(types) if types else ok


def watched(raw: DataFrame, types: list[str], dirs: list[str]) -> DataFrame:
    """Raw events (path, event_type, ...) that count: created, modified and deleted (moves aren't handled), paths resolved."""
    out = raw.where(F.col("event_type").isin("created", "modified", "deleted")).withColumn("path", resolve(F.col("path")))
    return out.where(accepted(F.col("path"), types, dirs))


class Listing(DataSource):
    """What changed below a folder between two listings: created, modified and deleted files, as a stream.

    Options: root, and state, a shared folder for the listings.  An offset is the number of a kept listing, so that a batch
    that is repeated after a failure finds the same changes.  A listing that holds what the last one held makes no batch.
    """

    #: Changes that one task gives out.
    PART = 10_000

    @classmethod
    def name(cls) -> str:
        return "file_changes"

    def schema(self) -> str:
        return "watcher string, path string, ts timestamp, event_id long, event_type string"

    def streamReader(self, schema):
        return _ListingReader(dict(self.options))


class _ListingReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        from pyarrow import fs

        self.root = options["root"]
        self.files, self.base = fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)
        self.store, self.kept = fs.FileSystem.from_uri(options["state"]) if "://" in options["state"] else (fs.LocalFileSystem(), options["state"])

    def _held(self, n: int) -> dict[str, list]:
        if n <= 0:
            return {}
        with self.store.open_input_stream(f"{self.kept}/{n:012d}.json") as f:
            return json.loads(f.read())["files"]

    def _last(self) -> int:
        from pyarrow import fs

        found = self.store.get_file_info(fs.FileSelector(self.kept, allow_not_found=True))
        return max([int(f.base_name.split(".")[0]) for f in found if re.fullmatch(r"\d+\.json", f.base_name)], default=0)

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        every = self.files.get_file_info(fs.FileSelector(self.base, recursive=True, allow_not_found=True))
        now = {f.path: [f.mtime_ns, f.size] for f in every if f.is_file}
        n = self._last()
        if now != self._held(n):
            n += 1
            self.store.create_dir(self.kept, recursive=True)
            with self.store.open_output_stream(f"{self.kept}/{n:012d}.part") as f:
                f.write(json.dumps({"at": time.time_ns(), "files": now}).encode())
            self.store.move(f"{self.kept}/{n:012d}.part", f"{self.kept}/{n:012d}.json")
        return {"listing": n}

    def partitions(self, start: dict, end: dict) -> list:
        old, new = self._held(start["listing"]), self._held(end["listing"])
        if not end["listing"]:
            return []
        with self.store.open_input_stream(f"{self.kept}/{end['listing']:012d}.json") as f:
            at = json.loads(f.read())["at"]
        rows = [(p, x[0], "created" if p not in old else "modified") for p, x in sorted(new.items()) if old.get(p) != x]
        rows += [(p, at, "deleted") for p in sorted(old) if p not in new]
        rows = [(self.root, p, ns, end["listing"] * 10**9 + i, kind) for i, (p, ns, kind) in enumerate(rows)]
        return [_Changes(rows[i : i + Listing.PART]) for i in range(0, len(rows), Listing.PART)]

    def read(self, partition):
        for root, path, ns, n, kind in partition.rows:
            yield root, path, datetime.fromtimestamp(ns / 1e9, timezone.utc), n, kind


class _Changes(InputPartition):
    def __init__(self, rows: list[tuple]):
        self.rows = rows


def files_stream(spark: SparkSession, root: str, types: list[str], dirs: list[str], state: str | None = None) -> DataFrame:
    """A stream of the created, modified and deleted files below root (watcher, path, ts, event_id, event_type).

    state: a shared folder that keeps the listings of this stream; a fresh one starts with every file as created.
    """
    spark.dataSource.register(Listing)
    f = spark.readStream.format("file_changes").option("root", root).option("state", state or scratch(spark).removeprefix("file:")).load()
    return f.where(accepted(F.col("path"), types, dirs))


class Watcher:
    """One stream that is started once and stopped."""

    def __init__(self, start):
        self._start, self._query = start, None

    @property
    def running(self) -> bool:
        return self._query is not None and self._query.isActive

    def start(self) -> bool:
        if self.running:
            return False
        self._query = self._start()
        return True

    def stop(self) -> bool:
        was = self.running
        if was:
            self._query.stop()
        self._query = None
        return was
