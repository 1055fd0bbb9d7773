"""Event folds with timers, the change source and the sink that applies a batch once."""

import os
import random

from pyspark.sql import functions as F

from sextant.operators.buckets import Buckets
from sextant.streaming import events

COLS = "watcher string, path string, ts long, event_id long, event_type string, is_directory boolean"


def replay(rows, gap):
    """One watcher after another as a timer would run: what is given out, with the session's first time."""
    out = []
    for w in {r[0] for r in rows}:
        pending, timer, start = {}, None, None
        for _, path, ts, _, kind, folder in sorted((r for r in rows if r[0] == w), key=lambda r: (r[2], r[3])):
            if folder:
                continue
            if timer is not None and ts > timer + gap:
                out += [(w, start, p, k) for p, k in pending.items()]
                pending, timer, start = {}, None, None
            if kind == "deleted" and pending.get(path) == "created":
                del pending[path]
                continue
            pending[path] = "deleted" if kind == "deleted" else "created" if pending.get(path) in (None, "deleted") else kind
            timer, start = ts, ts if start is None else start
        out += [(w, start, p, k) for p, k in pending.items()]
    return sorted(out)


def run(spark, tmp_path, rows, gap, name):
    """The fold of rows that come in several files in random order; a last event far away lets every timer run out."""
    rows = [*rows, ("end", "x", 10**6, 10**9, "modified", False)]
    for i in range(3):
        part = spark.createDataFrame(rows[i::3], COLS).withColumn("ts", F.timestamp_seconds("ts"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = events.stream_fold(s, "20 days", gap).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(300) is not False
    q.stop()
    return sorted((r.watcher, int(r.start.timestamp()), r.path, r.event_type) for r in spark.table(name).collect() if r.watcher != "end")


def test_random_orders(spark, tmp_path):
    r = random.Random(7)
    rows = [(f"w{r.randrange(2)}", f"p{r.randrange(5)}", r.randrange(400), i, r.choice(["created", "modified", "deleted"]), r.random() < 0.15) for i in range(120)]
    rows += [(w, "far", 4 * 10**6, 10**6 + i, "modified", False) for i, w in enumerate(("w0", "w1"))]
    want = [x for x in replay(rows, 9) if x[2] != "far"]
    r.shuffle(rows)
    got = [x for x in run(spark, tmp_path, rows, 9, "random_orders") if x[2] != "far"]
    assert got == want and len(want) > 20


def test_folder_events_do_not_prolong(spark):
    rows = [("w", "a", 0, 1, "created", False), ("w", "d", 20, 2, "modified", True), ("w", "a", 40, 3, "deleted", False)]
    df = spark.createDataFrame(rows, COLS).withColumn("ts", F.timestamp_seconds("ts"))
    out = events.coalesce_events(events.debounce(df, 30)).collect()
    assert sorted((r.session, r.event_type) for r in out) == [(0, "created"), (1, "deleted")]
    assert replay(rows, 30) == [("w", 0, "a", "created"), ("w", 40, "a", "deleted")]


def test_change_source_and_sink(spark, tmp_path):
    """Files that come, change and go between triggers reach the index once each, also where a batch is given again."""
    root, where = tmp_path / "src", str(tmp_path / "index")
    root.mkdir()

    def load(changes):
        rows = []
        for x in changes.where("event_type <> 'deleted'").select("path").distinct().collect():
            if os.path.exists(x.path):
                text = open(x.path).read()
                rows += [(x.path, str(hash(text)), i, line) for i, line in enumerate(text.split("\n"))]
        return spark.createDataFrame(rows, "path string, content_hash string, n int, text string")

    held = Buckets(spark, where, "path")
    held.create(spark.createDataFrame([], "path string, content_hash string, n int, text string"), 8)
    given = []
    sink = held.sink(load)

    def step():
        s = events.files_stream(spark, str(root), ["py"], ["skip"], str(tmp_path / "state"))
        q = s.writeStream.foreachBatch(lambda df, n: (given.append((n, sorted((os.path.basename(r.path), r.event_type) for r in df.collect()))), sink(df, n))[0]).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        q.stop()
        return sorted((os.path.basename(r.path), r.n, r.text) for r in held.read().collect())

    (root / "a.py").write_text("1\n2")
    (root / "b.py").write_text("x")
    (root / "c.txt").write_text("no")
    assert step() == [("a.py", 0, "1"), ("a.py", 1, "2"), ("b.py", 0, "x")]
    (root / "a.py").write_text("1\n2\n3 and more")
    (root / "b.py").unlink()
    (root / "d.py").write_text("y")
    want = [("a.py", 0, "1"), ("a.py", 1, "2"), ("a.py", 2, "3 and more"), ("d.py", 0, "y")]
    assert step() == want and step() == want
    kinds = [k for _, ks in given for k in ks]
    assert kinds == [("a.py", "created"), ("b.py", "created"), ("a.py", "modified"), ("b.py", "deleted"), ("d.py", "created")]
    assert held.ledger().counts == {"added": 1, "modified": 1, "deleted": 1, "unchanged": 0, "chunks_removed": 3, "chunks_added": 4}
    before = held.ledger()
    again = spark.createDataFrame([(str(root / "a.py"), "deleted")], "path string, event_type string")
    sink(again, given[-1][0])  # the number was applied
    assert held.ledger() == before and len(held.read().collect()) == 4
    assert held.vacuum() >= 1 and len(held.read().collect()) == 4


def test_writes_touch_their_buckets(spark, tmp_path):
    held = Buckets(spark, str(tmp_path / "t"))
    rows = spark.range(1000).selectExpr("id", "cast(id as string) as text", "null as other").withColumn("other", F.lit("o"))
    held.create(rows, 32)
    first = held.ledger()
    some = spark.createDataFrame([(3, "three", None), (5000, "new", "n")], "id long, text string, other string")
    second = held.upsert(some)
    changed = {b for b in second.folders if second.folders[b] != first.folders.get(b)}
    assert 1 <= len(changed) <= 2 and held.read().count() == 1001
    assert held.read().where("id = 3").first().other is None
    held.update(spark.createDataFrame([(4, None, "p"), (7000, "no", "no")], "id long, text string, other string"))
    assert (lambda r: (r.text, r.other))(held.read().where("id = 4").first()) == ("4", "p") and held.read().count() == 1001
    held.delete(spark.createDataFrame([(3,), (4,)], "id long"))
    assert held.read().count() == 999 and held.read(first).count() == 1000
    last = held.ledger()
    assert held.upsert(some, "s:1").number == last.number + 1 and held.upsert(some, "s:1").number == last.number + 1 == held.upsert(some, "s:0").number
    try:
        held._commit(last)
        raise AssertionError
    except RuntimeError as e:
        assert "another writer" in str(e)


def test_sync(spark, tmp_path):
    shape = "source string, content_hash string, n int"
    held = Buckets(spark, str(tmp_path / "t"), "source")
    held.create(spark.createDataFrame([("/r/a", "1", 0), ("/r/a", "1", 1), ("/r/b", "2", 0), ("/q/c", "3", 0)], shape), 4)
    scan = spark.createDataFrame([("/r/a", "9", 0), ("/r/d", "4", 0), ("/r/d", "4", 1)], shape)
    out = held.sync(scan, "/r")
    assert sorted((r.source, r.content_hash, r.n) for r in held.read().collect()) == [("/q/c", "3", 0), ("/r/a", "9", 0), ("/r/d", "4", 0), ("/r/d", "4", 1)]
    assert out.counts == {"added": 1, "modified": 1, "deleted": 1, "unchanged": 0, "chunks_removed": 3, "chunks_added": 3}
    assert held.sync(scan, "/r").folders == out.folders
    held.sync(scan)
    assert held.read().where("source = '/q/c'").count() == 0
