import hashlib
import hmac

from pyspark.sql import functions as F

from sextant.operators import metadata, report
from sextant.streaming import webhook


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_webhook_signature(spark):
    bodies = ["", '{"a": 1}', "é" * 100]
    for secret in ("k", "long secret " * 9):
        sign = lambda b: "sha256=" + hmac.new(secret.encode(), b.encode(), hashlib.sha256).hexdigest()
        df = spark.createDataFrame([(b, sign(b), True) for b in bodies] + [("x", sign("y"), False), ("x", None, False), (None, sign(""), False)], "b string, s string, want boolean")
        assert all(r.ok == r.want for r in df.select("want", webhook.verified(F.col("b"), F.col("s"), secret).alias("ok")).collect())


def test_webhook_push(spark):
    df = spark.createDataFrame([('{"ref": "refs/heads/x/y", "commits": [{"added": ["b", "a"]}, {"removed": ["b"], "modified": null}]}',), ('{"ref": "v1"}',), ("no json",)], "b string")
    got = df.withColumn("p", webhook.push(F.col("b"))).select(webhook.branch(F.col("p.ref")).alias("branch"), webhook.changed_files(F.col("p")).alias("files")).collect()
    assert [(r.branch, r.files) for r in got] == [("x/y", ["a", "b"]), ("v1", []), (None, [])]
    kinds = spark.createDataFrame([("release",), ("star",), (None,)], "e string").select(webhook.event_kind(F.col("e")).alias("k")).collect()
    assert [r.k for r in kinds] == ["release", "push", "push"]


def test_reports(spark):
    ddl = "config string, latency double, score double, rerank_score double"
    df = spark.createDataFrame([("a", 2.0, 1.0, None), ("a", 4.0, 1.0, 0.5), ("b", 1.0, None, None)], ddl)
    assert rows(report.benchmark_report(df), "config", "results", "avg_score", "avg_latency", "latency_rank", "fastest") == [("a", 2, 0.75, 3.0, 1.0, False), ("b", 1, None, 1.0, 0.0, True)]
    assert report.benchmark_report(df.limit(0)).count() == 0
    tasks = spark.createDataFrame([("pending", None), ("running", None), ("completed", "2024-01-02 23:59:00"), ("completed", "2024-01-03 00:00:00"), (None, None)], "status string, finished string")
    assert rows(report.task_counts(tasks, F.lit("2024-01-02").cast("date")), "active", "completed_today", "total") == [(2, 1, 5)]
    changes = spark.createDataFrame([("a", "added"), ("m", "modified"), ("d", "deleted"), ("u", "unchanged")], "source string, change_type string")
    old = spark.createDataFrame([("m",), ("d",), ("d",), ("u",)], "source string")
    new = spark.createDataFrame([("a",), ("m",), ("m",), ("u",)], "source string")
    assert rows(report.change_counters(changes, old, new), "files_added", "files_updated", "files_deleted", "chunks_added", "chunks_removed") == [(1, 1, 1, 3, 3)]
    index = spark.createDataFrame([("s", 0, "x"), ("s", 1, "y")], "source string, seq int, content_hash string")
    seen = spark.createDataFrame([("s", "x"), ("t", "x"), ("n", None)], "source string, content_hash string")
    assert rows(report.indexed_hashes(index), "source", "content_hash") == [("s", "y")]
    assert rows(report.content_changed(index, seen), "source", "changed") == [("n", True), ("s", False), ("t", True)]


def test_metadata(spark):
    df = spark.createDataFrame([({"doc_id": "own", "x": "1"},), ({"x": "1"},), (None,)], "m map<string,string>")
    got = df.select(metadata.with_doc_id(F.lit(7), F.col("m")).alias("m")).collect()
    assert [r.m for r in got] == [{"doc_id": "own", "x": "1"}, {"doc_id": "7", "x": "1"}, {"doc_id": "7"}]
    names = spark.createDataFrame([("ok_1-x",), ("  ",), ("a b",), ("n" * 129,), (None,)], "n string").select(metadata.name_problem(F.col("n")).alias("p")).collect()
    assert [r.p for r in names] == [None, "empty", "characters", "length", "empty"]
    texts = spark.createDataFrame([("x",), ("\n\t ",), ("xxxx",), (None,)], "t string").select(metadata.text_problem(F.col("t"), 3).alias("p")).collect()
    assert [r.p for r in texts] == [None, "blank", "length", "missing"]
    assert [metadata.depth_problem(x, 2) for x in ({"a": [1, None]}, {"a": {"b": {"c": 1}}}, {1: 2}, {"a": {1}})] == [None, "depth", "key", "type"]
    spans = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (2, 0, 5)], "doc_id int, start int, end int")
    found = spark.createDataFrame([(1, 4, "b"), (1, 2, "a"), (1, 9, "c"), (3, 0, "d")], "doc_id int, pos int, name string")
    assert rows(metadata.first_within(spans, found), "doc_id", "start", "name") == [(1, 0, "a"), (1, 5, None), (2, 0, None)]


def test_filters_and_scan_edges(spark, tmp_path):
    import pytest

    from sextant.operators import filters
    from sextant.sources import files

    df = spark.createDataFrame([(1, "a b"), (2, None)], "id int, text string")
    assert df.where(filters.where({"$and": []})).count() == 2 and df.where(filters.where({"$or": [], "id": 1})).count() == 1
    assert df.where(filters.delete_condition(document={"$contains": "a"})).count() == 1
    for both in ((None, None), ({"id": 1}, {"$contains": "a"})):
        with pytest.raises(ValueError):
            filters.delete_condition(*both)
    assert files.scan(spark, str(tmp_path / "missing")).count() == 0
    (tmp_path / "x.py").write_text("a")
    assert files.scan(spark, str(tmp_path)).columns == files.scan(spark, str(tmp_path / "missing")).columns



def test_merged_spans(spark):
    """A merged row spans its neighbours, 0 standing for null; a row on its own keeps what it has."""
    from sextant.operators import context

    ddl = "query_id int, pos int, doc_id string, text string, score double, source string, start int, end int"
    df = spark.createDataFrame([(1, 1, "a", "x", 0.9, "s", None, 5), (1, 2, "b", None, 0.8, "s", 5, None), (1, 3, "c", "z", 0.7, "t", None, None), (1, 4, "d", "x", 0.6, "s", 7, 9), (2, 1, "e", "x", 0.5, None, 1, 2), (2, 2, "f", "y", 0.4, None, 3, 8)], ddl)
    assert rows(context.merge_consecutive(df), "doc_id", "chunks_merged", "start", "end") == [("a", 2, 0, 0), ("c", 1, None, None), ("d", 1, 7, 9), ("e", 2, 1, 8)]
    assert "start" not in context.merge_consecutive(df.drop("start")).columns
    assert context.merge_consecutive(df.limit(0)).count() == 0


def test_index_errors_progress_and_estimates(spark):
    from sextant.operators import chunking

    files = spark.createDataFrame([("a", None, None), ("b", "size", None), ("c", None, "unreadable"), ("d", "type", "unreadable")], "path string, skip_reason string, error string")
    chunks = spark.createDataFrame([(1,), (2,)], "chunk int")
    assert report.index_counters(files, chunks).first().asDict() == {"files_indexed": 1, "files_skipped": 1, "errors": 2, "chunks_created": 2}
    assert report.index_counters(files.drop("error"), chunks).first().asDict() == {"files_indexed": 2, "files_skipped": 2, "chunks_created": 2}
    assert report.index_counters(files.limit(0), chunks.limit(0)).first().asDict() == {"files_indexed": 0, "files_skipped": 0, "errors": 0, "chunks_created": 0}
    df = spark.createDataFrame([("g", 1), ("g", 2), ("g", 3), ("h", 1)], "g string, i int")
    assert [(r.g, r.i, round(r.progress, 3)) for r in report.progress_ratio(df, "g", "i").orderBy("g", "i").collect()] == [("g", 1, 0.333), ("g", 2, 0.667), ("g", 3, 1.0), ("h", 1, 1.0)]
    docs = spark.createDataFrame([("s", 1200), ("s", 0), ("s", None), (None, 499)], "source string, n_chars long")
    assert rows(chunking.estimated(docs, "source"), "source", "chunks") == [("s", 4), (None, 1)]
    assert rows(chunking.estimated(docs, "source", F.col("n_chars") * 2, 100), "source", "chunks") == [("s", 26), (None, 9)]
