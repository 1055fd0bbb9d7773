import itertools
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sextant.functions import scoring, text
from sextant.operators import chunking, context, filters, graph, lexical, storage, vector
from sextant.sources import files
from sextant.streaming import events


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rrf_overlap_and_weights(spark):
    ddl = "query_id int, doc_id string, rank int, score double"
    v = spark.createDataFrame([(1, "a", 1, 0.1), (1, "b", 2, 0.2), (1, "c", 3, 0.3)], ddl)
    b = spark.createDataFrame([(1, "b", 1, 9.0), (1, "d", 2, 5.0), (1, "a", 3, 1.0)], ddl)
    out = scoring.rrf(v, b).orderBy("rank").collect()
    assert len(out) == 4 and {out[0].doc_id, out[1].doc_id} == {"a", "b"}
    assert out[0].score == pytest.approx(0.5 / 62 + 0.5 / 61, abs=1e-6)
    assert scoring.rrf(v, b, alpha=0.9, beta=0.1).where("rank = 1").first().doc_id == "a"
    assert scoring.rrf(v.limit(0), b.limit(0)).count() == 0


def test_normalisers(spark):
    df = spark.createDataFrame([(1, 1.0, 1), (1, 3.0, 2), (1, 2.0, 3), (2, 5.0, 1)], "query_id int, score double, rank int")
    assert rows(scoring.min_max(df), "query_id", "norm") == [(1, 0.0), (1, 0.5), (1, 1.0), (2, 1.0)]
    assert rows(scoring.rank_norm(df), "query_id", "norm") == [(1, 0.0), (1, 0.5), (1, 1.0), (2, 1.0)]
    d = spark.createDataFrame([(0.0,), (1.0,), (-0.5,), (None,), (100.0,)], "d double").select(scoring.distance_to_score(F.col("d")).alias("s"))
    assert [r.s for r in d.collect()][:4] == [1.0, 0.5, 1.0, 0.0]


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "red apple pie"), (2, "green pear"), (3, None)], "doc_id int, text string")
    q = spark.createDataFrame([(1, "apple apple"), (2, "zebra")], "query_id int, text string")
    got = lexical.bm25(q, docs, 2, pad=True).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id) for r in got] == [(1, 1), (1, 2), (2, 1), (2, 2)] and got[1].score == 0
    avg = 5 / 3
    want = 2 * math.log(1 + 2.5 / 1.5) * 1 / (1 + 1.5 * (0.25 + 0.75 * 3 / avg))
    assert got[0].score == pytest.approx(want, abs=1e-6)
    assert lexical.bm25(q, docs, 0).count() == 0
    old = spark.createDataFrame([("a", 0, "x"), ("b", 1, "y")], "doc_id string, pos int, text string")
    new = spark.createDataFrame([("b", 0, "z"), ("c", 1, "w")], "doc_id string, pos int, text string")
    assert rows(lexical.upsert(old, new), "doc_id", "pos", "text") == [("a", 0, "x"), ("b", 1, "z"), ("c", 3, "w")]


def test_knn_blocks(spark):
    v = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(20)] + [(99, None)], "doc_id int, v array<double>")
    q = v.where("doc_id < 3").select(F.col("doc_id").alias("query_id"), "v")
    old, vector.BLOCK = vector.BLOCK, 2
    try:
        assert [(r.query_id, r.doc_id) for r in vector.knn(q, v, 2).orderBy("query_id", "rank").collect()] == [(0, 0), (0, 1), (1, 1), (1, 0), (2, 2), (2, 1)]
    finally:
        vector.BLOCK = old


def test_filters(spark):
    df = spark.createDataFrame([(1, "ab", 5), (2, "bc", 7), (3, None, None)], "id int, s string, n int")
    ids = lambda spec: [r.id for r in df.where(filters.where(spec)).orderBy("id").collect()]
    assert ids({}) == [1, 2, 3] and ids({"s": "ab"}) == [1] and ids({"n": {"$gt": 5}}) == [2]
    assert ids({"s": {"$contains": "b"}, "n": {"$lte": 5}}) == [1] and ids({"n": {"$odd": 1}}) == [1, 2, 3]
    assert ids({"n": {"$gte": 5, "$contains": "7"}}) == [1, 2] and ids({"$or": [{"n": 5}, {"s": {"$in": ["bc"]}}]}) == [1, 2]


def test_context(spark):
    ddl = "query_id int, pos int, doc_id string, text string, score double, source string"
    df = spark.createDataFrame([(1, 1, "a", "x", 0.9, None), (1, 2, "b", "y", 0.8, None), (1, 3, "c", "x", 0.7, "s"), (1, 4, "d", "x", 0.95, "t")], ddl)
    assert rows(context.dedup_exact(df), "doc_id") == [("a",), ("b",)]
    assert rows(context.merge_consecutive(df), "doc_id", "text", "chunks_merged") == [("a", "x\ny", 2), ("c", "x", 1), ("d", "x", 1)]
    assert [r.doc_id for r in context.build(df, 2, merge=True).orderBy("rank").collect()] == ["a", "c"]
    twice = df.unionByName(df.withColumn("pos", F.col("pos") + 10).withColumn("score", F.lit(2.0)))
    assert rows(context.keep_best(twice), "doc_id", "score", "pos")[0] == ("a", 2.0, 1)


@settings(max_examples=60, deadline=None)
@given(st.text("ab\n", max_size=60), st.integers(1, 9), st.integers(0, 8))
def test_pieces(t, size, overlap):
    if overlap >= size:
        with pytest.raises(ValueError):
            chunking.guard(size, overlap)
        return
    parts = chunking.pieces(t, size, overlap)
    assert (parts[0][0], parts[-1][1]) == (0, len(t)) if t else not parts
    assert all(b[0] == a[0] + size - overlap and a[1] - a[0] == size for a, b in zip(parts, parts[1:]))


def test_chunkers(spark):
    cases = ["", "a" * 10, "x\ny", "l1\nl2\nl3\nl4\n", "é😀" * 7, "\n\n"]
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id int, text string")
    for size, overlap in ((3, 0), (4, 2), (100, 10)):
        got = rows(chunking.simple(docs, size, overlap), "doc_id", "chunk_index", "start", "end", "text")
        want = sorted(((i, j, s, e, t[s:e]) for i, t in enumerate(cases) for j, (s, e) in enumerate(chunking.pieces(t, size, overlap))), key=str)
        assert got == want
    got = rows(chunking.lines(docs, 2, 0), "doc_id", "chunk_index", "line_start", "line_end", "text")
    assert (3, 0, 1, 2, "l1\nl2\n") in got and (3, 1, 3, 4, "l3\nl4\n") in got and (2, 0, 1, 2, "x\ny") in got
    md = spark.createDataFrame([(1, "intro\n# A\ntext\n## B ##\n" + "z" * 60 + "\nSet\n===\nend")], "doc_id int, text string")
    got = chunking.markdown(md, 40, 10).collect()
    assert [r.heading for r in got][:1] == ["A"] and {r.heading for r in got} == {"A", "B", "Set"} and max(len(r.text) for r in got) <= 40


def test_code(spark):
    py = "import os.path as p\nfrom . import q\nfrom m.n import a, b\n\nclass C:\n    def f(self):\n        g()\n\ndef g():\n    print(1)\n    h.g()\n"
    docs = spark.createDataFrame([(1, py), (2, "def ("), (3, "x = 1"), (4, "  ")], "doc_id int, text string")
    assert rows(chunking.code(docs, "python").where("doc_id = 1"), "name", "type") == [("C", "class_definition"), ("f", "function_definition"), ("g", "function_definition")]
    assert rows(chunking.code(docs, "python").where("doc_id > 1"), "doc_id", "type") == [(2, "parse_error"), (3, "source_file")]
    assert rows(graph.imports(docs), "module", "alias", "level") == [("", None, 1), ("m.n", None, 0), ("os.path", "p", 0)]
    assert graph.module_dependencies(docs).collect()[0].modules == ["m"]
    edges = rows(graph.call_graph(docs).where("kind = 'edge'"), "name", "other")
    assert edges == [("f", "g"), ("g", "g")]
    ts = spark.createDataFrame([(1, "export function a() { if (1) { } }\nclass B { }\nconst c = (x) => { return x }")], "doc_id int, text string")
    assert [r.name for r in chunking.code(ts, "typescript").orderBy("chunk_index").collect()] == ["a", "B", "c"]
    go = spark.createDataFrame([(1, "func (r *T) M() { }\ntype T struct { a int }\nfunc f() { }")], "doc_id int, text string")
    assert [r.name for r in chunking.code(go, "go").orderBy("chunk_index").collect()] == ["M", "T", "f"]
    assert chunking.for_language(docs.where("doc_id = 3"), "go").count() == 1


def test_event_fold(spark):
    table = {(None, "created"): "created", (None, "modified"): "created", (None, "deleted"): "deleted", ("created", "created"): "created", ("created", "modified"): "modified", ("created", "deleted"): None, ("modified", "created"): "created", ("modified", "modified"): "modified", ("modified", "deleted"): "deleted", ("deleted", "created"): "created", ("deleted", "modified"): "created", ("deleted", "deleted"): "deleted"}
    kinds = ["created", "modified", "deleted"]
    data, want = [], {}
    for n in (1, 2, 3):
        for seq in itertools.product(kinds, repeat=n):
            state = None
            for i, k in enumerate(seq):
                data.append(("w", 0, "-".join(seq), len(data), i, k, False))
                state = table[state, k]
            if state:
                want["-".join(seq)] = state
    df = spark.createDataFrame(data, "watcher string, session long, path string, event_id int, ts int, event_type string, is_directory boolean")
    assert {r.path: r.event_type for r in events.coalesce_events(df).collect()} == want


def test_stream_equals_batch(spark, tmp_path):
    data = [("w", "p", 1, "2024-01-01 00:00:00", "created"), ("w", "p", 2, "2024-01-01 00:00:00.5", "modified"), ("w", "q", 3, "2024-01-01 00:00:00", "created"), ("w", "q", 4, "2024-01-01 00:00:00.4", "deleted"), ("w", "z", 5, "2024-01-02 00:00:00", "modified")]
    df = spark.createDataFrame(data, "watcher string, path string, event_id int, ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = events.stream_fold(s).writeStream.format("memory").queryName("folded").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.path, r.event_type) for r in spark.table("folded").collect()} == {("p", "modified")}


def test_storage_and_scan(spark, tmp_path):
    a = spark.createDataFrame([("s1", "h1"), ("s2", "h2"), ("s3", None)], "source string, content_hash string")
    b = spark.createDataFrame([("s2", "hx"), ("s3", None), ("s4", "h4")], "source string, content_hash string")
    assert rows(storage.sync_diff(a, b), "source", "change_type") == [("s1", "deleted"), ("s2", "modified"), ("s3", "unchanged"), ("s4", "added")]
    assert storage.delete(a, F.col("content_hash") == "h1").count() == 2
    assert rows(storage.update(a, b, "source"), "source", "content_hash") == [("s1", "h1"), ("s2", "hx"), ("s3", None)]
    assert storage.insert_absent(a, b, "source").count() == 4 and storage.delete_ids(a, b, "source").count() == 1
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_bytes("é = 1".encode())
    (tmp_path / "src/b.md").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "src/c.bin").write_bytes(b"1")
    (tmp_path / "node_modules/d.py").write_bytes(b"1")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.scan(spark, str(tmp_path)).collect()}
    assert got["a.py"].text == "é = 1" and got["b.md"].text == "café" and got["c.bin"].skip_reason == "type" and got["d.py"].skip_reason == "excluded"


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (4, 3)], "source long, target long")
    assert rows(graph.paths(e, 1, 4, 3), "path") == [([1, 2, 3, 4],), ([1, 3, 4],)]
    assert graph.shortest_path(e, 1, 4).first().path == [1, 3, 4] and graph.shortest_path(e, 4, 1).count() == 0
    s = graph.statistics(spark.createDataFrame([(1,), (9,)], "id long"), e).first()
    assert (s.nodes, s.edges, s.is_dag, s.components) == (5, 5, False, 4)


def test_rules(spark):
    p = spark.createDataFrame([("/data/a/b",), ("/data/../etc",), ("/etc/passwd",), ("/etcdata/x",)], "p string")
    ok = p.select(text.path_allowed(F.col("p"), [], ["/etc"]).alias("ok")).collect()
    assert [r.ok for r in ok] == [True, False, False, True]
    w = spark.createDataFrame([("Abcdefg1",), ("short",)], "p string").select(text.password_problems(F.col("p")).alias("x")).collect()
    assert [r.x for r in w] == [[], ["length", "upper", "digit"]]
