import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant import config
from sextant.functions.source import brace_calls
from sextant.operators import blockmax, chunking, govern, graph, lexical, metadata, storage, vector
from sextant.plans import providers, search
from sextant.sources import files
from sextant.streaming import events, webhook

TS = """// function no() {}
export function top(a: number): number {
  helper(a); return obj.helper("x(");
}
function helper(x) { const f = () => top(x); }
abstract class Base { run() { helper(1); } }
class A extends Base {
  constructor(private x: X) { helper(2); }
  async go<T>(a: T): Promise<T> { if (a) { this.go(a); new A(1); helper(a) } return a; }
  prop = helper(3);
}
const e = function inner() { helper(4) };
"""
GO = """package main
type T struct { a int }
func Top(a int) (int, error) {
	go helper(a)
	x := map[string]interface{}{}
	t.Method(1)
}
func helper(a interface{}) interface{} { return Top(1) }
func (t *T) Method(a int) { helper(a) }
"""


def test_brace_languages(spark):
    got = list(brace_calls(TS, "typescript"))
    assert [r[1:3] for r in got if r[0] == "node"] == [("top", "function"), ("helper", "function"), ("A", "class"), ("A.constructor", "method"), ("A.go", "method")]
    assert [r[1:] for r in got if r[0] == "edge"] == [("top", "helper", 3), ("top", "helper", 3), ("helper", "top", 5), ("constructor", "helper", 8), ("go", "helper", 9)]
    got = list(brace_calls(GO, "go"))
    assert [r[1:3] for r in got if r[0] == "node"] == [("Top", "function"), ("helper", "function"), ("receiver.Method", "method")]
    assert [r[1:] for r in got if r[0] == "edge"] == [("Top", "helper", 4), ("helper", "Top", 8), ("Method", "helper", 9)]
    for broken in ("", "}}}", "function (", "class A {", "func (", "function f() { f("):
        list(brace_calls(broken, "typescript")), list(brace_calls(broken, "go"))
    docs = spark.createDataFrame([(1, TS, "TSX"), (2, GO, "golang"), (3, "def f(): f()", "py"), (4, "x", "rust"), (5, None, "go")], "doc_id int, text string, language string")
    nodes, edges = graph.graph_tables(graph.call_graph(docs, F.col("language")))
    assert sorted((r.doc_id, r.id) for r in nodes.collect() if r.doc_id > 1) == [(2, "Top"), (2, "helper"), (2, "receiver.Method"), (3, "f")]
    assert [(r.source, r.target) for r in edges.where("doc_id = 3").collect()] == [("f", "f")]


def test_components_and_paths(spark, tmp_path):
    rng = random.Random(5)
    pairs = [(rng.randrange(14), rng.randrange(14)) for _ in range(20)]
    reach = {(a, b) for a, b in pairs}
    for _ in range(5):
        reach |= {(a, d) for a, b in reach for c, d in reach if b == c}
    want = {i: max([j for j in range(15) if (i, j) in reach and (j, i) in reach] + [i]) for i in range(15)}
    e = spark.createDataFrame([(*p, "calls") for p in pairs], "source long, target long, edge_type string")
    n = spark.range(15)
    assert {r.id: r.component for r in graph.components(n, e).collect()} == want
    s = graph.statistics(n, e)
    files.save_graph(str(tmp_path / "g"), n, e, s)
    nodes, edges = files.load_graph_folders(spark, str(tmp_path / "g"), "id long", "source long, target long, edge_type string")
    assert nodes.count() == 15 and edges.exceptAll(e).count() == 0
    chain = graph.add_edges(e.limit(0), e, merge=True)
    assert chain.count() == len(set(pairs))


def test_knn_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    q, v = rng.normal(size=(7, 5)), np.vstack([rng.normal(size=(40, 5)) * 1000, np.zeros((2, 5))])
    frame = lambda rows, name: spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)] + [(999, None)], f"{name} long, v array<double>")
    for metric in ("l2", "cosine"):
        d = ((q[:, None] - v[None]) ** 2).sum(2) if metric == "l2" else 1 - (q @ v.T) / np.maximum(np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None], 1e-300)
        want = [(i, int(j)) for i in range(7) for j in np.lexsort((np.arange(42), d[i].round(10)))[:3]]
        for block in (4096, 3):
            monkeypatch.setattr(vector, "BLOCK", block)
            monkeypatch.setattr(vector, "PART", 16)
            got = vector.knn(frame(q, "query_id"), frame(v, "doc_id"), 3, metric).orderBy("query_id", "rank").collect()
            assert [(r.query_id, r.doc_id) for r in got] == want
            assert vector.knn(frame(q[:0], "query_id"), frame(v, "doc_id"), 3, metric).count() == 0
            assert vector.knn(frame(q, "query_id"), frame(v[:0], "doc_id"), 3, metric).count() == 0


def test_index_kept(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "red fox red"), (2, "blue fox"), (3, None), (4, "")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "red foxes"), (2, "nothing"), (3, "blue fox fox"), (4, None)], "query_id long, text string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(lexical.bm25(q, docs, 3))
    assert [(r[0], r[1], r[2]) for r in want] == [(i, k + 1, d) for i, ds in ((1, (1, 2, 3)), (2, (1, 2, 3)), (3, (2, 1, 3)), (4, (1, 2, 3))) for k, d in enumerate(ds)]
    assert len(rows(lexical.bm25(q, docs, 9))) == 16 and len(rows(lexical.bm25(q, docs, 3, pad=False))) == 3
    path = str(tmp_path / "ix" / "a")
    lexical.save(lexical.build(docs), path)
    assert rows(lexical.search(q, lexical.load(spark, path), 3)) == want
    monkeypatch.setattr(blockmax, "WEIGHTS", 1)  # a part for each term of the queries
    assert rows(lexical.search(q, lexical.load(spark, path), 3)) == want == rows(lexical.bm25(q, docs, 3))
    assert lexical.saved(spark, str(tmp_path / "ix")) == ["a"] and lexical.delete(spark, path) and not lexical.delete(spark, path)
    assert lexical.saved(spark, str(tmp_path / "none")) == []


def test_providers_and_settings(tmp_path):
    assert providers.get("embedding", "hash", dim=8) is providers.get("embedding", "hash", dim=8) is not providers.get("embedding", "hash", dim=4)
    assert providers.key("llm", "x", {"a": 1, "b": 2}) == providers.key("llm", "x", {"b": 2, "a": 1})
    with pytest.raises(ValueError, match="hash"):
        providers.get("embedding", "other")
    with pytest.raises(ValueError):
        providers.register("sound", "x")
    assert config.merge({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 9}, "d": {"e": 1}}) == {"a": {"b": 9, "c": 2}, "d": {"e": 1}} and config.merge({"a": 1}, None) == {"a": 1}
    (tmp_path / "s.json").write_text(json.dumps({"chunking": {"size": 9}}))
    assert config.load(str(tmp_path / "s.json"))["chunking"] == {**config.DEFAULTS["chunking"], "size": 9}
    assert chunking.supports("markdown", "MD") and chunking.supports("simple", "x") and not chunking.supports("code", "rust")


def test_collections(spark, tmp_path):
    c = storage.Collections(spark, f"t{abs(hash(str(tmp_path)))}_")
    try:
        c.create("a", "id long, text string")
        with pytest.raises(ValueError):
            c.create("a", "id long")
        with pytest.raises(ValueError):
            c.read("b")
        c.add("a", spark.createDataFrame([(1, "x")], "id long, text string"))
        assert c.names() == ["a"] and c.exists("a") and c.read("a").count() == 1 and not c.drop("b")
    finally:
        assert c.reset() == 1 and c.names() == []
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id long, k string")
    assert [r.id for r in storage.get(df, spark.range(5), F.col("k") == "b", limit=1, offset=1).collect()] == [3]
    ids = df.select(storage.surrogate_id("id", "k").alias("i"))
    assert sorted(ids.collect()) == sorted(ids.collect()) and ids.distinct().count() == 3


def test_pipelines(spark):
    docs = spark.createDataFrame([(1, "red fox", "s"), (2, "blue fox", "s"), (3, "green hen", None)], "doc_id long, text string, source string")
    q = spark.createDataFrame([(1, "green fox", [1.0, 0.0]), (2, " ", [0.0, 1.0])], "query_id long, text string, v array<double>")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.7, 0.7])], "doc_id long, v array<double>")
    for bad in ({"type": "x"}, {"retriever": {"type": "x"}}, {"rerank_config": {"type": "x"}}):
        with pytest.raises(ValueError):
            search.configured(bad)
    got = search.configured({"retriever": {"type": "vector"}, "rerank_config": {"type": "none"}, "topK": 2})(q, docs, v)
    assert [r.doc_id for r in got.where("query_id = 1").orderBy("rank").collect()] == [1, 3]
    by_length = search.configured({"rerank_config": {"type": "model", "score": lambda q, d: [len(x) for x in d]}})(q, docs, v, 1)
    assert [r.doc_id for r in by_length.where("query_id = 1").collect()] == [3]
    assert {r.query_id for r in search.query_tool(q, docs, v, "odd", 0).collect()} == {1}
    for k in (0, 101):
        with pytest.raises(ValueError):
            search.endpoint(q, docs, v, top_k=k)

    def broken(found, queries, k=None):
        raise RuntimeError

    found = spark.createDataFrame([(1, 1, 5), (1, 2, 6)], "query_id long, rank int, doc_id long")
    assert search.with_fallback(broken)(found, q, 1).count() == 1
    assert search.or_empty(lambda: spark.read.parquet("/tmp/none-such-table"), "query_id long", spark).count() == 0
    with pytest.raises(ValueError):
        search.or_empty(lambda: storage.Collections(spark).read("none"), "query_id long", spark)
    near = search.index_search(q.select("query_id", "text"), docs, providers.get("embedding", "hash", dim=32), 1).where("query_id = 1")
    assert near.columns == ["query_id", "rank", "doc_id", "distance", "document", "source"]


def test_events_and_rest(spark, tmp_path):
    raw = [("w", "/a", 0, 1, "created"), ("w", "/b", 1, 2, "modified"), ("w", "/a", 2, 3, "deleted"), ("w", "/b", 9, 4, "deleted"), ("x", "/a", 3, 5, "modified")]
    rows = spark.createDataFrame([(w, p, f"2024-01-01 00:00:0{s}", i, k) for w, p, s, i, k in raw], "watcher string, path string, ts string, event_id int, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted((r.event_id, r.session) for r in events.debounce(rows, 2).collect()) == [(1, 0), (2, 0), (3, 0), (4, 1), (5, 0)]
    late = spark.createDataFrame([("z", "/z", "2024-01-02", 9, "modified")], "watcher string, path string, ts string, event_id int, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.unionByName(late).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = events.stream_fold(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "1 hour", 2)
    w = events.Watcher(lambda: s.writeStream.format("memory").queryName("per_watcher").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    assert w.start()
    w._query.awaitTermination(60)
    assert not w.running and not w.stop()
    # /a of w is created and deleted within one session of its watcher, although /b comes between.
    assert sorted((r.watcher, r.path, r.event_type) for r in spark.table("per_watcher").collect()) == [("w", "/b", "created"), ("w", "/b", "deleted"), ("x", "/a", "created")]
    paths = spark.createDataFrame([("/a/../b//./c.PY",), ("/../x.md",), ("/node_modules/a.py",)], "p string")
    assert [r[0] for r in paths.select(events.resolve(F.col("p"))).collect()] == ["/b/c.PY", "/x.md", "/node_modules/a.py"]
    assert [r[0] for r in paths.select(events.accepted(F.col("p"), ["py"], ["node_modules"])).collect()] == [True, False, False]
    assert [r[0] for r in paths.select(events.accepted(F.col("p"), [], [])).collect()] == [True] * 3
    webhook.HANDLERS.clear()
    webhook.on("push")(lambda df: df.withColumn("n", F.lit(1)))
    assert {k: v.count() for k, v in webhook.dispatch(spark.createDataFrame([("push",), ("star",)], "kind string")).items()} == {"push": 1}
    out = govern.generate(spark.createDataFrame([(1, "hi")], "conv_id long, prompt string"), lambda ps: [p.upper() for p in ps]).first()
    assert out.answer == "HI" and list(govern.pieces("x")) == ["x"]
    df = spark.createDataFrame([(1, None, "2024-01-01")], "a int, b string, c string").withColumn("c", F.col("c").cast("date"))
    assert json.loads(df.select(metadata.sanitised(df, "a", "b", "c")).first()[0]) == {"a": 1, "b": None, "c": "2024-01-01"}
