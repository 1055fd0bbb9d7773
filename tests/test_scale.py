"""Plans that must hold at other sizes: long chains, pages, many names, deep metadata."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sextant.operators import graph, metadata, storage


def test_long_chains_take_few_rounds(spark, monkeypatch):
    n, rounds = 240, []
    chain = [(i, i + 1) for i in range(n - 1)]
    ring = [(5000 + i, 5000 + (i + 1) % 60) for i in range(60)]
    other = [(n - 1, 5000), (5000, 7000), (7000, 7001), (7001, 7000)]
    edges = spark.createDataFrame(chain + ring + other, "source long, target long")
    nodes = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    between = graph._between
    monkeypatch.setattr(graph, "_between", lambda *a: (rounds.append(1), between(*a))[1])
    got = {r.id: r.component for r in graph.components(nodes, edges).collect()}
    assert all(got[i] == i for i in range(n)) and {got[i] for i in range(5000, 5060)} == {5059} and got[7000] == got[7001] == 7001
    assert len(rounds) < 40  # one a round; a chain of 2,000 takes some 50, a round an edge would be 240 here


def test_paths_without_cutoff_and_known_nodes(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 3), (4, 2), (2, 9), (4, 5), (3, 3)], "source long, target long")
    got = sorted(r.path for r in graph.paths(e, 1, 5).collect())
    assert got == [[1, 2, 3, 4, 5], [1, 3, 4, 5]]
    assert [r.path for r in graph.paths(e, 1, 5, 3).collect()] == [[1, 3, 4, 5]] and graph.paths(e, 9, 1).count() == 0
    some = spark.createDataFrame([(1,), (4,), (5,)], "id long")
    assert sorted(r.path for r in graph.known(graph.paths(e, 1, 5), some).collect()) == [[1, 4, 5], [1, 4, 5]]
    assert graph.shortest_path(e, 1, 1).first().path == [1] and graph.shortest_path(e, 1, 5).first().path == [1, 3, 4, 5]
    r = random.Random(3)
    for _ in range(1):
        pairs = {(r.randrange(12), r.randrange(12)) for _ in range(20)}
        best, front = None, [[0]]
        while front and not best:
            best = min((p for p in front if p[-1] == 11), default=None)
            front = [p + [b] for p in front for a, b in sorted(pairs) if a == p[-1] and b not in p]
        found = graph.shortest_path(spark.createDataFrame(sorted(pairs), "source long, target long"), 0, 11).collect()
        assert [x.path for x in found] == ([best] if best else [])


def test_pages_read_their_ranges(spark, tmp_path):
    rows = spark.range(5000).selectExpr("if(id % 3 = 0, 7, id) as k", "cast(id as string) as v", "if(id % 5 = 0, null, id) as w")
    pages = storage.Pages.write(rows, "k", str(tmp_path / "p"), 8)
    one = pages.page(50, 1200)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan and len(one.inputFiles()) >= 1 and "_range" in plan.split("PartitionFilters")[1].split("]")[0]
    keys = [r.k for r in one.collect()]
    want = sorted(r.k for r in rows.collect())
    assert sorted(keys) == want[1200:1250]
    every = [tuple(r) for p in pages.batches(999) for r in p.collect()]
    assert len(every) == 5000 == len(set(every)) and [len(pages.page(999, at).collect()) for at in (0, 4995, 6000)] == [999, 5, 0]
    assert storage.Pages.write(rows.limit(0), "k", str(tmp_path / "e")).page(5).count() == 0


def test_names_within_one_long_document(spark):
    spans = spark.range(100_000).select(F.lit(1).alias("doc_id"), (F.col("id") * 40).alias("start"), (F.col("id") * 40 + 60).alias("end"))
    names = spark.range(100_000).select(F.lit(1).alias("doc_id"), (F.col("id") * 40 + 45).alias("pos"), F.col("id").cast("string").alias("name"))
    out = metadata.first_within(spans, names, 64)
    got = {r.start: r.name for r in out.where("start < 200").collect()}
    assert got == {0: "0", 40: "0", 80: "1", 120: "2", 160: "3"} and out.count() == 100_000
    plan = metadata.first_within(spans, names, 64)._jdf.queryExecution().optimizedPlan().toString()
    assert "_bin" in plan


@pytest.mark.parametrize("most", [1, 3])
def test_json_checks_are_those_of_one_value(spark, most):
    r = random.Random(5)

    def value(depth):
        kind = r.random()
        if depth == 0 or kind < 0.3:
            return r.choice([1, 'a"{[', None, True, {}, [], "\\"])
        if kind < 0.65:
            return {f"k{i}[": value(depth - 1) for i in range(r.randrange(3))}
        return [value(depth - 1) for _ in range(r.randrange(3))]

    held = [{"a": value(r.randrange(6))} for _ in range(200)]
    df = spark.createDataFrame([(i, json.dumps(x, indent=r.choice([None, 1]))) for i, x in enumerate(held)] + [(900, "{"), (901, "[1]"), (902, None), (903, "{}")], "i int, t string")
    got = {x.i: x.p for x in df.select("i", metadata.json_problem(F.col("t"), most).alias("p")).collect()}
    assert {i: got[i] for i in range(200)} == {i: metadata.depth_problem(x, most) for i, x in enumerate(held)}
    assert (got[900], got[901], got[902], got[903]) == ("json", "type", "json", None)
