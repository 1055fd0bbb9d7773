"""Long lists, pages, paths and batches whose work stays in bounds."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from sextant import catalog
from sextant.functions import scoring
from sextant.operators import chunking, context, graph, lexical, lists, storage, vector
from sextant.plans import providers

SMALL = "/root/testdata/sf0.001"


def windows(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"hashpartitioning\(query_id#\d+L?, \d+\)", plan)  # a list to a task


def long_lists(spark):
    r = random.Random(5)
    rows = [(q, i, r.choice(["a", "b", None]), f"t{r.randrange(9)}") for q in (None, 1, 2) for i in r.sample(range(9000), 700)] + [(q, 1, "a", "x") for q in range(3, 40)]
    return spark.createDataFrame(r.sample(rows, len(rows)), "query_id long, pos int, source string, text string").withColumns({"doc_id": F.col("pos"), "score": F.lit(1.0)}), rows


def expected_runs(rows):
    out = []
    for q in {r[0] for r in rows}:
        last = None
        for _, pos, source, text in sorted((r for r in rows if r[0] == q), key=lambda r: r[1]):
            if last is None or last[2] != source:
                out.append(last := [q, pos, source, text, 1])
            else:
                last[3], last[4] = f"{last[3]}\n{text}", last[4] + 1
    return sorted(map(tuple, out), key=str)


def test_paged_rows_have_one_plan(spark, tmp_path):
    rows = spark.range(5000).selectExpr("if(id % 3 = 0, 7, id) as k", "cast(id as string) as v")
    pages = storage.Pages.write(rows, "k", str(tmp_path / "p"), 8)
    got = pages.paged(300)
    assert sorted((r.page, r.v) for r in got.collect()) == sorted((i, r.v) for i, p in enumerate(pages.batches(300)) for r in p.collect())
    plan = catalog.QUERIES["page_batches"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


def test_numbers_of_lists_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(lists, "PART", 1 << 13)
    df, rows = long_lists(spark)
    want = sorted(((q, p, i) for q in {r[0] for r in rows} for i, p in enumerate(sorted(r[1] for r in rows if r[0] == q), 1)), key=str)
    for small in (100_000, 0):  # by sent ends, and by joined ones
        monkeypatch.setattr(lists, "SMALL", small)
        got = lists.numbered(df, F.col("pos"), name="n")
        assert sorted(((r.query_id, r.pos, r.n) for r in got.collect()), key=str) == want and got.schema["n"].dataType.simpleString() == "int"
        assert not windows(got)
    assert lists.numbered(df.limit(0), F.desc("pos")).count() == 0


def test_long_lists_are_not_brought_to_one_task(spark):
    for name in ("multi_query_best", "dedup_exact", "normalize_rank", "normalize_minmax"):
        plan = catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        alone = [x for x in plan.splitlines() if "Window [" in x and "], [query_id#" in x and x.split("], [query_id#")[1].split("]")[0].isdigit()]
        assert not alone, (name, alone)


def test_runs_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(lists, "PART", 1 << 13)
    df, rows = long_lists(spark)
    want = expected_runs(rows)
    for small in (100_000, 0):
        monkeypatch.setattr(lists, "SMALL", small)
        got = context.merge_consecutive(df)
        assert sorted(((r.query_id, r.pos, r.source, r.text, r.chunks_merged) for r in got.collect()), key=str) == want
        assert not windows(got)


def test_normalised_lists_with_a_null_query(spark):
    df = spark.createDataFrame([(None, 1.0, 1), (None, 3.0, 2), (None, 2.0, 3), (1, 5.0, 1)], "query_id long, score double, pos int")
    assert sorted(r.norm for r in scoring.min_max(df).collect()) == [0.0, 0.5, 1.0, 1.0]
    assert sorted(r.norm for r in scoring.rank_norm(df, "pos").collect()) == [0.0, 0.5, 1.0, 1.0]


def test_paths_search_within_their_cutoff(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(12)] * 2 + [(0, 11)], "source long, target long")
    assert {r.id: r.distance for r in graph.reaching(e, 12, 2).collect()} == {12: 0, 11: 1, 10: 2, 0: 2}
    assert [r.path for r in graph.paths(e, 0, 12, 3).collect()] == [[0, 11, 12]]
    assert len(graph.paths(e, 0, 12).collect()) == 2 and graph.paths(e, 0, 12, 0).count() == 0


def test_table_functions_give_rows_in_parts(spark, monkeypatch):
    monkeypatch.setattr(chunking, "ROWS", 3)
    sizes = spark.createDataFrame([(1, "# a\n" + "x" * 4000), (2, None), (3, "y" * 900)], "doc_id long, text string").coalesce(1)
    got = chunking.markdown(sizes)
    assert got.count() == 9 + 2
    seen = got.select("doc_id").mapInArrow(lambda batches: batches, "doc_id long").count()
    assert seen == 11


def test_embedder_looks_words_up(spark):
    embed = providers.get("embedding", "hash", dim=16)
    before = providers._hashed.cache_info().hits
    v = embed(["ab ab cd", "", "x"])
    assert providers._hashed.cache_info().hits > before and v.shape == (3, 16) and not v[1:].any() and abs(np.linalg.norm(v[0]) - 1) < 1e-12


def test_terms_and_vectors_are_taken_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 3} {'long ' * (i % 4)}") for i in range(50)] + [(50, None)], "doc_id long, text string").coalesce(1)
    whole = sorted(map(str, lexical.counted(docs).collect()))
    near = spark.createDataFrame([(i, [float(i % 13), 1.0]) for i in range(50)], "doc_id long, v array<double>").coalesce(1)
    q = spark.createDataFrame([(1, [4.0, 1.0])], "query_id long, v array<double>")
    best = sorted(map(str, vector.knn(q, near, 6).collect()))
    monkeypatch.setattr(lexical, "DOCS", 7)
    monkeypatch.setattr(vector, "STEP", 7)

    def key(rows):
        return sorted((r.doc_id, r.n, sorted(zip(r.terms, r.tfs))) for r in rows)

    assert len(whole) == 51 and sorted(map(str, vector.knn(q, near, 6).collect())) == best
    got = key(lexical.counted(docs).collect())
    monkeypatch.setattr(lexical, "DOCS", 1000)
    assert got == key(lexical.counted(docs).collect())
