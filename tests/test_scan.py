"""Lexical search by a pass over the documents: exact, without an index and without shuffled texts."""

import os
import random

import pytest

from sextant import catalog
from sextant.operators import blockmax, lexical
from sextant.plans import search


def tables(spark, seed, words=30):
    r = random.Random(seed)
    text = lambda n: None if r.random() < 0.1 else " ".join(f"w{int(r.paretovariate(0.7)) % words}" for _ in range(r.randrange(n)))
    docs = [(f"d{i}", text(40)) for i in range(150)] + [(None, "w1 w2")]
    queries = [(i, text(12)) for i in range(9)] + [(9, "none of these"), (10, "w1 w1 w2"), (None, "w1")]
    return spark.createDataFrame(queries, "query_id int, text string"), spark.createDataFrame(docs, "doc_id string, text string").repartition(3)


def key(df):
    return sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect() if r.query_id is not None)


def no_index(*_):
    raise AssertionError("an index is built")


@pytest.mark.parametrize("cells", [1 << 20, 40])
@pytest.mark.parametrize("pad", [True, False])
def test_a_pass_gives_what_an_index_gives(spark, monkeypatch, cells, pad):
    queries, docs = tables(spark, 5)
    docs = docs.where("doc_id is not null")
    want = key(lexical.search(queries, lexical.build(docs), 7, pad))
    monkeypatch.setattr(lexical, "CELLS", cells)
    monkeypatch.setattr(blockmax, "build", no_index)
    got = lexical.bm25(queries, docs, 7, pad)
    assert key(got) == want and {r.query_id for r in want_rows(got)} >= ({9, None} if pad else {10})


def want_rows(df):
    return df.select("query_id").distinct().collect()


def test_null_ids_stand_last_and_no_documents_give_none(spark):
    queries, docs = tables(spark, 6)
    got = [r.doc_id for r in lexical.bm25(queries, docs, 151).where("query_id = 9").orderBy("rank").collect()]
    assert got == sorted(f"d{i}" for i in range(150)) + [None]
    assert lexical.bm25(queries, docs.limit(0), 3).count() == 0 == lexical.bm25(queries.limit(0), docs, 3).count()


@pytest.mark.parametrize("most", ["QUERIES", "TERMS"])
def test_many_queries_go_to_an_index(spark, monkeypatch, most):
    queries, docs = tables(spark, 7)
    docs = docs.where("doc_id is not null")
    want, built = key(lexical.bm25(queries, docs, 5)), []
    monkeypatch.setattr(lexical, most, 3)
    build = blockmax.build
    monkeypatch.setattr(blockmax, "build", lambda *a: (built.append(1), build(*a))[1])
    assert key(lexical.bm25(queries, docs, 5)) == want and built


@pytest.mark.parametrize("name", ["hybrid_search", "configured_pipeline", "lexical_rerank", "query_tool"])
def test_queries_cost_the_same_in_each_run(spark, monkeypatch, tmp_path, name):
    """Before, the first query of a session built an index that the others found; its shuffles were those of all texts."""
    os.symlink("/root/testdata/sf0.001", tmp_path / "d")
    monkeypatch.setattr(blockmax, "build", no_index)
    assert catalog.QUERIES[name](spark, str(tmp_path / "d")).count() > 0


def test_texts_that_were_not_found_are_not_shuffled(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "s") for i in range(50)], "doc_id int, text string, source string")
    found = spark.createDataFrame([(1, 3, 1, 0.5), (1, 99, 2, 0.4), (2, 3, 1, 0.3)], "query_id int, doc_id int, rank int, score double")
    out = search.hydrate(found, docs)
    assert sorted((r.query_id, r.doc_id, r.text, r.source) for r in out.collect()) == [(1, 3, "text 3", "s"), (1, 99, "", None), (2, 3, "text 3", "s")]
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()
