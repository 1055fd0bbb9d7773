"""Ranked search in blocks against scoring every match."""

import random

import numpy as np
import pyarrow as pa
import pytest

from sextant.operators import blockmax, lexical


def test_blocks_round_trip():
    r = random.Random(1)
    for top in (1, 200, 70_000, 5_000_000):
        ords = np.array(sorted(r.sample(range(top + 200), min(100, top))))
        tfs = np.array([r.choice([1, 2, 300, top]) for _ in ords])
        got = blockmax.unpack(int(ords[0]), blockmax.pack(ords, tfs))
        assert (got[0] == ords).all() and (got[1] == tfs).all()


def shard(seed: int, docs: int, words: int, impact, kind):
    """A shard of documents whose words follow a power law, and its rows."""
    r = np.random.default_rng(seed)
    texts = [r.zipf(1.2, r.integers(0, 80)) % words for _ in range(docs)]
    rows = [np.unique(t, return_counts=True) for t in texts]
    n = np.array([len(t) for t in texts])
    table = pa.table({"ord": pa.array(np.arange(docs), pa.int32()), "n": n, "terms": pa.array([[f"w{x}" for x in t] for t, _ in rows], pa.list_(pa.string())), "tfs": pa.array([c.tolist() for _, c in rows], pa.list_(pa.int32())), "shard": pa.array(np.zeros(docs), pa.int32())})
    return blockmax.shard_of(blockmax._shard_lists(table, impact, kind), n, impact), [dict(zip((f"w{x}" for x in t), c.tolist())) for t, c in rows], n


@pytest.mark.parametrize("places", [None, 10])
def test_search_is_exact_and_prunes(places, monkeypatch):
    monkeypatch.setattr(blockmax, "WINDOW", 700)
    impact = (lambda tf, n: (1000 * tf) // (tf + 1 + n // 50)) if places is None else (lambda tf, n: tf / (tf + 0.5 + n / 40))
    s, rows, n = shard(3, 4000, 3000, impact, pa.int64() if places is None else pa.float64())
    r, matches = random.Random(4), 0
    for _ in range(60):
        terms = {f"w{r.randrange(3000) if r.random() < 0.7 else r.randrange(20)}": 1 for _ in range(r.randint(1, 25))}
        weights = {t: (7 if places is None else 0.7) / (1 + int(t[1:]) % 5) ** 2 if places else 100 // (1 + int(t[1:]) % 5) for t in terms}
        scores = []
        for i, own in enumerate(rows):
            held = [t for t in weights if t in own]
            matches += len(held)
            if held:
                v = sum(weights[t] * impact(np.array([own[t]]), n[i : i + 1])[0] for t in held)
                if places is not None:
                    v = round(v, places)
                if v > 0:
                    scores.append((v, i))
        for k in (1, 20):
            want = sorted(scores, key=lambda x: (-x[0], x[1]))[:k]
            got = s.best(weights, k, places)
            assert [x[1] for x in got] == [x[1] for x in want]
            assert [x[0] for x in got] == pytest.approx([x[0] for x in want], abs=1e-9)
    assert s.best({"w1": 1}, 0) == [] and s.best({"none": 5}, 3) == []
    assert s.scored < matches  # of two searches a query: under half of the matches are scored in each


def test_rare_and_common(spark):
    """A query of a rare term and common ones unpacks few blocks of the common ones."""
    impact = lambda tf, n: tf / (tf + 1.0)
    docs = 20_000
    rows = [["the", "of"] + (["rare"] if i % 997 == 0 else []) for i in range(docs)]
    table = pa.table({"ord": pa.array(np.arange(docs), pa.int32()), "n": np.full(docs, 3), "terms": pa.array(rows, pa.list_(pa.string())), "tfs": pa.array([[1] * len(x) for x in rows], pa.list_(pa.int32())), "shard": pa.array(np.zeros(docs), pa.int32())})
    lists = blockmax._shard_lists(table, impact, pa.float64())
    s = blockmax.shard_of(lists, np.full(docs, 3), impact)
    got = s.best({"the": 0.1, "of": 0.1, "rare": 9.0}, 10, 10)
    assert [x[1] for x in got] == [997 * i for i in range(10)]
    assert s.scored < 0.02 * 2 * docs and s.unpacked < 60 < len(lists["data"][0]) + len(lists["data"][1])


def test_kept_index_follows_its_table(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "red fox"), (2, "blue fox")], "doc_id long, text string").write.parquet(path)
    q = spark.createDataFrame([(1, "red")], "query_id long, text string")
    first = lexical.of_table(spark, path)
    assert first.lists.inputFiles() == lexical.of_table(spark, path).lists.inputFiles()
    spark.createDataFrame([(0, "red red red")], "doc_id long, text string").write.mode("append").parquet(path)
    assert [r.doc_id for r in lexical.search(q, lexical.of_table(spark, path), 1).collect()] == [0]
