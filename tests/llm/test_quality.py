import math
from collections import Counter

from pyspark.sql import functions as F

from sextant.llm.quality_rules import quality_rules


def brute(spark, texts, trusted, buckets, prior):
    """Scores by plain counting; only the hash of an n-gram is asked of Spark."""
    words = [[w for w in (t or "").replace("\t", " ").replace("\n", " ").split(" ") if w] for t in texts]
    pairs = {(w, None) for ws in words for w in ws} | {p for ws in words for p in zip(ws, ws[1:])}
    rows = spark.createDataFrame(sorted(pairs, key=str), "a string, b string")
    place = {(r.a, r.b): r.h for r in rows.select("a", "b", F.pmod(F.when(F.col("b").isNull(), F.hash("a")).otherwise(F.hash("a", "b")), F.lit(buckets)).alias("h")).collect()}
    grams = [[place[w, None] for w in ws] + [place[p] for p in zip(ws, ws[1:])] for ws in words]
    raw = Counter(g for gs in grams for g in gs)
    tgt = Counter(g for gs, t in zip(grams, trusted) if t for g in gs)
    n, m, a = sum(raw.values()), sum(tgt.values()), prior * buckets
    out = []
    for gs, t in zip(grams, trusted):
        total = 0.0
        for g in gs:
            if raw[g] > 1:
                p = (raw[g] - 1) / (n - 1)
                total += math.log((tgt[g] - t + a * p) / ((m - t + a) * p))
        out.append(total / len(gs) if gs else 0.0)
    return out


def test_scores_against_counting(spark):
    texts = ["the cat sat on the mat", "the cat sat", "a dog\tran\n\nfar the cat", "buy buy buy now", None, "", " \n", "once", "the cat sat on the mat", "z " * 3000 + "the cat"]
    trusted = [True, False, True, False, True, False, False, True, False, False]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "the cat", "x")], "doc_id long, text string, _target string")
    ids = spark.createDataFrame([(i,) for i, t in enumerate(trusted) if t] * 2 + [(None,), (99,)], "doc_id long")
    for buckets in (64, 4096):
        want = brute(spark, [*texts, "the cat"], [*trusted, False], buckets, 2.0)
        out = quality_rules(docs, ids, buckets, 2.0)
        got = {r.doc_id: r for r in out.collect()}
        assert out.columns[:3] == ["doc_id", "text", "_target"] and len(got) == len(want)
        for i, score in zip([*range(len(texts)), None], want):
            assert math.isclose(got[i].score, score, rel_tol=1e-9, abs_tol=1e-12), (i, got[i].score, score)
            assert got[i].kept == (not got[i].base_failed and score >= -0.05)


def test_no_trusted_document(spark):
    docs = spark.createDataFrame([(1, "a b a b"), (2, "a b")], "doc_id long, text string")
    want = brute(spark, ["a b a b", "a b"], [False, False], 256, 4.0)
    got = [r.score for r in quality_rules(docs, docs.limit(0), 256, 4.0).orderBy("doc_id").collect()]
    assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12) for a, b in zip(got, want))
