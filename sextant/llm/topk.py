"""Exact top-k by inner product over integer vectors.

Candidates are visited in order of descending length, over the table and inside a block.  All vectors are also rotated
by the eigenvectors of their second-moment matrix (the right singular vectors of the table), so that the first
coordinates hold most of the length.  For a query with a current k-th score t:
  - once |q| |v| < t for the longest vector left, the query is done (Cauchy-Schwarz on whole vectors);
  - else the product of the first coordinates plus |q_rest| |v_rest| bounds the score; only pairs whose bound reaches t
    are scored, exactly, in integers.
Bounds carry a margin above the rounding error, and a tie with t is never pruned, so the result is exact.

The table is written once in ranges of length, the longest first: the first range holds some ELEMENTS numbers, each
further one GROWTH times as many, so ranges are few.  They are taken in turn.  A query enters a range only if its length
times that of the range's longest vector reaches its k-th score so far; ranges that no query enters aren't read.  Inside
a range both sides are dealt by hash to blocks of ELEMENTS numbers, whatever the dimension; each pair of blocks is one
group, which starts from the k-th scores so far, and its k best per query are merged by a window.

A vector that is null, or holds a null or non-finite component, takes no part; nor does a null id.  Rows that share an
id all take part: each is a candidate of every query with another id, and as queries they have one list together, as in
the SQL.  Shorter vectors are padded with zeros.  Vectors of one length share a range.  k rows or fewer come back per
query; an empty table gives an empty result.  Scores of 2 ** 53 and more are worked out in 64-bit integers, those that may
pass 2 ** 62 in Python's and end at the limits of a long.  Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import materialize, scratch

#: Numbers in a block of vectors (4 MB) and in the first range; how much larger each range is than the one before.
ELEMENTS, GROWTH = 1 << 19, 4
#: Vectors of one step inside a block; rotated coordinates read first.
STEP, HEAD = 512, 16


def integers(vectors: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component of each usable vector."""
    x = F.transform(F.col(vec_col), lambda e: e.cast("double"))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
    fine = F.forall("x", lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))), F.lit(False)))
    return rows.where(fine).select("vec_id", F.transform("x", lambda e: F.floor(F.lit(scale) * e).cast("long")).alias("v"))


def _matrix(column, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def rotation(ints: DataFrame, dim: int) -> np.ndarray:
    """Orthonormal columns by descending share of the table's squared length, from the sums over all rows."""

    def moments(batches):
        total = np.zeros((dim, dim))
        for b in batches:
            m = _matrix(b["v"], dim)
            total += m.T @ m
        yield pd.DataFrame({"i": np.arange(dim), "row": list(total)})

    rows = ints.mapInPandas(moments, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    m = np.zeros((dim, dim))
    for r in rows:
        m[r.i, r.j] = r.x
    return np.linalg.eigh(m)[1][:, ::-1]


def products(q: np.ndarray, v: np.ndarray, most: float) -> np.ndarray:
    """Inner products of whole numbers, exact; most bounds them and every partial sum (Cauchy-Schwarz)."""
    if most < 2.0**53:
        return q @ v.T
    q, v = q.astype(np.int64), v.astype(np.int64)
    if most < 2.0**62:
        return q @ v.T
    ends = 2**63 - 1
    return np.clip(q.astype(object) @ v.astype(object).T, -ends, ends).astype(np.int64)


def block_topk(qid, q, vid, v, rot, k, floor=None, seen=None):
    """k best of the candidates for each query of one block pair; arrays of whole numbers held as doubles.

    floor: scores below which a query needs no candidate.  seen: a list that takes the number of pairs scored.
    """
    order = np.argsort(-np.einsum("ij,ij->i", v, v), kind="stable")
    vid, v = vid[order], v[order]
    head = min(HEAD, v.shape[1])
    qr, vr = q @ rot, v @ rot
    qn, vn = np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1)
    q_rest, v_rest = np.linalg.norm(qr[:, head:], axis=1), np.linalg.norm(vr[:, head:], axis=1)
    most = float(qn.max(initial=0)) * float(vn.max(initial=0)) * (1 + 1e-9)
    kind, none = (np.float64, -np.inf) if most < 2.0**53 else (np.int64, np.iinfo(np.int64).min)
    best = np.full((len(q), k), none, kind)
    ids = np.full((len(q), k), np.iinfo(np.int64).max)
    floor = np.full(len(q), -np.inf) if floor is None else floor
    active = np.arange(len(q))
    for a in range(0, len(v), STEP):
        b = min(a + STEP, len(v))
        t = np.maximum(best[active, -1], floor[active])
        margin = 1e-9 * (1 + qn[active] * vn[a])
        active = active[qn[active] * vn[a] + margin >= t]
        if not len(active):
            break
        t, margin = np.maximum(best[active, -1], floor[active]), 1e-9 * (1 + qn[active] * vn[a])
        bound = qr[active, :head] @ vr[a:b, :head].T + q_rest[active, None] * v_rest[None, a:b]
        live = bound + margin[:, None] >= t[:, None]
        cols = np.flatnonzero(live.any(axis=0))
        rows = np.flatnonzero(live.any(axis=1))
        if not len(cols):
            continue
        who = active[rows]
        if seen is not None:
            seen.append(len(who) * len(cols))
        s = products(q[who], v[a + cols], most)
        s[vid[a + cols][None, :] == qid[who][:, None]] = none
        s = np.concatenate([best[who], s], axis=1)
        i = np.concatenate([ids[who], np.broadcast_to(vid[a + cols], (len(who), len(cols)))], axis=1)
        pick = np.lexsort((i, -s if kind is np.float64 else ~s), axis=1)[:, :k]
        best[who], ids[who] = np.take_along_axis(s, pick, 1), np.take_along_axis(i, pick, 1)
    keep = best > none
    return np.repeat(qid, keep.sum(axis=1)), ids[keep], best[keep].astype(np.int64)


def ranges(candidates: DataFrame, n: int, dim: int) -> tuple[DataFrame, list]:
    """The table (vec_id, v, band) in ranges of descending length, and (band, n, top) of each: its rows and greatest length."""
    first, shares = max(1, ELEMENTS // dim), []
    done = size = first
    while done < n:
        shares.append(1 - done / n)
        size *= GROWTH
        done += size
    long = candidates.withColumn("length", _length("v"))
    cuts = long.agg(F.percentile_approx("length", shares, 100_000).alias("c")).first().c if shares else []
    band = sum((F.when(F.col("length") < c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0)).cast("int")
    path, spark = scratch(candidates.sparkSession), candidates.sparkSession
    long.withColumn("band", band).write.partitionBy("band").parquet(path)
    kept = spark.read.schema("vec_id long, v array<long>, length double, band int").parquet(path)
    found = kept.groupBy("band").agg(F.count("*").alias("n"), F.max("length").alias("top")).orderBy("band").collect()  # a row a range
    return kept.drop("length"), [tuple(r) for r in found]


def _length(v: str):
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def exact_topk(candidates: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """candidates, queries: (vec_id, v array<long>).  Returns query_id, rank, vec_id, score."""
    size = candidates.agg(F.max(F.size("v")).alias("d"), F.count("*").alias("n")).first()
    dim = max(1, size.d or 1)
    rows = max(1, ELEMENTS // dim)
    kind = "query_id long, vec_id long, score long"
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = candidates.sparkSession.createDataFrame([], f"{kind}, rank int")
    if size.n:
        rot = rotation(candidates, dim)
        table, bands = ranges(candidates, size.n, dim)
        waiting = queries.select("vec_id", "v", _length("v").alias("length"))
    else:
        bands = []

    def pair(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        floor = q["floor"].to_numpy(np.float64, na_value=-np.inf)
        qid, vid, score = block_topk(q.vec_id.to_numpy(), _matrix(q.v, dim), v.vec_id.to_numpy(), _matrix(v.v, dim), rot, k, floor)
        return pd.DataFrame({"query_id": qid, "vec_id": vid, "score": score})

    block = lambda n, salt: F.pmod(F.xxhash64("vec_id", "v", F.lit(salt)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    for band, n, top in bands:
        floors = best.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor"))
        reach = F.col("length") * top * (1 + 1e-9) + 1e-9 >= F.col("floor")
        # A query that a range can't serve is served by no later one.
        waiting = materialize(waiting.drop("floor").join(floors, "vec_id", "left").where(F.col("floor").isNull() | reach))
        n_q = waiting.count()
        if not n_q:
            break
        nq, nv = -(-n_q // rows), -(-n // rows)
        left = waiting.select("vec_id", "v", "floor", block(nq, 1).alias("qb"), each(nv).alias("vb"))
        right = table.where(F.col("band") == band).select("vec_id", "v", block(nv, 2).alias("vb"), each(nq).alias("qb"))
        found = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInPandas(pair, kind)
        merged = found.unionByName(best.drop("rank")).withColumn("rank", rank)
        best = materialize(merged.where(F.col("rank") <= k))
    return best.select("query_id", "rank", "vec_id", "score")


SQL = """
WITH x AS (SELECT vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
      FROM x q JOIN x c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
