"""Exact nearest neighbours of a table of query vectors, in blocks, by Arrow batches and numpy."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.functions.scoring import PLACES, ranked

#: Queries of one block; a single block is sent to the workers, more of them meet the vectors part by part.
BLOCK = 4096
#: Vectors of one part, if there are several blocks.
PART = 65_536
#: Vectors that a single block meets at once.
STEP = 1024


class Best:
    """The k nearest of each query of a block so far."""

    def __init__(self, ids, q: np.ndarray, k: int, metric: str):
        self.ids, self.q, self.k, self.metric = ids, q, k, metric
        self.d, self.doc = np.zeros((len(ids), 0)), None

    def add(self, doc: np.ndarray, v: np.ndarray) -> None:
        if self.metric == "l2":
            d = self._squares(v)
        else:
            d = 1 - (self.q @ v.T) / np.maximum(np.linalg.norm(self.q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :], 1e-300)
        doc = np.broadcast_to(doc, d.shape)
        if self.doc is not None:
            d, doc = np.hstack([self.d, d]), np.hstack([self.doc, doc])
        pick = np.lexsort((doc, np.round(d, PLACES) + 0.0), axis=1)[:, : self.k]
        self.d, self.doc = np.take_along_axis(d, pick, 1), np.take_along_axis(doc, pick, 1)

    def _squares(self, v: np.ndarray) -> np.ndarray:
        """Squared distances by a matrix product; those that may be among the k least again by differences, exactly."""
        near = (self.q**2).sum(axis=1)[:, None] + (v**2).sum(axis=1)[None, :]
        slack = near * 1e-12 + 10.0**-PLACES
        d = near - 2 * (self.q @ v.T)
        line = np.partition(d + slack, min(self.k, len(v)) - 1, axis=1)[:, min(self.k, len(v)) - 1]
        for i, j in enumerate(d - slack <= line[:, None]):
            d[i, j] = ((v[j] - self.q[i]) ** 2).sum(axis=1)
            d[i, ~j] = np.inf
        return d

    def frame(self) -> pd.DataFrame:
        if self.doc is None:
            return pd.DataFrame({"query_id": self.ids[:0], "doc_id": self.ids[:0], "score": self.d[:0].ravel()})
        ids, doc, d = np.repeat(self.ids, self.doc.shape[1]), self.doc.ravel(), self.d.ravel()
        held = np.isfinite(d)
        return pd.DataFrame({"query_id": ids[held], "doc_id": doc[held], "score": d[held]})


def _matrix(column) -> np.ndarray:
    return np.array([np.asarray(x, float) for x in column])


def knn(queries: DataFrame, vectors: DataFrame, k: int = 10, metric: str = "l2") -> DataFrame:
    """query_id, rank, doc_id, score (the distance, 6 places): queries (query_id, v), vectors (doc_id, v).

    Ranks go by distances of PLACES places.  Up to BLOCK queries reach the driver and from there every worker; more are
    dealt to blocks, and vectors to parts, that meet in a task of their own.  A task gives out its k best of a query.
    """
    queries, vectors = queries.where("v is not null").select("query_id", "v"), vectors.where("v is not null").select("doc_id", "v")
    ddl = f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id {vectors.schema['doc_id'].dataType.simpleString()}, score double"
    few = queries.limit(BLOCK + 1).toPandas()
    near = _one_block(few, vectors, k, metric, ddl) if len(few) <= BLOCK else _blocks(queries, vectors, k, metric, ddl)
    top = ranked(near, F.round("score", PLACES), F.col("doc_id"), k=k)
    return top.select("query_id", "rank", "doc_id", (F.round("score", 6) + 0.0).alias("score"))


def _one_block(rows: pd.DataFrame, vectors: DataFrame, k: int, metric: str, ddl: str) -> DataFrame:
    ids, q = rows["query_id"].to_numpy(), _matrix(rows["v"])

    def nearest(batches):
        best = Best(ids, q, k, metric)
        for b in batches:
            for at in range(0, len(b) if len(ids) else 0, STEP):
                best.add(b["doc_id"].to_numpy()[at : at + STEP], _matrix(b["v"][at : at + STEP]))
        yield best.frame()

    return vectors.mapInPandas(nearest, ddl)


def _blocks(queries: DataFrame, vectors: DataFrame, k: int, metric: str, ddl: str) -> DataFrame:
    blocks, parts = math.ceil(queries.count() / BLOCK), max(1, math.ceil(vectors.count() / PART))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("block", deal("query_id", blocks)).withColumn("part", every(parts))
    # A name of its own: both tables may come from the same one, whose columns a cogroup would take for each other.
    right = vectors.select("doc_id", F.col("v").alias("u")).withColumn("part", deal("doc_id", parts)).withColumn("block", every(blocks))

    def nearest(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        best = Best(q["query_id"].to_numpy(), _matrix(q["v"]), k, metric)
        for at in range(0, len(v) if len(q) else 0, 8192):
            best.add(v["doc_id"].to_numpy()[at : at + 8192], _matrix(v["u"][at : at + 8192]))
        return best.frame()

    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(nearest, ddl)
