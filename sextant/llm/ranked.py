"""Ranked lexical search: Block-Max WAND over integer impacts.

    built = index(docs)                     # posting blocks with their greatest impacts, in shards of documents
    rank(items, built, 20)                  # item_id, rank, doc_id, score

The blocks, the pointers and the pivot are sextant.operators.blockmax; here are the terms, impacts and weights.

Terms are runs of digits, Latin letters and characters beyond ASCII, with A-Z alone lower-cased.  Null, empty and term-free
texts have no terms and are never found; items without terms have no rows.  Very long texts are rows like others.  Documents
of one id are documents of their own; a null id comes last among equal scores.  Repeated items (same id and text) count
once; a null item id is an id.  Equal scores go by ascending doc_id.  Empty tables give an empty result.  Other columns are
never read.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import row_id
from sextant.operators import blockmax

#: Terms that an index may be confined to (a set of under 100 bytes a term in each task); beyond, it holds every term.
ONLY = 500_000

#: Bytes that separate terms become spaces, A-Z become a-z (fixed values).
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str | None) -> list[str]:
    return (text or "").encode("utf-8", "replace").translate(_TABLE).decode().split(" ")


def _counts(text: str | None) -> Counter:
    c = Counter(terms(text))
    del c[""]
    return c


def impact(rows: int, full: int, total: int):
    def of(tf, n):
        m = 75 + (25 * n * full) // max(total, 1)
        return (1_000_000_000 * tf) // (1000 * tf + 12 * m)

    return of


def weight(df: int, rows: int, full: int, total: int) -> int:
    return math.floor(1000 * math.log((2 * full + 2) / (2 * df + 1)))


def counted(docs: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """doc_id, n, terms, tfs of docs (doc_id, text); only: a table of the terms (term) that are ever asked for."""
    spark = docs.sparkSession
    found = None if only is None else [r[0] for r in only.select("term").distinct().limit(ONLY + 1).collect()]
    kept = None if found is None or len(found) > ONLY else spark.sparkContext.broadcast(frozenset(found))

    def run(batches):
        for b in batches:
            n, words, tfs = [], [], []
            for text in b.column(1).to_pylist():
                c = _counts(text)
                n.append(sum(c.values()))
                own = c if kept is None else kept.value.intersection(c)
                words.append(list(own))
                tfs.append([c[x] for x in own])
            cells = pa.array(n, pa.int64()), pa.array(words, pa.list_(pa.string())), pa.array(tfs, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), *cells], names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {blockmax.COUNTED}")


def asked(items: DataFrame) -> DataFrame:
    """query_id (a hash of the item), term, qtf of items (item_id, text)."""
    rows = items.select("item_id", "text").withColumn("query_id", F.hex(row_id("item_id", "text"))).dropDuplicates(["query_id"])

    def run(batches):
        for b in batches:
            got = [(q, t, n) for q, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for t, n in _counts(text).items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))], names=["query_id", "term", "qtf"])

    return rows.select("query_id", "text").mapInArrow(run, "query_id string, term string, qtf long")


def index(docs: DataFrame, only: DataFrame | None = None) -> blockmax.Index:
    """The block index of docs (doc_id, text), as written tables; only: the terms (term) that will be asked for."""
    return blockmax.build(counted(docs, only), impact, "long")


def rank(items: DataFrame, built: blockmax.Index, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents with a score above 0 of each item (item_id, text)."""
    found = blockmax.search(asked(items), built, k, impact, weight, "long", None)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ids = items.select("item_id", F.hex(row_id("item_id", "text")).alias("query_id")).dropDuplicates(["query_id"])
    return best.join(ids, "query_id").select("item_id", "rank", "doc_id", "score")


def ranked(items: DataFrame, docs: DataFrame, k: int = 20) -> DataFrame:
    """rank() in an index of docs that holds the items' terms alone."""
    return rank(items, index(docs, asked(items)), k)


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS t FROM documents),
s AS (SELECT count(*) FILTER (len(t) > 0) AS nd, sum(len(t)) AS ll FROM d),
p AS (SELECT doc_id, len(t) AS n, term, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS term FROM d) GROUP BY doc_id, t, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM f, s),
i AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // ll)) AS imp FROM p, s),
r AS (SELECT item_id, doc_id, sum(qtf * w * imp)::BIGINT AS score FROM q JOIN w USING (term) JOIN i USING (term) GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY rank <= 20"""
