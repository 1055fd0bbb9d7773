"""Ranked search in compressed posting blocks by Block-Max WAND, over shards of documents.

An index is two tables.  Documents are dealt to shards by a hash and numbered within a shard in the order of their ids.  A
row of `lists` holds a term's postings of one shard in blocks of BLOCK: the first and last number of each block, the greatest
impact in it, and its compressed numbers and counts.  A shard is bounded by documents and postings, so that a hot term has a
list of bounded length in each of many shards.

A search visits every shard once for a part of the queries, and a query goes through a shard a window of numbers at a time.
Shallow pointer moves find each list's blocks in the window by their ends; the blocks' greatest impacts alone bound every
number's score, and a window, or a number in it, whose bound stays below the k-th best score so far is passed over.  The
others are the pivots.  They are scored best bound first, a list at a time: before a block is unpacked, the pivots in it must
still pass with what they have and the greatest impacts of the lists to come.  Each shard gives its k best rows of a query,
and a window function ranks those of all shards.

A score is a sum of weight * impact(count, document length): non-negative numbers, integers or doubles.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.sources.files import materialize

#: Postings in a block; documents and postings in a shard at most, as the mean of a hash goes.
BLOCK, SHARD_ROWS, SHARD_POSTINGS = 128, 1 << 14, 1 << 22
#: Terms of all queries that are held by a task at once (rows of under 100 bytes); more queries are taken in parts.
WEIGHTS = 200_000
#: Document numbers that are bounded at once; bounds are doubles, whose sums may be off by less than a share of SLACK.
WINDOW, SLACK = 1 << 14, 1e-9

COUNTED = "n long, terms array<string>, tfs array<int>"


@dataclass(frozen=True)
class Index:
    """documents: shard, ord, doc_id, n; lists: shard, term, df (of the shard), first, last, top, data."""

    documents: DataFrame
    lists: DataFrame

    def sizes(self) -> tuple[int, int, int]:
        """Documents, documents with a term, and terms with repeats."""
        return tuple(self.documents.agg(F.count("*"), F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first())

    def terms(self) -> DataFrame:
        """term, df over all shards."""
        return self.lists.groupBy("term").agg(F.sum("df").alias("df"))


def _tasks(shards: int) -> int:
    """Partitions for so many shards: more, as long as they are few, so that a hash rarely puts two shards into one."""
    return max(shards, min(4 * shards, 2000))


def pack(ords: np.ndarray, tfs: np.ndarray) -> bytes:
    """A block: two bytes of widths, the gaps between numbers, the counts."""
    gaps = np.diff(ords)
    kinds = [np.min_scalar_type(int(x.max()) if len(x) else 0) for x in (gaps, tfs)]
    return bytes(k.itemsize for k in kinds) + gaps.astype(kinds[0]).tobytes() + tfs.astype(kinds[1]).tobytes()


def unpack(first: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    a, b = data[0], data[1]
    n = (len(data) - 2 + a) // (a + b)
    ords = np.empty(n, "i8")
    ords[0] = 0
    np.cumsum(np.frombuffer(data, f"u{a}", n - 1, 2), out=ords[1:])
    return ords + first, np.frombuffer(data, f"u{b}", n, 2 + a * (n - 1)).astype("i8")


def _shard_lists(rows: pa.Table, impact, top_type: pa.DataType) -> pa.Table:
    """The lists of one shard from its rows (ord, n, terms, tfs)."""
    rows = rows.combine_chunks()
    cell = rows.column("terms").chunk(0) if rows.num_rows else pa.array([], pa.list_(pa.string()))
    sizes = np.asarray(cell.value_lengths().fill_null(0))
    words = cell.flatten().dictionary_encode()
    ords = np.repeat(np.asarray(rows.column("ord")), sizes)
    lens = np.repeat(np.asarray(rows.column("n")), sizes)
    tfs = np.asarray(rows.column("tfs").chunk(0).flatten()) if len(words) else np.zeros(0, "i4")
    codes = np.asarray(words.indices)
    by = np.lexsort((ords, codes))
    codes, ords, tfs = codes[by], ords[by], tfs[by]
    tops = impact(tfs.astype("i8"), lens[by])
    new = np.flatnonzero(np.diff(codes, prepend=-1))  # where a list starts
    df = np.diff(new, append=len(codes))
    place = np.arange(len(codes)) - np.repeat(new, df)
    at = np.flatnonzero(place % BLOCK == 0)
    ends = np.append(at[1:], len(codes))[: len(at)]  # none in a shard without terms
    data = [pack(ords[i:j], tfs[i:j]) for i, j in zip(at.tolist(), ends.tolist())]
    offsets = pa.array(np.append(np.searchsorted(at, new), len(at)), pa.int32())
    blocks = lambda x, kind: pa.ListArray.from_arrays(offsets, pa.array(x, kind))
    most = np.maximum.reduceat(tops, at) if len(at) else tops
    shard = pa.array(np.full(len(new), rows.column("shard")[0].as_py() if rows.num_rows else 0), pa.int32())
    out = [shard, words.dictionary.take(pa.array(codes[new])), pa.array(df, pa.int64()), blocks(ords[at], pa.int32()), blocks(ords[ends - 1], pa.int32()), blocks(most, top_type), blocks(data, pa.binary())]
    return pa.Table.from_arrays(out, names="shard term df first last top data".split())


def build(counted: DataFrame, impact: Callable, kind: str = "double") -> Index:
    """The index of counted rows (doc_id, n, terms, tfs), as written tables.

    terms are distinct in a row, tfs their counts, n the document's length.  impact(documents, non-empty ones, terms)
    gives a function of arrays (tf, n); kind is its type, long or double.  Null ids are numbered last; rows of one id are
    documents of their own.
    """
    spark = counted.sparkSession
    kept = materialize(counted.select("doc_id", "n", "terms", "tfs"))
    rows, full, total, postings = kept.agg(F.count("*"), F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    shards = max(1, ceil(rows / SHARD_ROWS), ceil(postings / SHARD_POSTINGS), min(spark.sparkContext.defaultParallelism, ceil(rows / 1024)))
    measure, top_type = impact(rows, full, total), {"long": pa.int64(), "double": pa.float64()}[kind]

    def number(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending")])  # nulls last
        return table.append_column("ord", pa.array(np.arange(table.num_rows), pa.int32()))

    # A hash of the terms too, so that rows of one id spread.
    dealt = kept.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(shards)).cast("int"))
    # A shard's work isn't told by its bytes: the number of partitions is given, so that they aren't merged.
    dealt = dealt.select("doc_id", "n", "terms", "tfs", "shard").repartition(_tasks(shards), "shard")
    schema = f"doc_id {counted.schema['doc_id'].dataType.simpleString()}, {COUNTED}, shard int, ord int"
    numbered = materialize(dealt.groupBy("shard").applyInArrow(number, schema))
    out = f"shard int, term string, df long, first array<int>, last array<int>, top array<{kind}>, data array<binary>"
    lists = numbered.select("shard", "ord", "n", "terms", "tfs").repartition(_tasks(shards), "shard").groupBy("shard").applyInArrow(lambda t: _shard_lists(t, measure, top_type), out)
    return Index(numbered.select("shard", "ord", "doc_id", "n"), materialize(lists))


def save(built: Index, path: str) -> None:
    """Write the tables; lists lie in ranges of terms, so that a reader's files are pruned by term."""
    built.documents.write.mode("overwrite").parquet(f"{path}/documents")
    built.lists.repartitionByRange("term").sortWithinPartitions("term", "shard").write.mode("overwrite").parquet(f"{path}/lists")


def load(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/documents"), spark.read.parquet(f"{path}/lists"))


class List:
    """One term's blocks in a shard.  A block is unpacked when a pivot needs it, once for all queries of the task."""

    __slots__ = ("first", "last", "top", "data", "most", "blocks")

    def __init__(self, first: list[int], last: list[int], top: list, data: list[bytes]):
        self.first, self.last, self.top, self.data = np.array(first), np.array(last), np.array(top), data
        self.most, self.blocks = max(top), [None] * len(first)


class Shard:
    """The lists of one shard; counts what a search unpacks and scores."""

    def __init__(self, lists: dict[str, List], lens: np.ndarray, impact: Callable):
        self.lists, self.lens, self.impact = lists, lens, impact
        self.unpacked = self.scored = 0

    def block(self, held: List, b: int) -> tuple[np.ndarray, np.ndarray]:
        if held.blocks[b] is None:
            ords, tfs = unpack(int(held.first[b]), held.data[b])
            held.blocks[b] = ords, self.impact(tfs, self.lens[ords])
            self.unpacked += 1
        return held.blocks[b]

    def hits(self, held: List, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in wanted, impacts) of the numbers, in ascending order, that a list holds; unpacks their blocks alone."""
        at = held.last.searchsorted(wanted)
        at = at[at < len(held.last)]
        need = np.unique(at[held.first[at] <= wanted[: len(at)]]).tolist()
        if not need:
            return np.zeros(0, "i8"), held.top[:0]
        parts = [self.block(held, b) for b in need]
        ords, impacts = parts[0] if len(parts) == 1 else (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        place = ords.searchsorted(wanted)
        place[place == len(ords)] = 0
        found = np.flatnonzero(ords[place] == wanted)
        self.scored += len(found)
        return found, impacts[place[found]]

    def scores(self, held: list[tuple[float, List]], pivots: np.ndarray, score: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """The pivots that may still pass floor, and their scores; score: what they have from other lists."""
        tops = np.zeros((len(held) + 1, len(pivots)))
        for i, (w, x) in enumerate(held):  # shallow moves
            at = x.last.searchsorted(pivots)
            at[at == len(x.last)] = 0
            tops[i] = np.where((x.first[at] <= pivots) & (x.last[at] >= pivots), w * x.top[at], 0)
        rest = tops[::-1].cumsum(0)[::-1]  # of a list and those after it
        for i, (w, x) in enumerate(held):
            alive = (score + rest[i]) * (1 + SLACK) >= floor
            if not alive.all():
                pivots, score, rest = pivots[alive], score[alive], rest[:, alive]
            found, impacts = self.hits(x, pivots)
            score[found] += w * impacts
        return pivots, score

    def best(self, weights: dict[str, float], k: int, places: int | None = None) -> list[tuple[float, int]]:
        """(score, number) of the k best documents with a score above 0, best first, ties by number.

        With places, scores are doubles that are compared after rounding.
        """
        held = sorted(((w, self.lists[x]) for x, w in weights.items() if w > 0 and x in self.lists), key=lambda h: -h[0] * h[1].most)
        short, long = [h for h in held if len(h[1].first) == 1], [h for h in held if len(h[1].first) > 1]
        kind = "i8" if places is None else "f8"
        top, ords, floor = np.zeros(0, kind), np.zeros(0, "i8"), 0
        for low in range(0, len(self.lens), WINDOW) if k > 0 else ():
            size = min(WINDOW, len(self.lens) - low)
            rise, at, known = [], [], np.zeros(size, kind)
            for w, x in long:
                i, j = x.last.searchsorted(low), x.first.searchsorted(low + size)
                rise += [w * x.top[i:j], -w * x.top[i:j]]
                at += [np.maximum(x.first[i:j] - low, 0), np.minimum(x.last[i:j] + 1 - low, size)]
            for w, x in short:  # a list of one block has nothing to pass over
                if x.first[0] < low + size and x.last[0] >= low:
                    o, impacts = self.block(x, 0)
                    i, j = o.searchsorted((low, low + size))
                    known[o[i:j] - low] += w * impacts[i:j]
                    self.scored += int(j - i)
            bound = known + (np.bincount(np.concatenate(at), np.concatenate(rise), size + 1)[:size].cumsum() if at else 0)
            slack = SLACK * (float(bound.max()) if size else 0)
            pivots = np.flatnonzero(bound > slack)
            pivots, batch = pivots[np.argsort(-bound[pivots], kind="stable")], 4 * k
            while len(pivots := pivots[bound[pivots] + slack >= floor]):
                now, pivots, batch = np.sort(pivots[:batch]), pivots[batch:], 2 * batch
                o, s = self.scores(long, now + low, known[now], floor)
                s = s if places is None else s.round(places)
                o, s = np.concatenate([ords, o[s > 0]]), np.concatenate([top, s[s > 0]])
                by = np.lexsort((o, -s))[:k]
                ords, top = o[by], s[by]
                floor = top[-1] if len(top) == k else 0
        return list(zip(top.tolist(), ords.tolist()))


def shard_of(lists: pa.Table, lens: np.ndarray, impact: Callable) -> Shard:
    cols = [lists.column(c).to_pylist() for c in ("term", "first", "last", "top", "data")]
    return Shard({t: List(*rest) for t, *rest in zip(*cols)}, lens, impact)


def _searcher(asked, k: int, measure: Callable, kind: str, places: int | None):
    """What a task does with a shard's lists and documents: the k best of each query in asked, a broadcast of weights."""
    schema = pa.schema([("query_id", pa.string()), ("score", pa.int64() if kind == "long" else pa.float64()), ("at", pa.int32())])

    def run(lists: pa.Table, docs: pa.Table) -> pa.Table:
        docs = docs.sort_by("ord")
        shard = shard_of(lists, np.asarray(docs.column("n")), measure)
        got = [(q, s, i) for q, w in asked.value.items() for s, i in shard.best(w, k, places)]
        out = pa.Table.from_arrays([pa.array([x[i] for x in got], f.type) for i, f in enumerate(schema)], schema=schema)
        return out.append_column("doc_id", docs.column("doc_id").combine_chunks().take(out.column("at"))).select(["query_id", "doc_id", "score"])

    return run


def search(wanted: DataFrame, built: Index, k: int, impact: Callable, weight: Callable, kind: str = "double", places: int | None = 10) -> DataFrame:
    """query_id, doc_id, score: the k best documents of each query in each shard, which hold the k best of all.

    wanted: query_id, term, qtf, each pair once.  weight(df, documents, non-empty ones, terms) gives a term's weight for
    one occurrence (0 or more).  Queries go to the tasks in parts of some WEIGHTS terms.  A query id is given back as text
    (null ids and null terms have no results).
    """
    spark = wanted.sparkSession
    sizes = built.sizes()
    shards = built.documents.agg(F.max("shard")).first()[0]
    shards = 1 if shards is None else shards + 1
    measure = impact(*sizes)
    wanted = wanted.where("query_id is not null and term is not null").select(F.col("query_id").cast("string").alias("query_id"), "term", "qtf")
    held = wanted.join(built.terms(), "term")
    parts = max(1, ceil(wanted.count() / WEIGHTS))
    id_type = built.documents.schema["doc_id"].dataType
    schema = f"query_id string, doc_id {id_type.simpleString()}, score {kind}"
    found = None
    for part in range(parts):
        rows = held.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).collect()
        weights: dict[str, dict[str, float]] = {}
        for r in rows:
            weights.setdefault(r.query_id, {})[r.term] = r.qtf * weight(r.df, *sizes)
        asked = spark.sparkContext.broadcast(weights)
        terms = spark.createDataFrame([(x,) for x in sorted({r.term for r in rows})], "term string")

        lists = built.lists.join(F.broadcast(terms), "term", "left_semi").select("shard", "term", "first", "last", "top", "data")
        docs = built.documents.repartition(_tasks(shards), "shard")
        one = lists.repartition(_tasks(shards), "shard").groupBy("shard").cogroup(docs.groupBy("shard")).applyInArrow(_searcher(asked, k, measure, kind, places), schema)
        found = one if found is None else found.unionByName(one)
    return found
