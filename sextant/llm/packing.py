"""Best-fit packing of token pieces into sequences of fixed length, planned on the length histogram.

1. Every document is tokenised (whole text, then id 0) and cut only if it is longer than a sequence: its first piece
   takes what the full pieces leave over.  Pieces (without ids) are written to the shared folder once.
2. The histogram of lengths, at most one row per length, goes to the driver.  Patterns of one to three length bins that
   fill a sequence are enumerated; non-negative least squares (active sets) fits their repeat counts to the binned
   histogram; the counts are rounded, and further patterns taken one by one, while no bin is used more often than it has
   pieces.
3. What remains is packed on the histogram by best fit, longest first, exact lengths, many equal sequences at a time.
4. Each piece finds its place from its length and its rank among pieces of that length; the rank is counted in two
   levels, a length being divided by a hash into cells of some CELL pieces, so no length is gathered in one task.  The plan is bounded by the number of lengths, not by the data.

Null text is empty and gives one piece with the id 0 alone.  Repeated rows are packed each; a null id is carried along.
An empty table gives an empty result.  A very long text, with or without spaces, is tokenised whole in one task and cut;
ties (pieces of one length) are ranked by a hash of id, piece and ids.  Columns beside doc_id and text aren't read.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import checked_broadcast, materialize

LENGTH, BIN = 2048, 8
#: Pieces of one length that are numbered in one task.
CELL = 50_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"

_encoders: dict = {}


def encoder(path: str):
    """ids(text): those of the tokenizers file at path, by the faster library where its ranks lie beside it."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path.removesuffix(".json") + ".tiktoken", "rb"))}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        special = [t.content for t in slow.get_added_tokens_decoder().values()]

        def ids(text: str) -> np.ndarray:
            if any(s in text for s in special):
                return np.array(slow.encode(text, add_special_tokens=False).ids, "<u4")
            return np.array(fast.encode_ordinary(text), "<u4")

        _encoders[path] = ids
    return _encoders[path]


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of each piece of a document of n ids."""
    first = n - (max(1, -(-n // length)) - 1) * length
    return [(0, first)] + [(first + i * length, length) for i in range((n - first) // length)]


def pieces(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    import pyarrow as pa

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator):
        ids = encoder(path)
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.append(ids(text.as_py()), np.uint32(0)).astype("<u4")
                out += [(doc, i, s, n, zlib.crc32(x[s : s + n].tobytes())) for i, (s, n) in enumerate(cut(len(x), length))]
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema)], schema=schema)

    return rows.mapInArrow(run, PIECE)


def columns(cols: np.ndarray, n: int) -> np.ndarray:
    """Patterns as columns: how often each bin stands in them."""
    a = np.zeros((n, len(cols)))
    for slot in cols.T:
        np.add.at(a, (slot, np.arange(len(cols))), slot > 0)
    return a


def nnls(cols: np.ndarray, h: np.ndarray) -> np.ndarray:
    """min ||A x - h||, x >= 0, by active sets: column p of A counts the bins in cols[p] (0: none).

    At most as many patterns as bins are above zero, so rounding loses little.
    """
    x, passive = np.zeros(len(cols)), []
    used = cols > 0
    free = np.ones(len(cols), bool)
    tol = 1e-9 * max(1.0, float(np.abs(h).max(initial=0)))
    for _ in range(4 * len(h)):
        r = h - np.bincount(cols.ravel(), (x[:, None] * used).ravel(), len(h))
        w = np.where(free, (r[cols] * used).sum(axis=1), -np.inf)
        j = int(w.argmax()) if len(w) else 0
        if not len(w) or w[j] <= tol:
            break
        passive.append(j)
        free[j] = False
        while passive:
            s = np.linalg.lstsq(columns(cols[passive], len(h)), h, rcond=None)[0]
            if s.min() > tol:
                break
            now = x[passive]
            low = s <= tol
            step = np.min(now[low] / np.maximum(now[low] - s[low], 1e-300))
            x[passive] = np.maximum(now + step * (s - now), 0)
            gone = {p for p, v, bad in zip(passive, x[passive], low) if bad and v <= tol} or {passive[int(s.argmin())]}
            for p in gone:
                x[p] = 0
                free[p] = p != j
            passive = [p for p in passive if p not in gone]
        x[passive] = s if passive else 0
    return x


def whole(cols: np.ndarray, fit: np.ndarray, binned: np.ndarray) -> np.ndarray:
    """Whole repeat counts: the fitted ones rounded, greatest first, then one more of any pattern while its pieces last."""
    left = binned.astype(np.int64).copy()
    out = np.zeros(len(cols), np.int64)

    def take(p: int, most: int) -> None:
        bins, each = np.unique(cols[p][cols[p] > 0], return_counts=True)
        n = min(most, int((left[bins] // each).min()))
        if n > 0:
            out[p] += n
            left[bins] -= n * each

    for p in np.lexsort((np.arange(len(cols)), -fit)):
        if fit[p] <= 0:
            break
        take(p, int(fit[p] + 0.5))
    for p in np.flatnonzero(np.all((cols == 0) | (left[cols] > 0), axis=1)):
        take(p, int(left.max()))
    return out


def patterns(bins: int) -> np.ndarray:
    """Sets of one to three bins whose sizes add up to `bins`, padded with 0."""
    out = [(bins, 0, 0)] + [(a, bins - a, 0) for a in range(1, bins // 2 + 1)]
    out += [(a, b, bins - a - b) for a in range(1, bins // 3 + 1) for b in range(a, (bins - a) // 2 + 1)]
    return np.array(out)


def best_fit(hist: np.ndarray, length: int) -> list[tuple[int, list[int]]]:
    """hist[n]: pieces of length n.  (count, lengths) of equal sequences, longest first into the tightest space."""
    groups: list[list] = []  # [count, members as a linked list]
    spaces: list[int] = []
    by_space: dict[int, list[int]] = {}

    def put(space: int, g: int) -> None:
        if space not in by_space:
            by_space[space] = []
            insort(spaces, space)
        by_space[space].append(g)

    def opened(members, count: int, space: int) -> None:
        groups.append([count, members])
        put(space, len(groups) - 1)

    for n in range(length, 0, -1):
        c = int(hist[n])
        while c:
            i = bisect_left(spaces, n)
            if i < len(spaces):
                space = spaces[i]
                g = by_space[space].pop()
                if not by_space[space]:
                    del by_space[space]
                    spaces.pop(i)
                count, members = groups[g]
                k = min(c, count)
                if k < count:
                    groups[g][0] = count - k
                    put(space, g)
                    opened((members, n), k, space - n)
                else:
                    groups[g][1] = (members, n)
                    put(space - n, g)
                c -= k
                continue
            per = length // n
            for count, size in ((c // per, per), (1, c % per)):
                if count and size:
                    members = None
                    for _ in range(size):
                        members = (members, n)
                    opened(members, count, length - size * n)
            c = 0
    out = []
    for count, members in groups:
        lengths = []
        while members:
            members, n = members
            lengths.append(n)
        out.append((count, lengths[::-1]))
    return out


def plan(hist: np.ndarray, length: int = LENGTH, width: int = BIN) -> dict:
    """Where each (length, rank) goes.  Segments: the first rank, the sequence it goes to, the slot in it."""
    bins = length // width
    of = lambda n: -(-n // width)
    binned = np.zeros(bins + 1)
    for n in range(1, length + 1):
        binned[of(n)] += hist[n]
    pats = patterns(bins)
    pats = pats[np.all((pats == 0) | (binned[pats] > 0), axis=1)]
    x = whole(pats, nnls(pats, binned), binned)
    segments: dict = {}
    seq = 0
    at = np.zeros(bins + 1, np.int64)
    for p, count in zip(pats, x):
        if count:
            for slot, b in enumerate(b for b in p if b):
                segments.setdefault(("bin", int(b)), []).append((int(at[b]), seq, slot))
                at[b] += count
            seq += int(count)
    planned, before, rest = np.zeros(length + 1, np.int64), np.zeros(length + 1, np.int64), hist.copy()
    for b in range(1, bins + 1):
        left, done = int(min(at[b], binned[b])), 0
        for n in range(min(length, b * width), (b - 1) * width, -1):  # the longest of a bin first
            planned[n], before[n] = min(left, hist[n]), done
            left -= planned[n]
            done += planned[n]
    rest = hist - planned
    pos = np.zeros(length + 1, np.int64)
    for count, lengths in best_fit(rest, length):
        for slot, n in enumerate(lengths):
            segments.setdefault(("rest", n), []).append((int(pos[n]), seq, slot))
            pos[n] += count
        seq += count
    arrays = {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in segments.items()}
    return {"segments": arrays, "planned": planned, "before": before, "width": width, "sequences": seq, "fitted": int(planned.sum())}


def place(p: dict, n: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and slot of the pieces of length n with these ranks."""
    seq, slot = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
    first = ranks < p["planned"][n]
    for mask, key, idx in ((first, ("bin", -(-n // p["width"])), ranks + p["before"][n]), (~first, ("rest", n), ranks - p["planned"][n])):
        if mask.any():
            lo, base, s = p["segments"][key]
            i = np.searchsorted(lo, idx[mask], side="right") - 1
            seq[mask], slot[mask] = base[i] + idx[mask] - lo[i], s[i]
    return seq, slot


def pack(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row per piece."""
    spark = docs.sparkSession
    found = materialize(pieces(docs, path, length))
    counts = found.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most `length` rows
    hist = np.zeros(length + 1, np.int64)
    for r in counts:
        hist[r.length] = r.n
    p = spark.sparkContext.broadcast(plan(hist, length))
    # A length has as many cells as it needs to have some CELL pieces in each.
    cells = F.get(F.lit([max(1, -(-int(n) // CELL)) for n in hist]), F.col("length").cast("int"))
    key = F.xxhash64("doc_id", "piece", "ids_crc32", "start")
    rows = found.withColumn("_h", key).withColumn("_cell", F.pmod("_h", cells).cast("long"))
    per = rows.groupBy("length", "_cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("length", "_cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("length", "_cell").orderBy("_h", "doc_id", "piece", "start"))
    ranked = rows.withColumn("_r", number).join(checked_broadcast(starts), ["length", "_cell"])

    @F.pandas_udf("sequence_id long, slot long")
    def placed(n: pd.Series, rank: pd.Series) -> pd.DataFrame:
        out = np.empty((len(n), 2), np.int64)
        lengths, ranks = n.to_numpy(), rank.to_numpy()
        for v in np.unique(lengths):
            m = lengths == v
            out[m, 0], out[m, 1] = place(p.value, int(v), ranks[m])
        return pd.DataFrame({"sequence_id": out[:, 0], "slot": out[:, 1]})

    put = ranked.withColumn("_p", placed("length", (F.col("_before") + F.col("_r") - 1).cast("long")))
    put = put.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("_p.sequence_id").alias("sequence_id"), F.col("_p.slot").alias("_slot"))
    ahead = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return put.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0))).drop("_slot")
