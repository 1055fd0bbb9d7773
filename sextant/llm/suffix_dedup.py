"""Suffix-array dedup: every byte covered by a 200-byte string that also starts elsewhere is removed.

1. Texts that are wholly equal are brought together by md5; one of each goes on, with its count (a text that occurs
   twice and has 200 bytes is removed entirely, but still stands as a place where others' strings may occur).
2. Anchors: over every 200-byte window the 50-byte grams with the smallest hash are chosen.  The choice depends on the
   window's bytes alone, so two equal windows choose the same grams at the same places: each repeated string holds an
   anchor whose hash occurs at least twice.  The hashes of each text are written once; those that occur twice are joined
   back and gathered by text, so that the other anchors are dropped where the texts are read.  Nothing that grows with the
   corpus is broadcast or collected.
3. The remaining anchors get their context, up to 150 bytes before and 200 from the anchor, and meet by hash.  The
   suffixes that start at the anchors are sorted deep-shallow: multikey quicksort to a shallow depth, then blind tries
   for groups that still agree.  On the LCP intervals of that order the longest common extension to the left is found
   by a second sort; left + right >= 200 covers the bytes between.
4. Anchors that stand at more than CROWDED places aren't brought together by hash.  Their distinct contexts are divided
   by halves of the windows around the anchor (0 to 150 bytes before it): a pair that shares a window shares all bytes
   that every window of its half has, so each half is a cell keyed by those bytes.  Cells of one context go, cells of up
   to CROWDED are solved as in 3, others are halved again, down to one window, whose bytes are then equal (by md5).
5. Covers of a text are merged and cut out.

Matching is exact (hashes only choose places to look at) and doesn't cross texts.  Null text is empty: nothing to
remove, the hash of no bytes.  Repeated rows and null ids: the result depends on the text and its count.  A very long text
is one row; of the contexts that it holds often (a run of one letter) one is kept at a time.  Ties can't occur: a byte is
covered or not.  An empty table gives an empty result.  Other columns are carried along, whatever their names; those of
the names that are added are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import fresh, materialize

SPAN, GRAM, SHALLOW = 200, 50, 96
#: Most crowded hashes that are broadcast (8 MB); if there are more, the texts are joined with them.
HOT = 1_000_000
#: Most places of an anchor, or contexts of a cell, that are solved in one task (350 bytes each: 35 MB).
CROWDED = 100_000
#: Tasks that the rows of one join key are dealt to.
SALTS = 16
LEFT = SPAN - GRAM
BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i < n."""
    key = int(base)
    if len(_powers.get(key, ())) < n:
        p = np.full(max(n, 2 * BLOCK), base, np.uint64)
        p[0] = 1
        _powers[key] = np.multiply.accumulate(p)
    return _powers[key][:n]


def gram_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """A mixed 64-bit hash of each k bytes of x."""
    c = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(_power(_BASE, len(x)) * (x.astype(np.uint64) + np.uint64(1)), out=c[1:])
    h = (c[k:] - c[:-k]) * _power(_INVERSE, len(x) - k + 1)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def sliding(a: np.ndarray, w: int, op, fill) -> np.ndarray:
    """op over every w neighbours: block prefixes and suffixes."""
    n = len(a) - w + 1
    m = -(-len(a) // w) * w
    b = np.full(m, fill, a.dtype)
    b[: len(a)] = a
    b = b.reshape(-1, w)
    ahead = op.accumulate(b, axis=1).reshape(-1)
    back = op.accumulate(b[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return op(back[:n], ahead[w - 1 : w - 1 + n])


def anchors(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, hashes) of each text: the grams with the smallest hash of some whole window."""
    out = []
    windows = SPAN - GRAM + 1
    x = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    if len(x) < SPAN:
        return [(np.zeros(0, np.int64), np.zeros(0, np.uint64))] * len(texts)
    h = gram_hashes(x, GRAM)
    low = sliding(h, windows, np.minimum, np.iinfo(np.uint64).max)  # of the window that starts here
    ends = np.cumsum(sizes)
    for e in ends:  # windows that leave their text don't count
        low[max(0, e - SPAN + 1) : e] = 0
    high = sliding(np.concatenate([np.zeros(windows - 1, np.uint64), low, np.zeros(windows - 1, np.uint64)]), windows, np.maximum, 0)[: len(h)]
    chosen = np.flatnonzero((high == h) & (high > 0))
    cut = np.searchsorted(chosen, np.concatenate([[0], ends]))
    for i, e in enumerate(ends):
        p = chosen[cut[i] : cut[i + 1]]
        out.append((p - (e - sizes[i]), h[p]))
    return out


def common(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    if a == b:
        return n
    return n - ((int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length() + 7) // 8


class BlindTrie:
    """Strings by their branching bytes only; a full comparison is made once per inserted string."""

    def __init__(self, keys: list[bytes]):
        self.keys, self.root = keys, None

    def _byte(self, i: int, depth: int) -> int:
        k = self.keys[i]
        return k[depth] if depth < len(k) else -1

    def insert(self, i: int) -> None:
        """Nodes: [depth, {byte: node or [keys of one string]}]; a leaf is a list of equal strings."""
        if self.root is None:
            self.root = (None, [i])
            return
        path, node = [], self.root
        while node[0] is not None:  # blind descent: an absent byte goes anywhere
            path.append(node)
            b = self._byte(i, node[0])
            node = node[1].get(b) or next(iter(node[1].values()))
        depth = common(self.keys[i], self.keys[node[1][0]])
        if depth == len(self.keys[i]) == len(self.keys[node[1][0]]):
            node[1].append(i)
            return
        above = None
        for n in path:
            if n[0] >= depth:
                break
            above = n
        b = self._byte(i, depth)
        below = self.root if above is None else above[1][self._byte(i, above[0])]
        if below[0] == depth:
            below[1][b] = (None, [i])
            return
        first = below
        while first[0] is not None:
            first = next(iter(first[1].values()))
        new = (depth, {self._byte(first[1][0], depth): below, b: (None, [i])})
        if above is None:
            self.root = new
        else:
            above[1][self._byte(i, above[0])] = new

    def ordered(self) -> Iterator[tuple[int, int]]:
        """(string, common length with the one before it), in order; 0 for the first."""
        stack = [(self.root, 0)]
        while stack:
            node, lcp = stack.pop()
            if node is None:
                continue
            if node[0] is None:
                for j, i in enumerate(node[1]):
                    yield i, lcp if j == 0 else len(self.keys[i])
                continue
            kids = [node[1][b] for b in sorted(node[1])]
            stack += [(kid, node[0]) for kid in kids[:0:-1]]
            stack.append((kids[0], lcp))


def deep_shallow_sort(keys: list[bytes], shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """(order, lcp): indexes in byte order, and each one's common length with its predecessor (0 for the first)."""
    order: list[int] = []
    lcps: list[int] = []
    start = common(min(keys), max(keys)) if keys else 0
    stack = [(list(range(len(keys))), start, 0)] if keys else []
    while stack:
        group, depth, lcp = stack.pop()
        if len(group) == 1:
            order.append(group[0])
            lcps.append(lcp)
            continue
        if depth >= shallow:
            trie = BlindTrie(keys)
            for i in group:
                trie.insert(i)
            for j, (i, n) in enumerate(trie.ordered()):
                order.append(i)
                lcps.append(n if j else lcp)
            continue
        at = lambda i: keys[i][depth] if depth < len(keys[i]) else -1
        pivot = at(group[len(group) // 2])
        less, same, more = [], [], []
        for i in group:
            b = at(i)
            (same if b == pivot else less if b < pivot else more).append(i)
        parts = [(less, depth), (same, depth if pivot < 0 else depth + 1), (more, depth)]
        if pivot < 0 and len(same) > 1:  # strings that end here are equal
            parts[1] = None
        out, first = [], True
        for p in parts:
            if p is None:
                out.append(("equal", same, lcp if first else depth))
            elif p[0]:
                out.append((p[0], p[1], lcp if first else depth))
            else:
                continue
            first = False
        for item in reversed(out):
            if item[0] == "equal":
                # A string that ends at this depth is the least of its group, so nothing smaller is still to come.
                stack.extend(([i], depth, depth if j else item[2]) for j, i in reversed(list(enumerate(item[1]))))
            else:
                stack.append(item)
    return order, lcps


def covers(group: list[tuple[bytes, int]]) -> list[tuple[int, int]]:
    """(left, right) covered bytes around the anchor of each context (bytes, bytes before the anchor); (0, 0): none."""
    index: dict[tuple[bytes, int], int] = {}
    of = [index.setdefault(c, len(index)) for c in group]
    counts = np.bincount(of)
    unique = list(index)
    left = [c[:k][::-1] for c, k in unique]
    right = [c[k:] for c, k in unique]
    best = [[0, 0] for _ in unique]
    for i, n in enumerate(counts):
        if n > 1 and len(left[i]) + len(right[i]) >= SPAN:
            best[i] = [len(left[i]), len(right[i])]
    if len(unique) == 2:
        a, b = common(left[0], left[1]), common(right[0], right[1])
        if a + b >= SPAN:
            best = [[max(x, a), max(y, b)] for x, y in best]
    elif len(unique) > 2:
        order, lcp = deep_shallow_sort(right)
        stack = [(0, len(order))]
        while stack:
            lo, hi = stack.pop()
            if hi - lo < 2:
                continue
            depth = min(lcp[lo + 1 : hi])
            if depth + LEFT >= SPAN:
                by_left = sorted(order[lo:hi], key=left.__getitem__)
                near = [common(left[p], left[q]) for p, q in zip(by_left, by_left[1:])]
                for j, i in enumerate(by_left):
                    a = max(near[j - 1] if j else 0, near[j] if j < len(near) else 0)
                    if a + depth >= SPAN:
                        b = best[i]
                        b[0], b[1] = max(b[0], a), max(b[1], depth)
            at = lo
            for j in range(lo + 1, hi + 1):
                if j == hi or lcp[j] == depth:
                    stack.append((at, j))
                    at = j
    return [tuple(best[i]) for i in of]


def merged(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(parts):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def _batched(rows: Iterator, make, names: list[str], types: list, size: int = 4000):
    """Arrow batches of the tuples that make(row) yields."""
    import pyarrow as pa

    held: list[tuple] = []

    def out():
        cols = list(zip(*held)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    for row in rows:
        for made in make(row):
            held.append(made)
            if len(held) >= size:
                yield out()
                held = []
    yield out()


def _rows(batches: Iterator) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _texts_in_blocks(batches: Iterator) -> Iterator[list[tuple[bytes, bytes]]]:
    """(key, bytes) of the texts that are long enough, BLOCK bytes or one text at a time."""
    held: list[tuple[bytes, bytes]] = []
    size = 0
    for b in batches:
        for k, t in zip(b.column(0), b.column(1)):
            x = t.as_py().encode()
            if len(x) >= SPAN:
                held.append((k.as_py(), x))
                size += len(x)
                if size >= BLOCK:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def text_hashes(keyed: DataFrame) -> DataFrame:
    """(h, th, n): the distinct hashes of each text's anchors and how often it has them.  keyed: th, text.
    A text that comes again in the same task is passed over; in others it may be given again."""
    import pyarrow as pa

    def find(batches):
        seen: set[bytes] = set()
        for held in _texts_in_blocks(batches):
            held = [x for x in dict(held).items() if x[0] not in seen]
            seen.update(k for k, _ in held)
            hs, ks, ns = [np.zeros(0, np.int64)], [], [np.zeros(0, np.int32)]
            for (k, _), (_, h) in zip(held, anchors([t for _, t in held])):
                u, n = np.unique(h, return_counts=True)
                hs.append(u.view(np.int64))
                ks += [k] * len(u)
                ns.append(n.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs)), pa.array(ks, pa.binary()), pa.array(np.concatenate(ns))], names=["h", "th", "n"])

    return keyed.mapInArrow(find, "h long, th binary, n int")


def repeated_hashes(found: DataFrame, crowded: int) -> DataFrame:
    """(h, hot): hashes of anchors found at two places, equal texts counting as one; hot: at more than crowded places."""
    by = found.groupBy("h").agg(F.min("th").alias("lo"), F.max("th").alias("hi"), F.max("n").alias("most"), F.sum("n").alias("places"))
    return by.where("lo <> hi or most > 1").select("h", (F.col("places") > crowded).alias("hot"))


def _runs(batches: Iterator) -> Iterator[list[tuple]]:
    """Groups of rows that come sorted by their first column."""
    key, group = None, []
    for row in _rows(batches):
        if row[0] != key and group:
            yield group
            group = []
        key = row[0]
        group.append(row)
    if group:
        yield group


def _dealt(rows: DataFrame, small: DataFrame, key: str, *by: str) -> DataFrame:
    """rows joined with small on key; the rows of one key are dealt to SALTS tasks by the columns by."""
    small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(SALTS))).join(small, [key, "_salt"]).drop("_salt")


def crowded_parts(contexts: DataFrame, crowded: int) -> DataFrame:
    """(th, s, e) for the contexts of crowded anchors: the division by windows told above."""
    import pyarrow as pa

    def solve(batches):
        def best(group):
            for r, (a, b) in zip(group, covers([(r[3], r[2]) for r in group]) if len(group) > 1 else ()):
                if b:
                    yield r[1], a, b

        yield from _batched(_runs(batches), best, ["ck", "a", "b"], [pa.binary(), pa.int32(), pa.int32()])

    cell = lambda *parts: F.unhex(F.md5(F.concat(*parts)))
    tag = lambda *cols: F.encode(F.concat_ws(":", *cols, F.lit("")), "UTF-8")
    rows = materialize(contexts.withColumn("ck", cell(tag("h", "k"), F.col("ctx"))))
    own = rows.where("ctx is null").select("th", F.col("pos").alias("s"), (F.col("pos") + F.col("k")).alias("e"))
    places = rows.where("ctx is not null")
    # Equal contexts meet in the map-side part of this aggregation.
    classes = materialize(places.groupBy("ck").agg(F.first("h").alias("h"), F.first("k").alias("k"), F.first("ctx").alias("ctx"), F.count("*").alias("m")))
    size = F.length("ctx")
    found = classes.where((F.col("m") > 1) & (size >= SPAN)).select("ck", F.col("k").alias("a"), (size - F.col("k")).alias("b"))
    cells = classes.select("ck", "k", "ctx", F.encode(F.col("h").cast("string"), "UTF-8").alias("cell"), F.lit(0).alias("lo"), F.lit(LEFT).alias("hi"))
    while True:
        sizes = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
        cells = materialize(_dealt(cells, sizes, "cell", "ck"))
        small = cells.where((F.col("n") <= crowded) & (F.col("lo") < F.col("hi"))).select("cell", "ck", "k", "ctx")
        found = found.unionByName(small.repartition("cell").sortWithinPartitions("cell").mapInArrow(solve, "ck binary, a int, b int"))
        found = found.unionByName(cells.where("lo = hi").select("ck", F.col("lo").alias("a"), (SPAN - F.col("lo")).alias("b")))
        big = cells.where((F.col("n") > crowded) & (F.col("lo") < F.col("hi")))
        if not big.limit(1).count():
            break
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.explode(F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct((mid + 1).alias("lo"), F.col("hi").alias("hi")))).alias("w")
        big = big.select("ck", "k", "ctx", "cell", halves).select("ck", "k", "ctx", "cell", "w.lo", "w.hi")
        big = big.where((F.col("k") >= F.col("lo")) & (size - F.col("k") >= SPAN - F.col("hi")))
        shared = F.substring("ctx", F.col("k") - F.col("lo") + 1, SPAN - F.col("hi") + F.col("lo"))
        cells = big.withColumn("cell", cell(F.col("cell"), tag("lo", "hi"), shared))
    best = found.groupBy("ck").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    covered = _dealt(places.select("th", "pos", "ck"), best, "ck", "th", "pos")
    return own.unionByName(covered.select("th", (F.col("pos") - F.col("a")).alias("s"), (F.col("pos") + F.col("b")).alias("e")))


def once(th: bytes, rows: Iterator[tuple]) -> Iterator[tuple]:
    """A context that a text holds twice covers itself: its places are merged here, and one goes on for other texts.
    rows come by place; no more than the distinct contexts are held."""
    seen: dict[tuple, bool] = {}
    own: list[list[int]] = []
    for r in rows:
        key = (r[0], r[3], r[4])
        if key not in seen:
            seen[key] = r[2] - r[3]
            yield r
        elif len(r[4]) >= SPAN:
            for s in (seen[key], r[2] - r[3]):
                if s is None:
                    continue
                if own and own[-1][0] <= s <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], s + len(r[4]))
                else:
                    own.append([s, s + len(r[4])])
            seen[key] = None  # the first place is told
    salt = int.from_bytes(th[:8], "big", signed=True)
    for s, e in merged([tuple(x) for x in own]):  # no context: start and length; dealt by a value of the text's own
        yield salt, th, s, e - s, None


def removed_spans(docs: DataFrame, crowded: int = CROWDED, most_hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(texts: th, text, n; spans: th, spans array of (s, e), unmerged) of the distinct texts of docs."""
    import pyarrow as pa

    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.unhex(F.md5(text)).alias("th"), text.alias("text"))
    # The text is shuffled once: both uses below read the same exchange, so both take the same columns and the same filter
    # (an inner join would add this one to its own side alone).
    texts = keyed.where("th is not null").groupBy("th").agg(F.first("text").alias("text"), F.count("*").alias("n"))
    names, types = ["h", "th", "pos", "k", "ctx"], [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]
    context = "h long, th binary, pos int, k int, ctx binary"

    def around(th, x, pos, h):
        s = max(0, pos - LEFT)
        return h, th, pos, pos - s, x[s : pos + SPAN]

    def cut(th, x, p, h, keep):
        return once(th, (around(th, x, i, j) for i, j in zip(p[keep].tolist(), h[keep].view(np.int64).tolist())))

    found = materialize(text_hashes(keyed))
    twice = materialize(repeated_hashes(found, crowded))
    listed = found.select("h", "th").join(twice, "h").groupBy("th")

    def contexts(crowd):
        """From the distinct texts, each with the hashes it should look for."""
        at = listed.agg(F.collect_set(F.when(F.col("hot") == crowd, F.col("h"))).alias("a")).where(F.size("a") > 0)

        def block(held):
            for (th, x, wanted), (p, h) in zip(held, anchors([x for _, x, _ in held])):
                yield from cut(th, x, p, h, np.isin(h.view(np.int64), wanted))

        def blocks(batches):
            held, size = [], 0
            for b in batches:
                for th, t, wanted in zip(b.column(0), b.column(1), b.column(3)):
                    held.append((th.as_py(), t.as_py().encode(), wanted.values.to_numpy()))
                    size += len(held[-1][1])
                    if size >= BLOCK:
                        yield held
                        held, size = [], 0
            yield held

        def find(batches):
            return _batched(blocks(batches), block, names, types)

        return texts.where("n > 0").join(at, "th").select("th", "text", "n", "a").mapInArrow(find, context)

    def hot_contexts(hot):
        """Of the crowded hashes, read from the rows rather than from all texts shuffled again."""
        shared = docs.sparkSession.sparkContext.broadcast(hot)

        def find(batches):
            seen: set[bytes] = set()
            for held in _texts_in_blocks(batches):
                held = [x for x in dict(held).items() if x[0] not in seen]
                seen.update(k for k, _ in held)
                for (th, x), (p, h) in zip(held, anchors([t for _, t in held])):
                    keep = np.isin(h.view(np.int64), shared.value)
                    if keep.any():
                        yield from _batched(cut(th, x, p, h, keep), lambda r: (r,), names, types)

        return keyed.mapInArrow(find, context).dropDuplicates(["h", "th", "pos", "k"])

    def meet(batches):
        def solve(group):
            yield from ((r[1], r[2], r[2] + r[3]) for r in group if r[4] is None)
            group = [r for r in group if r[4] is not None]
            if len(group) > 1:
                for (_, th, pos, _, _), (a, b) in zip(group, covers([(r[4], r[3]) for r in group])):
                    if b:
                        yield th, pos - a, pos + b

        yield from _batched(_runs(batches), solve, ["th", "s", "e"], [pa.binary(), pa.int32(), pa.int32()])

    parts = contexts(False).repartition("h").sortWithinPartitions("h").mapInArrow(meet, "th binary, s int, e int")
    hot = [r.h for r in twice.where("hot").select("h").limit(most_hot + 1).collect()]
    if hot:
        parts = parts.unionByName(crowded_parts(hot_contexts(np.array(sorted(hot))) if len(hot) <= most_hot else contexts(True), crowded))
    return texts, parts.groupBy("th").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def _result(docs: DataFrame, with_text: bool, crowded: int, most_hot: int) -> DataFrame:
    import pyarrow as pa

    texts, spans = removed_spans(docs, crowded, most_hot)

    def cut(row):
        th, t, n, a = row
        x = t.encode()
        parts = [(0, len(x))] if n > 1 and len(x) >= SPAN else merged([(p["s"], p["e"]) for p in a or ()])
        if parts:
            kept, at = [], 0
            for s, e in parts:
                kept.append(x[at:s])
                at = e
            kept = b"".join([*kept, x[at:]])
        else:
            kept = x
        more = (kept.decode(errors="ignore"),) if with_text else ()
        yield (th, len(x), len(x) - len(kept), len(parts), hashlib.sha256(kept).hexdigest(), *more)

    names = ["th", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * with_text
    types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.string()] * with_text
    ddl = "th binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
    return texts.join(spans, "th", "left").select("th", "text", "n", "spans").mapInArrow(lambda b: _batched(_rows(b), cut, names, types, 500), ddl)


def suffix_dedup(docs: DataFrame, with_text: bool = False, crowded: int = CROWDED, most_hot: int = HOT) -> DataFrame:
    """The rows of docs (without text) with n_bytes, n_removed, n_spans, kept_sha256 (and kept_text, valid UTF-8)."""
    extra = [c for c in docs.columns if c not in ("text", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")]
    key = fresh([*docs.columns, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"], "th")[0]
    keyed = docs.select(*extra, F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias(key))
    return keyed.join(_result(docs, with_text, crowded, most_hot).withColumnRenamed("th", key), key).drop(key)
