"""Language-model scoring: prediction by partial matching over bytes, next to a smoothed unigram base score.

The model is a trie of byte contexts of up to ORDER bytes that run across words and lines; three things happen at each
byte (END closes a text).  The longest context that training holds predicts the symbol by its count less a half; if it
doesn't hold the symbol, it escapes with half a count for each kind of symbol it holds (method D), and the next shorter
context predicts from what is left after the symbols just passed over are excluded.  Below order 0 all bytes not yet
excluded are equally likely.  The code length of a text is the sum of its bytes' log10 probabilities.

ByteTrie is the model in plain Python, adaptive (it learns each byte after coding it) or pretrained.  lm_scores is the
pretrained model for whole corpora, where neither the counts nor the texts fit in one place:

1. Low orders.  Orders LOW and below are at most 256 ** (LOW + 1) counts by construction, whatever the corpus: they are
   counted first, gathered and broadcast.
2. Counts.  Each task counts the strings of ORDER + 1 bytes of its training texts; they are dealt to parts by the last
   LOW + 1 bytes of the context and summed there (in two levels, if there are many tasks).  A part so holds every longer
   context whose shorter ones it holds, down to order LOW + 1.  A context of LOW + 1 bytes that occurs more often than
   1 / SHARE of a part's mean (so there are fewer of them than SHARE * parts) is divided: its strings are dealt by one
   more byte, which leaves at most 256 ** (ORDER - LOW - 1) strings together, and the counts of the divided contexts at
   order LOW + 1, at most 256 each, are broadcast beside the low orders.  Word counts for the base are dealt to the same parts by a hash of the word.
   A part is given out in rows of at most HELD strings.
3. Questions.  Documents are dealt to blocks of about BLOCK bytes.  A block asks each part for its distinct strings and
   words; the part answers with their log probabilities and counts, worked out in numpy level by level.
4. Scores.  A block's documents meet the answers, and the log probabilities are summed.  A string without an answer is
   an error: documents that read differently the second time don't get wrong scores.
Nothing that grows with the corpus is broadcast or collected, and no context is dropped.

Null texts are empty: END alone is scored.  A null id counts as the empty text in the fold.  Repeated rows are scored
each and equal texts score alike (a block is dealt by row, so that equal rows don't meet in one).  Very long texts are
counted and scored SEGMENT bytes at a time.  An empty table gives an empty result.  With no training text the base is
log10 of 0.1 / 0.1 (that is 0) per token and the model is uniform over bytes.  Given columns of the names that are added
are replaced; all others are carried along.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import fold, fresh, materialize

#: Bytes of the longest context (a string of ORDER + 1 bytes fills a 64-bit number at most), and of the broadcast ones.
ORDER, LOW = 6, 2
#: Bytes of text in a block, and in one step of counting or scoring.
BLOCK, SEGMENT = 8 << 20, 2 << 20
#: Distinct strings that a task holds before it gives them out, and tasks that a part hears directly.
HELD, FAN_IN = 4_000_000, 64
#: A context is divided from 1 / SHARE of a part's mean on: strings repeat, so a frequent one may hold more than its share.
SHARE = 4
#: Closes a text; no byte of UTF-8.
END = 255
ADDED = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


class ByteTrie:
    """Counts of every context of up to `order` bytes; a context at the start of a text is padded with zero bytes."""

    def __init__(self, order: int = ORDER):
        self.order, self.counts = order, {}

    def _context(self, past: bytes) -> bytes:
        return (b"\0" * self.order + past)[len(past) :]

    def learn(self, past: bytes, symbol: int) -> None:
        c = self._context(past)
        for k in range(self.order + 1):
            node = self.counts.setdefault(c[self.order - k :], {})
            node[symbol] = node.get(symbol, 0) + 1

    def train(self, text: bytes) -> None:
        for i, s in enumerate([*text, END]):
            self.learn(text[max(0, i - self.order) : i], s)

    def probability(self, past: bytes, symbol: int) -> float:
        c, mass, excluded = self._context(past), 1.0, set()
        for k in range(self.order, -1, -1):
            node = {s: n for s, n in self.counts.get(c[self.order - k :], {}).items() if s not in excluded}
            if not node:
                continue
            # Where every byte has been seen there is nothing to escape to.
            half = 0.0 if len(node) + len(excluded) == 256 else 0.5
            if symbol in node:
                return mass * (node[symbol] - half) / sum(node.values())
            mass *= half * len(node) / sum(node.values())
            excluded |= node.keys()
        return mass / (256 - len(excluded))

    def log10(self, text: bytes, adaptive: bool = False) -> float:
        """log10 probability of a text and its end; adaptive: each byte is learned after it is coded."""
        total = 0.0
        for i, s in enumerate([*text, END]):
            past = text[max(0, i - self.order) : i]
            total += math.log10(self.probability(past, s))
            if adaptive:
                self.learn(past, s)
        return total


def grams(texts: list[bytes], order: int = ORDER) -> Iterator[np.ndarray]:
    """Every byte and END of the texts, with the `order` bytes before it, as numbers: at most SEGMENT of them at a time."""
    end = bytes([END])
    data = b"".join(b"\0" * order + t + end for t in texts)
    x = np.frombuffer(data, np.uint8)
    skip = np.zeros(len(x), bool)
    starts = np.cumsum([0] + [len(t) + order + 1 for t in texts[:-1]]) if texts else np.zeros(0, int)
    for k in range(order):
        skip[starts + k] = True
    for a in range(order, len(x), SEGMENT):
        b = min(a + SEGMENT, len(x))
        g = np.zeros(b - a, np.uint64)
        for k in range(order, -1, -1):
            g = (g << np.uint64(8)) | x[a - k : b - k]
        yield g[~skip[a:b]]


def add_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    u, row = np.unique(np.concatenate([np.zeros(0, np.uint64), *keys]), return_inverse=True)
    return u, np.bincount(row, np.concatenate([np.zeros(0), *counts]), len(u)).astype(np.int64)


def pack(a: np.ndarray) -> bytes:
    """Eight-byte (or four-byte) numbers by planes of their bytes, compressed."""
    return zlib.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes(), 1)


def unpack(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(b), np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=np.zeros(1, a.dtype)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, np.uint64), dtype=np.uint64)


def pack_words(words: list[bytes]) -> bytes:
    return zlib.compress(b" ".join(words), 1)


def unpack_words(b: bytes) -> list[bytes]:
    return zlib.decompress(b).split()


def by_part(g: np.ndarray, parts: int, divided: np.ndarray) -> list[np.ndarray]:
    """Places in g of the strings of each part, in their order; divided: sorted contexts of LOW + 1 bytes."""
    context = g >> np.uint64(8)
    c = context & np.uint64(256 ** (LOW + 1) - 1)
    if len(divided):
        c = np.where(place(divided, c)[1], context & np.uint64(256 ** (LOW + 2) - 1), c)
    part = (((c * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return np.split(order, np.searchsorted(part[order], np.arange(1, parts)))


def words_by_part(words, parts: int) -> list[list[bytes]]:
    out: list[list[bytes]] = [[] for _ in range(parts)]
    for w in sorted(words):
        out[zlib.crc32(w) % parts].append(w)
    return out


class Level:
    """Counts of (context, symbol) of one order: per context its total and its kinds of symbols."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts.astype(np.float64)
        self.contexts, self.row = np.unique(keys >> np.uint64(8), return_inverse=True)
        self.total = np.bincount(self.row, self.counts, len(self.contexts))
        self.kinds = np.bincount(self.row, minlength=len(self.contexts))

    def shorter(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and counts of the next order down, to `order` bytes of context."""
        return add_up([self.keys & np.uint64(256 ** (order + 1) - 1)], [self.counts])


def place(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands, and whether it does."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def low_levels(keys: np.ndarray, counts: np.ndarray) -> list[Level]:
    """Levels of orders 0 to LOW from the counts of order LOW."""
    levels = [Level(keys, counts)]
    for k in range(LOW - 1, -1, -1):
        levels.insert(0, Level(*levels[0].shorter(k)))
    return levels


class PartialMatching:
    """The levels of one part: its own orders above LOW, the shared ones, and order LOW + 1 of divided contexts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, low: list[Level], divided: Level | None = None, order: int = ORDER):
        own = [Level(keys, counts)]
        for k in range(order - 1, LOW, -1):
            own.insert(0, Level(*own[0].shorter(k)))
        if divided is not None and len(divided.keys):
            # Of a divided context the part holds some strings only.
            rest = ~place(divided.contexts, own[0].keys >> np.uint64(8))[1]
            own[0] = Level(*add_up([own[0].keys[rest], divided.keys], [own[0].counts[rest], divided.counts]))
        self.levels = [*low, *own]
        #: Counts in the next order down of the symbols that each context holds.
        self.passed = []
        for k in range(order):
            upper, lower = self.levels[k + 1], self.levels[k]
            at, _ = place(lower.keys, upper.keys & np.uint64(256 ** (k + 1) - 1))
            self.passed.append(np.bincount(upper.row, lower.counts[at], len(upper.contexts)) if len(upper.keys) else np.zeros(0))

    def log10(self, g: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each string after the bytes before it."""
        out = np.zeros(len(g))
        left = np.arange(len(g))
        above = None  # places and hits in the contexts of the order above
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            x = g[left] & np.uint64(256 ** (k + 1) - 1)
            c, known = place(level.contexts, x >> np.uint64(8))
            at, hit = place(level.keys, x)
            if len(level.keys):
                total, kinds, count = np.where(known, level.total[c], 0.0), np.where(known, level.kinds[c], 0), level.counts[at]
            else:
                total, kinds, count = np.zeros(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
            half = np.where(kinds == 256, 0.0, 0.5)
            if above is not None and len(self.levels[k + 1].keys):
                total = total - np.where(above[1], self.passed[k][above[0]], 0.0)
                kinds = kinds - np.where(above[1], self.levels[k + 1].kinds[above[0]], 0)
            live = kinds > 0
            with np.errstate(divide="ignore", invalid="ignore"):
                step = np.where(hit, (count - half) / total, half * kinds / total)
                out[left] += np.where(live, np.log10(step), 0.0)
            if k == 0:
                out[left[~hit]] -= np.log10(256 - (len(level.keys)))
            left, above = left[~hit], (c[~hit], known[~hit])
        return out


def low_counts(train: DataFrame) -> list[Level]:
    """The levels of the low orders: at most 256 ** (LOW + 1) rows reach the driver."""
    import pyarrow as pa

    def run(batches: Iterator):
        keys, counts, texts, size = [], [], [], 0

        def count():
            nonlocal keys, counts, texts, size
            for g in grams(texts, LOW):
                u, n = np.unique(g.astype(np.uint32), return_counts=True)
                keys.append(u.astype(np.uint64))
                counts.append(n)
            u, n = add_up(keys, counts)
            keys, counts, texts, size = [u], [n], [], 0

        for b in batches:
            for t in b.column(0):
                texts.append(t.as_py().encode().lower())
                size += len(texts[-1])
                if size >= SEGMENT:
                    count()
        count()
        yield pa.RecordBatch.from_arrays([pa.array(keys[0].astype(np.int64)), pa.array(counts[0])], names=["k", "n"])

    t = train.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    k, n = t.column("k").to_numpy(), t.column("n").to_numpy()
    order = np.argsort(k)
    return low_levels(k[order].astype(np.uint64), n[order])


def frequent(low: list[Level], parts: int) -> np.ndarray:
    """The contexts of LOW + 1 bytes to divide, sorted: the strings of order LOW are those contexts."""
    top = low[LOW]
    return top.keys[top.counts * parts * SHARE > top.counts.sum()] if parts > 1 else top.keys[:0]


def counted(train: DataFrame, parts: int, divided: np.ndarray) -> DataFrame:
    """(part, g, gc, w, wc): packed strings and words with their counts; a part has a row for every HELD strings."""
    import pyarrow as pa

    def run(batches: Iterator):
        keys, counts, words, texts, size = [], [], Counter(), [], 0

        def count():
            for g in grams(texts):
                u, n = np.unique(g, return_counts=True)
                keys.append(u)
                counts.append(n)
            for t in texts:
                words.update(t.split())

        def out():
            u, n = add_up(keys, counts)
            dealt = words_by_part(words, parts)
            rows = [(i, pack_sorted(u[at]), pack(n[at]), pack_words(w), pack(np.array([words[x] for x in w], np.int64))) for i, (at, w) in enumerate(zip(by_part(u, parts, divided), dealt)) if len(at) or w]
            return _batch(rows)

        for b in batches:
            for t in b.column(0):
                texts.append(t.as_py().encode().lower())
                size += len(texts[-1])
                if size >= SEGMENT:
                    count()
                    texts, size = [], 0
                    if len(keys) > 1 and sum(map(len, keys)) > HELD:
                        u, n = add_up(keys, counts)
                        keys, counts = [u], [n]
                    if sum(map(len, keys)) > HELD or len(words) > HELD // 8:
                        yield out()
                        keys, counts, words = [], [], Counter()
        count()
        yield out()

    def _batch(rows):
        cols = list(zip(*rows)) or [[]] * 5
        types = [pa.int32(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["part", "g", "gc", "w", "wc"])

    def merge(batches: Iterator):
        """Rows of one part come together; sums of them."""
        held, part = [], None

        def total():
            keys, counts, words, n = [], [], Counter(), 0
            for r in held:
                keys.append(unpack_sorted(r[0]))
                counts.append(unpack(r[1], np.int64))
                n += len(keys[-1])
                if n > HELD:
                    u, c = add_up(keys, counts)
                    keys, counts, n = [u], [c], 0
                for x, m in zip(unpack_words(r[2]), unpack(r[3], np.int64).tolist()):
                    words[x] += m
            u, c = add_up(keys, counts)
            w = sorted(words)
            for i in range(max(1, -(-len(u) // HELD), -(-len(w) // (HELD // 8)))):
                a, b = slice(i * HELD, (i + 1) * HELD), slice(i * (HELD // 8), (i + 1) * (HELD // 8))
                yield _batch([(part, pack_sorted(u[a]), pack(c[a]), pack_words(w[b]), pack(np.array([words[x] for x in w[b]], np.int64)))])

        for b in batches:
            at = b.schema.get_field_index("part")
            cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("g", "gc", "w", "wc")]
            for p, *row in zip(b.column(at).to_pylist(), *cols):
                if p != part:
                    if held:
                        yield from total()
                    held, part = [], p
                held.append(row)
        if held:
            yield from total()

    schema = "part int, g binary, gc binary, w binary, wc binary"
    rows = train.mapInArrow(run, schema)
    salts = -(-train.rdd.getNumPartitions() // FAN_IN)
    if salts > 1:
        salted = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        rows = salted.repartition("part", "salt").sortWithinPartitions("part", "salt").mapInArrow(merge, schema)
    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(merge, schema)


def totals(counts: DataFrame, divided: np.ndarray) -> tuple[int, int, Level]:
    """Words, distinct words, and order LOW + 1 of the divided contexts: at most 256 rows a context reach the driver."""
    import pyarrow as pa

    def run(batches: Iterator):
        for b in batches:
            for g, gc, wc in zip(*(b.column(i).to_pylist() for i in range(3))):
                m = unpack(wc, np.int64)
                u, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                if len(divided):
                    u = unpack_sorted(g)
                    of = place(divided, (u >> np.uint64(8)) & np.uint64(256 ** (LOW + 1) - 1))[1]
                    u, n = add_up([u[of] & np.uint64(256 ** (LOW + 2) - 1)], [unpack(gc, np.int64)[of]])
                keys = pa.array([*u.astype(np.int64).tolist(), -1, -2], pa.int64())
                yield pa.RecordBatch.from_arrays([keys, pa.array([*n.tolist(), int(m.sum()), len(m)], pa.int64())], names=["k", "n"])

    t = counts.select("g", "gc", "wc").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    k, n = t.column("k").to_numpy(), t.column("n").to_numpy()
    rest = {int(a): int(b) for a, b in zip(k[k < 0], n[k < 0])}
    order = np.argsort(k[k >= 0])
    return rest.get(-1, 0), rest.get(-2, 0), Level(k[k >= 0][order].astype(np.uint64), n[k >= 0][order])


def unique(a: np.ndarray) -> np.ndarray:
    """By sorting: np.unique without counts hashes, which takes ten times as long here."""
    a = np.sort(a)
    return a[np.concatenate([[True], a[1:] != a[:-1]])] if len(a) else a


def distinct(texts: list[bytes]) -> np.ndarray:
    held, n = [np.zeros(0, np.uint64)], 0
    for g in grams(texts):
        held.append(unique(g))
        n += len(held[-1])
        if n > HELD:
            held, n = [unique(np.concatenate(held))], 0
    return unique(np.concatenate(held))


class Index:
    """Places in a sorted array of keys that are all there: one look at a hashed table, a binary search for the rest."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, np.int32)
        self.table[self._slot(keys)] = np.arange(len(keys))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys) and len(keys):
            raise KeyError("no answers at all")
        at = self.table[self._slot(keys)]
        miss = np.flatnonzero(self.keys[at] != keys)
        found, there = place(self.keys, keys[miss])
        if not there.all():
            raise KeyError("strings without an answer: the documents were read twice and differ")
        at[miss] = found
        return at


def lm_scores(docs: DataFrame, train: DataFrame, block: int = BLOCK, parts: int | None = None) -> DataFrame:
    """docs (doc_id, text, ...) scored by a model of train (text): adds n_tokens, n_known, train_tokens, base_score, score."""
    import pyarrow as pa
    from pyspark.sql.types import StructType

    docs = docs.drop(*ADDED)
    plain = F.coalesce("text", F.lit(""))
    train = train.select(plain.alias("text"))
    size = F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))
    n_docs, trained = train.agg(F.count("*"), size).collect()[0]
    # Parts grow as the root of the corpus, as its distinct strings do about: so a block's questions stay few.
    parts = parts or max(1, round(math.sqrt(trained / (1 << 20))))
    low = low_counts(train)
    divided = frequent(low, parts)
    counts = materialize(counted(train, parts, divided))
    words, kinds, split = totals(counts, divided)
    total, kinds = words + n_docs, kinds + (n_docs > 0)
    bottom, ends = math.log10(total + 0.1 * (kinds + 1)), math.log10(n_docs + 0.1)
    shared = docs.sparkSession.sparkContext.broadcast((low, split))

    key = fresh([*docs.columns, *ADDED], "block")[0]
    n_blocks = max(1, -(-docs.select(plain.alias("text")).agg(size).collect()[0][0] // block))
    keep = [c for c in docs.columns if c != "text"]
    # Dealt by row: equal rows don't meet in one block.
    dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_blocks)).cast("long")
    # No fewer partitions than other shuffles have: so the texts aren't shuffled again to meet the answers.
    tasks = max(n_blocks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = docs.select(*keep, plain.alias("text"), dealt.alias(key)).repartition(tasks, key)
    raw = lambda t: [x.as_py().encode().lower() for x in t.column("text")]

    def ask(t: pa.Table) -> pa.Table:
        texts = raw(t)
        u, words = distinct(texts), set()
        for x in texts:
            words.update(x.split())
        rows = [(i, t.column(key)[0].as_py(), pack_sorted(u[at]), pack_words(w)) for i, (at, w) in enumerate(zip(by_part(u, parts, divided), words_by_part(words, parts))) if len(at) or w]
        cols = list(zip(*rows)) or [[]] * 4
        return pa.table([pa.array(c, k) for c, k in zip(cols, [pa.int32(), pa.int64(), pa.binary(), pa.binary()])], names=["part", "b", "g", "w"])

    asked = blocks.groupBy(key).applyInArrow(ask, "part int, b long, g binary, w binary")
    none = F.lit(None).cast("binary")
    both = counts.select("part", F.lit(-1).cast("long").alias("b"), "g", "gc", "w", "wc").unionByName(asked.select("part", "b", "g", none.alias("gc"), "w", none.alias("wc")))

    def answer(batches: Iterator):
        """A part's counts come first (if it has any), then the questions."""
        part, model, known, held = None, None, {}, []
        for b in batches:
            out = []
            for p, at, g, gc, w, wc in zip(*(b.column(i).to_pylist() for i in range(6))):
                if p != part:
                    part, model, known, held = p, None, {}, []
                if at < 0:
                    held.append((unpack_sorted(g), unpack(gc, np.int64)))
                    known.update(zip(unpack_words(w), unpack(wc, np.int64).tolist()))
                    continue
                if model is None:
                    held.sort(key=lambda r: r[0][0] if len(r[0]) else np.uint64(0))
                    keys = np.concatenate([np.zeros(0, np.uint64), *(r[0] for r in held)])
                    model, held = PartialMatching(keys, np.concatenate([np.zeros(0, np.int64), *(r[1] for r in held)]), *shared.value), []
                lp = model.log10(unpack_sorted(g)).astype(np.float32)
                n = np.array([known.get(x, 0) for x in unpack_words(w)], np.int64)
                out.append((at, g, pack(lp), w, pack(n)))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64(), *[pa.binary()] * 4])], names=names)

    names = [key, *fresh([key], "g", "lp", "w", "n")]
    told = StructType().add(key, "long")
    for c in names[1:]:
        told = told.add(c, "binary")
    told = both.repartition("part").sortWithinPartitions("part", "b").mapInArrow(answer, told)

    def score(t: pa.Table, answers: pa.Table) -> pa.Table:
        texts = raw(t)
        keys, lps, logs = [np.zeros(0, np.uint64)], [np.zeros(0)], {}
        for g, lp, w, n in zip(*(answers.column(c).to_pylist() for c in names[1:])):
            keys.append(unpack_sorted(g))
            lps.append(unpack(lp, np.float32))
            logs.update(zip(unpack_words(w), np.log10(unpack(n, np.int64) + 0.1).tolist()))
        u = np.concatenate(keys)
        order = np.argsort(u)
        index, lp = Index(u[order]), np.concatenate(lps)[order]
        # Sums at every SEGMENT, and between by text.
        lens = np.array([len(x) + 1 for x in texts], np.int64)
        sums, done = np.zeros(len(texts)), 0
        ends_at = np.cumsum(lens)
        for g in grams(texts):
            v = np.concatenate([[0.0], np.cumsum(lp[index[g]])])
            first, last = np.searchsorted(ends_at, done, side="right"), np.searchsorted(ends_at, done + len(g), side="left")
            i = np.arange(first, min(last, len(texts) - 1) + 1)
            lo, hi = np.maximum(ends_at[i] - lens[i] - done, 0), np.minimum(ends_at[i] - done, len(g))
            sums[i] += v[hi] - v[lo]
            done += len(g)
        rows = []
        for x in texts:
            w = x.split()
            v = np.fromiter(map(logs.__getitem__, w), float, len(w))  # above zero for known words alone
            rows.append((len(w) + 1, int((v > 0).sum()) + (n_docs > 0), total, v.sum() + ends - (len(w) + 1) * bottom))
        a = list(zip(*rows))
        new = [pa.array(a[0], pa.int64()), pa.array(a[1], pa.int64()), pa.array(a[2], pa.int64()), pa.array(a[3], pa.float64()), pa.array(sums)]
        return pa.table([t.column(c) for c in keep] + new, names=[*keep, *ADDED])

    schema = StructType([docs.schema[c] for c in keep])
    for c in ADDED:
        schema = schema.add(c, "double" if c.endswith("score") else "long")
    return blocks.groupBy(key).cogroup(told.groupBy(key)).applyInArrow(score, schema)


def scored(docs: DataFrame) -> DataFrame:
    """The documents table scored by a model of its training fold (crc32(doc_id) mod 10 other than 0)."""
    rows = docs.select("doc_id", "text").withColumn("held_out", fold(F.col("doc_id"), 10) == 0)
    return lm_scores(rows, rows.where("not held_out"))
