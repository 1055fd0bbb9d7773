"""MinHash near-dedup by a signature-coordinate inverted join.

A document's set holds its distinct shingles of `size` words (all words as one if there are fewer).  Equal word
sequences form a class; classes, not rows, are compared.  A signature has K coordinates, each the least of a keyed hash
over the set; T of them must agree, where T is the most for which a pair at the threshold is lost less than 1.5 times in
a million.

Prefix: two signatures that agree on at least T coordinates agree on one of any K - T + 1, so classes are posted under
their first K - T + 1 (coordinate, value) pairs only.  Skip: a pair counts where its first collision is and nowhere
else, and is kept if its collisions over all coordinates reach T.  Each pair that is kept is confirmed on the full sets.

No bucket is expanded into all its pairs, and what leaves a bucket is never more than its members:
1. Every class of a bucket is compared with the bucket's least class (its hub); the confirmed links give components.
2. Buckets that still hold several components go on.  Their members outside the bucket's largest component are compared
   with the other components' members there, in blocks.  Of the pairs that reach T only those are given out that join two
   components of the bucket (a spanning forest, the pairs with most collisions first), and these are confirmed.
3. Where refused pairs leave a bucket with components that other pairs of it might join, the members of such pairs bring
   their full sets, and the pairs are confirmed inside the bucket until none is left that could join anything.
So the components are those of all pairs.  Crowded buckets are divided by a further coordinate, which T allows, and what
is crowded still (or brings many elements) is dealt to parts, each two of which meet in a task of their own.

Each set also has an odd sketch: the parity of its elements in BITS cells.  Two sketches differ in no more cells than the
sets do in elements, so a pair whose sketches differ in more cells than the threshold lets the sets differ is passed over
without loss.

Components come from label propagation with pointer jumping on checkpointed tables.  Null and empty texts have an empty
set and stand alone; a class of rows with null ids only has a null component id; kept is false for null ids.  Equal
rows (same id) share a component and are both kept: kept compares ids.  Ties: the least id stands for a group.  A very
long text is one row whose set is as long as its words; an empty table gives an empty result.  Of other columns
near_duplicates reads none and deduplicate returns all, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import discard, fresh, materialize, row_id
from sextant.llm.suffix_dedup import _BASE, _INVERSE, _batched, _power, _rows

#: Coordinates of a signature.
K = 24
#: Most signatures of a bucket, and most elements of full sets, that are solved in one task.
CROWDED, ELEMENTS = 20_000, 2_000_000
#: Cells of the odd sketch.
BITS = 1024


@dataclass(frozen=True)
class Rule:
    """Shingles of `size` words; documents are linked from `percent` of similarity on."""

    size: int = 3
    percent: int = 85

    @property
    def t(self) -> int:
        """Coordinates that must agree."""
        j = self.percent / 100
        lost, t = (1 - j) ** K, 1
        while t < K and (more := lost + comb(K, t) * j**t * (1 - j) ** (K - t)) < 1.5e-6:
            lost, t = more, t + 1
        return t

    @property
    def posts(self) -> int:
        return K - self.t + 1


_SPACES = np.zeros(256, bool)
_SPACES[[32, *range(9, 14)]] = True
_KEYS = np.random.default_rng(20240229).integers(1, 2**63, (2, 64), np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


#: Words of at least this many bytes are hashed by BLAKE2: long words that collide under any polynomial are known.
LONG_WORD = 256


def shingle_hashes(text: bytes, size: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a lower-cased text."""
    x = np.frombuffer(text, np.uint8)
    inside = np.concatenate([[False], ~_SPACES[x], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    s, e = edge[0::2], edge[1::2]
    if not len(s):
        return np.zeros(0, np.uint64)
    c = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(_power(_BASE, len(x)) * (x.astype(np.uint64) + np.uint64(1)), out=c[1:])
    w = _mix((c[e] - c[s]) * _power(_INVERSE, len(x))[s] + (e - s).astype(np.uint64))
    for i in np.flatnonzero(e - s >= LONG_WORD):
        w[i] = int.from_bytes(hashlib.blake2b(text[s[i] : e[i]], digest_size=8).digest(), "little")
    n = min(size, len(w))
    h = np.zeros(len(w) - n + 1, np.uint64)
    for i in range(n):
        h = _mix(h * np.uint64(0xD6E8FEB86659FD93) + w[i : len(w) - n + 1 + i] + np.uint64(n))
    return np.unique(h)


def signature(h: np.ndarray, k: int = K) -> list[int]:
    out = []
    for j in range(k):
        v = (h ^ _KEYS[0, j]) * _KEYS[1, j]
        out.append(int((v ^ (v >> np.uint64(32))).min() >> np.uint64(33)))  # 31 bits
    return out


def odd_sketch(h: np.ndarray) -> list[int]:
    cells = np.bincount((h >> np.uint64(54)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(cells.astype(bool)).view(np.int64).tolist()


def normal(text: str) -> bytes:
    """Words of a text with A-Z lower-cased, one space between."""
    return b" ".join(text.encode().lower().split())


def _signed(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, row, ck, n, sig, odd) of each row; ck tells the word sequence."""
    import pyarrow as pa

    def one(row):
        t = normal(row[1])
        h = shingle_hashes(t, rule.size)
        yield row[0], row[2], hashlib.md5(t).digest(), len(h), signature(h) if len(h) else None, odd_sketch(h)

    types = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), row_id("doc_id", "text").alias("row"))
    return rows.mapInArrow(lambda b: _batched(_rows(b), one, ["doc_id", "row", "ck", "n", "sig", "odd"], types, 2000), "doc_id long, row binary, ck binary, n long, sig array<int>, odd array<long>")


def may_link(s1: str, s2: str, n1: str, n2: str, o1: str, o2: str, rule: Rule) -> Column:
    """T collisions, and sizes and odd sketches that the threshold allows."""
    summed = lambda x, y, f: F.aggregate(F.zip_with(x, y, f), F.lit(0), lambda a, v: a + v)
    agree = summed(s1, s2, lambda x, y: (x == y).cast("int"))
    apart = summed(o1, o2, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    size = F.lit(100) * F.least(n1, n2) >= F.lit(rule.percent) * F.greatest(n1, n2)
    return size & (F.lit(100 + rule.percent) * apart <= F.lit(100 - rule.percent) * (F.col(n1) + F.col(n2))) & (agree >= rule.t)


def linked(x: np.ndarray, y: np.ndarray, rule: Rule) -> bool:
    """The threshold on two full sets (sorted distinct hashes)."""
    inter = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * inter >= rule.percent * (len(x) + len(y) - inter)


class Bucket:
    """The members of one bucket as arrays; js: the coordinates that its key holds."""

    def __init__(self, ck, comp, most, n, sig, odd, js, part):
        self.ck, self.n, self.sig, self.odd, self.part = ck, n, sig, odd, part
        self.label = np.unique(np.array(comp, object), return_inverse=True)[1]
        self.big = np.array([c == m for c, m in zip(comp, most)])
        self.rank = np.empty(len(ck), np.int64)
        self.rank[sorted(range(len(ck)), key=ck.__getitem__)] = np.arange(len(ck))
        self.before = [i for i in range(js[-1]) if i not in js]

    def pairs(self, rule: Rule):
        """Blocks (x, y) of pairs of different labels that reach T collisions, their first collisions being those of the
        key: members outside the largest component against all.  Best pairs first.  Where two parts meet, only pairs of
        both."""
        m = len(self.ck)
        probes = np.flatnonzero(~self.big)
        step = max(1, 4_000_000 // max(1, m * self.odd.shape[1]))
        n, t = self.n, rule.t
        for at in range(0, len(probes), step):
            p = probes[at : at + step]
            ok = (self.label[p, None] != self.label[None, :]) & (self.big[None, :] | (self.rank[p, None] < self.rank[None, :]))
            if (self.part != self.part[0]).any():
                ok &= self.part[p, None] != self.part[None, :]
            ok &= 100 * np.minimum(n[p, None], n[None, :]) >= rule.percent * np.maximum(n[p, None], n[None, :])
            apart = np.bitwise_count(self.odd[p, None, :] ^ self.odd[None, :, :]).sum(axis=2, dtype=np.int64)
            ok &= (100 + rule.percent) * apart <= (100 - rule.percent) * (n[p, None] + n[None, :])
            x, y = np.nonzero(ok)
            same = self.sig[p[x]] == self.sig[y]
            agree = same.sum(axis=1)
            keep = np.flatnonzero((agree >= t) & ~same[:, self.before].any(axis=1))
            keep = keep[np.lexsort((apart[x[keep], y[keep]], -agree[keep]))]
            if len(keep):
                yield p[x[keep]], y[keep]

    def forest(self, rule: Rule, accept=None) -> list[tuple[bytes, bytes]]:
        """Accepted pairs (all, if no test is given) of which each joins two components: fewer than members."""
        out = []
        for x, y in self.pairs(rule):
            for i, j in zip(x.tolist(), y.tolist()):
                a, b = self.label[i], self.label[j]
                if a != b and (accept is None or accept(i, j)):
                    self.label[self.label == b] = a
                    out.append((self.ck[i], self.ck[j]))
        return out

    def open(self, rule: Rule) -> list[int]:
        """Members of a pair that might still join two components."""
        found = np.zeros(len(self.ck), bool)
        for x, y in self.pairs(rule):
            found[x] = found[y] = True
        return np.flatnonzero(found).tolist()


def posted(classes: DataFrame, rule: Rule) -> DataFrame:
    """A row for each of the first K - T + 1 coordinates: key, last (its coordinate)."""
    post = F.posexplode(F.slice("sig", 1, rule.posts)).alias("last", "v")
    return classes.select("ck", post).select("ck", "last", F.xxhash64("last", "v").alias("key"))


def hub_pairs(posts: DataFrame) -> DataFrame:
    """(a, b): each class with the least class of each of its buckets."""
    hubs = posts.groupBy("key").agg(F.min("ck").alias("b"), F.count("*").alias("m")).where("m > 1").select("key", "b")
    return posts.select("key", F.col("ck").alias("a")).join(hubs, "key").where("a <> b").select("a", "b").distinct()


def full_sets(cks: DataFrame, classes: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """(ck, set): the sorted distinct hashes of the classes named, read from the texts again."""
    import pyarrow as pa

    ids = cks.select("ck").distinct().join(classes.select("ck", "rep"), "ck")

    def sets(row):
        t = normal(row[1])
        ck = hashlib.md5(t).digest()
        if ck == row[0]:
            yield ck, shingle_hashes(t, rule.size).tobytes()

    low = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    texts = docs.select(low.alias("rep"), F.coalesce("text", F.lit("")).alias("text")).join(ids.hint("shuffle_hash"), "rep").select("ck", "text")
    return materialize(texts.mapInArrow(lambda b: _batched(_rows(b), sets, ["ck", "set"], [pa.binary(), pa.binary()], 500), "ck binary, set binary").dropDuplicates(["ck"]))


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) that reach T collisions and, on full sets, the threshold."""
    import pyarrow as pa

    side = lambda x, i: classes.select(F.col("ck").alias(x), F.col("n").alias("n" + i), F.col("sig").alias("s" + i), F.col("odd").alias("o" + i))
    near = pairs.join(side("a", "1"), "a").join(side("b", "2"), "b").where(may_link("s1", "s2", "n1", "n2", "o1", "o2", rule))
    near = materialize(near.select("a", "b"))
    full = full_sets(near.select(F.col("a").alias("ck")).unionByName(near.select(F.col("b").alias("ck"))), classes, docs, rule)
    both = near.join(full.select(F.col("ck").alias("a"), F.col("set").alias("x")), "a").join(full.select(F.col("ck").alias("b"), F.col("set").alias("y")), "b")

    def verify(row):
        a, b, x, y = row
        if linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), rule):
            yield a, b

    out = materialize(both.select("a", "b", "x", "y").mapInArrow(lambda b: _batched(_rows(b), verify, ["a", "b"], [pa.binary(), pa.binary()]), "a binary, b binary"))
    discard(near, full)
    return out


def components(links: DataFrame) -> DataFrame:
    """(ck, comp): the least ck that links reach, for every class in a link."""
    edges = materialize(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(edges.groupBy(F.col("a").alias("ck")).agg(F.least(F.first("a"), F.min("b")).alias("comp")))
    while True:
        seen = edges.join(labels.select(F.col("ck").alias("b"), "comp"), "b").groupBy(F.col("a").alias("ck")).agg(F.min("comp").alias("near"))
        step = labels.join(seen, "ck").select("ck", "comp", F.least("comp", "near").alias("new"))
        up = labels.select(F.col("ck").alias("new"), F.col("comp").alias("far"))
        step = materialize(step.join(up, "new", "left").select("ck", "comp", F.least("new", F.coalesce("far", "new")).alias("new")))
        discard(labels)
        moved = step.where("comp <> new").limit(1).count()
        labels = step.select("ck", F.col("new").alias("comp"))
        labels.scratch_path = step.scratch_path
        if not moved:
            discard(edges)
            return labels


def mixed(posts: DataFrame) -> DataFrame:
    """(key, m, most): members and largest component of the buckets that hold several components."""
    per = posts.groupBy("key", "comp").agg(F.count("*").alias("m"))
    by = per.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("m").alias("m"), F.max(F.struct("m", "comp")).alias("top"))
    return by.where("kinds > 1").select("key", "m", F.col("top.comp").alias("most"))


def in_parts(level: DataFrame, parts: Column) -> DataFrame:
    """Buckets dealt to so many parts, each two of which get a key of their own; part tells a member's own."""
    level = level.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("ck"), "parts"))
    level = level.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    key = F.when(F.col("parts") > 1, F.xxhash64("key", F.least("part", "with"), F.greatest("part", "with"))).otherwise(F.col("key"))
    return level.withColumn("key", key).drop("parts", "with")


def open_buckets(posts: DataFrame, info: DataFrame, rule: Rule) -> DataFrame:
    """key, ck, comp, js, most, part: the members of the buckets that hold several components; crowded ones divided."""
    p = posts.join(info.select("ck", "comp"), "ck").select("key", "ck", "comp", F.array("last").alias("js"))
    level = materialize(p.join(mixed(p), "key").select("key", "ck", "comp", "js", "m", "most"))
    big = level.where(F.col("m") > CROWDED)
    out = level.where(F.col("m") <= CROWDED).withColumn("part", F.lit(0).cast("long")).drop("m")
    if big.limit(1).count():
        # A pair's second collision lies among the next coordinates up to K - T + 1.
        after = F.explode(F.sequence(F.col("js")[0] + 1, F.lit(rule.posts)))
        big = big.join(info.select("ck", "sig"), "ck").withColumn("j", after)
        p = materialize(big.select(F.xxhash64("key", "j", F.get("sig", F.col("j"))).alias("key"), "ck", "comp", F.concat("js", F.array("j")).alias("js")))
        big = p.join(mixed(p), "key").select("key", "ck", "comp", "js", "m", "most")
        out = out.unionByName(in_parts(big, F.ceil(F.col("m") / CROWDED)).drop("m"))
    return out


def solved(rows: DataFrame, solve, schema: str) -> DataFrame:
    """rows (key, ck, comp, most, n, sig, odd, js, part, ...): solve(bucket, its other columns as lists) yields tuples."""
    import pyarrow as pa

    def meet(batches):
        """Rows come sorted by key; a run of one key is a bucket."""

        def runs():
            held, key = [], None
            for b in batches:
                keys = b.column(0).to_numpy()
                cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
                for s, e in zip(cuts, cuts[1:]):
                    if s == e:
                        continue
                    if held and keys[s] != key:
                        yield key, held
                        held = []
                    key = keys[s]
                    held.append(b.slice(s, e - s))
            if held:
                yield key, held

        def one(run):
            key, parts = run
            col = lambda i: [x for b in parts for x in b.column(i).to_pylist()]
            flat = lambda i, w: np.concatenate([b.column(i).flatten().to_numpy() for b in parts]).reshape(-1, w)
            n = np.concatenate([b.column(4).to_numpy() for b in parts])
            bucket = Bucket(col(1), col(2), col(3), n, flat(5, K), flat(6, BITS // 64).view(np.uint64), parts[0].column(7)[0].as_py(), np.array(col(8)))
            yield from solve(int(key), bucket, [col(i) for i in range(9, parts[0].num_columns)])

        fields = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}[k]) for n, k in map(str.split, schema.split(", "))])
        yield from _batched(runs(), one, fields.names, fields.types)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(meet, schema)


_ROW = ("key", "ck", "comp", "most", "n", "sig", "odd", "js", "part")


def cross_links(posts: DataFrame, classes: DataFrame, links: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): confirmed links which, with those given, have the components of all links; steps 2 and 3 told above."""

    info = classes.select("ck", "n", "sig", "odd")
    comp = lambda labels: classes.select("ck").join(labels, "ck", "left").select("ck", F.coalesce("comp", "ck").alias("comp"))
    level = materialize(open_buckets(posts, info.join(comp(components(links)), "ck"), rule))
    tried = materialize(solved(level.join(info, "ck").select(*_ROW), lambda key, b, _: ((key, x, y) for x, y in b.forest(rule)), "key long, a binary, b binary"))
    more = confirmed(tried.select("a", "b").distinct(), classes, docs, rule)
    # A bucket whose pairs were all confirmed has no two components left that any pair of it might join.
    refused = tried.join(more, ["a", "b"], "left_anti").select("key").distinct()
    level = level.drop("comp", "most").join(refused, "key", "left_semi").join(comp(components(links.unionByName(more))), "ck")
    level = materialize(level.join(mixed(level).drop("m"), "key"))
    left = materialize(solved(level.join(info, "ck").select(*_ROW), lambda key, b, _: ((key, b.ck[i]) for i in b.open(rule)), "key long, ck binary").distinct())
    if not left.limit(1).count():
        return more
    rows = level.join(left, ["key", "ck"]).join(info, "ck")
    size = rows.groupBy("key").agg(F.ceil(F.sum("n") / ELEMENTS).alias("again"))
    # Where parts meet already, the parts of one member differ by key; they are divided anew as one bucket.
    rows = in_parts(rows.join(size, "key").withColumnRenamed("part", "met"), F.col("again")).join(full_sets(left, classes, docs, rule), "ck")

    def exact(key, b, more):
        met, sets = np.array(more[0]), [np.frombuffer(x, np.uint64) for x in more[1]]
        apart = lambda i, j: (met == met[0]).all() or met[i] != met[j]
        return b.forest(rule, lambda i, j: apart(i, j) and linked(sets[i], sets[j], rule))

    found = solved(rows.select(*_ROW, "met", "set"), exact, "a binary, b binary").distinct()
    return more.unionByName(materialize(found))


def groups(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, row, n, grp (the component; null for an empty set), component_id (its least id): a row for each row."""
    signed = materialize(_signed(docs, rule))
    low = F.coalesce("doc_id", F.lit(-(2**63)))
    classes = signed.groupBy("ck").agg(F.min("doc_id").alias("least"), F.min(low).alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("odd").alias("odd"))
    classes = materialize(classes)
    some = classes.where("n > 0")
    posts = posted(some, rule)
    links = confirmed(hub_pairs(posts), some, docs, rule)
    labels = components(links.unionByName(cross_links(posts, some, links, docs, rule)))
    of = some.join(labels, "ck", "left").select("ck", "least", F.coalesce("comp", "ck").alias("grp"))
    least = of.groupBy("grp").agg(F.min("least").alias("component_id"))
    found = of.join(least, "grp").select("ck", "grp", "component_id")
    return signed.select("doc_id", "row", "ck", "n").join(found, "ck", "left").drop("ck")


def near_duplicates(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of docs."""
    # An empty set is linked with nothing, not even an equal text.
    component = F.when(F.col("grp").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return groups(docs, rule).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def deduplicate(docs: DataFrame, rule: Rule = Rule(5, 80)) -> DataFrame:
    """The rows of docs with one document of each group: the least id, then the least md5.  Empty sets all stay."""
    g = groups(docs, rule)
    key = fresh(docs, "row")[0]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    one = g.where(F.col("grp").isNotNull()).groupBy("grp").agg(first.alias("m")).select(F.col("m.row").alias(key))
    # Rows of an empty set, those without a word, are linked with nothing: equal ones aren't copies.
    empty = ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    keyed = docs.where(~empty).withColumn(key, row_id("doc_id", "text"))
    return keyed.join(one.distinct(), key).dropDuplicates([key]).select(*docs.columns).unionByName(docs.where(empty))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                          ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM d),
c AS (SELECT g, min(doc_id) AS rep, len(g) AS n FROM (SELECT doc_id, list_sort(g) AS g FROM s) GROUP BY g),
m AS (SELECT s.doc_id, c.rep, c.n FROM s JOIN c ON list_sort(s.g) = c.g),
p AS (SELECT rep, n, unnest(g) AS x FROM c),
i AS (SELECT a.rep AS a, b.rep AS b, a.n AS n, b.n AS k, count(*) AS common FROM p a JOIN p b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM i WHERE 100 * common >= 85 * (n + k - common)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT rep AS v, rep AS c FROM c UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v),
k AS (SELECT v, min(c) AS component_id FROM r GROUP BY v)
SELECT m.doc_id, m.n::BIGINT AS n_shingles, CASE WHEN m.n = 0 THEN m.doc_id ELSE component_id END AS component_id,
       m.doc_id = CASE WHEN m.n = 0 THEN m.doc_id ELSE component_id END AS kept
FROM m JOIN k ON k.v = m.rep
"""
