"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names; brute force where it is given."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from sextant.llm import byte_cnn, minhash, mixing, queries, topk, toxicity
from sextant.llm.quality_rules import quality_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, target double, score double, h string, ck string, n int, w string"
LABELS = "doc_id long, quality int, toxic int, text string, score double"
SMALL = "/root/testdata/sf0.001"


def doc(i, text, source="a"):
    return (i, text, "en", source, len(text or ""), 1, 1.0, 1.0, "h", "c", 1, "w")


PROSE = " ".join(f"w{i % 37}x{i * i % 101}" for i in range(120))
ROWS = [
    doc(1, PROSE, "b"), doc(1, PROSE, "b"), doc(2, PROSE.replace("w5x25", "zz", 1), "a"), doc(3, None, None), doc(None, PROSE, "é"), doc(4, "", "a"), doc(5, " \t\n", "a"),
    doc(6, "One two", "c"), doc(7, "one  TWO", None), doc(8, "three", "a"), doc(9, "word " * 40_000, "a"), doc(10, "idiot! you STUPID loser", "a"), doc(None, None, None), doc(11, "é" * 3000, "b"), doc(12, PROSE[: len(PROSE) // 2], "a"),
]


@pytest.fixture(scope="module")
def frames(spark):
    labels = [(1, 1, 0, "x", 0.0), (2, 1, 0, "x", 0.0), (4, 0, 0, None, None), (9, 0, None, "x", 0.0), (10, 1, 1, "x", 0.0), (None, 1, 1, None, None), (11, None, None, None, None), (10, 1, 1, "x", 0.0)]
    return spark.createDataFrame(ROWS, DOCS), spark.createDataFrame(labels, LABELS)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_rules(text):
    w, lines, seen, dup = split(text), (text or "").split("\n"), set(), 0
    for x in lines:
        if split(x):
            dup += x in seen
            seen.add(x)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_rules(spark, frames):
    docs, labels = frames
    more = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    for df, ids in ((docs, labels.where("quality = 1")), (more, more.where("doc_id % 2 = 0"))):
        got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules(df, ids).collect())
        assert got == Counter((r.doc_id, *brute_rules(r.text)) for r in df.collect())
    out = quality_rules(docs.selectExpr("*", "1 AS n_symbols", "true AS kept"), labels.limit(0)).collect()
    assert all(not (r.kept and r.base_failed) for r in out)
    assert quality_rules(docs.limit(0), labels).count() == 0


def jaccard_components(rows):
    sets = []
    for i, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in split(t)]
        sets.append((i, frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else [])))
    group = list(range(len(rows)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and 100 * len(x & y) >= 85 * len(x | y):
                group[top(a)] = top(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[top(k)].append(i)
    return Counter((i, len(s), i if not s else min(least[top(k)], default=None)) for k, (i, s) in enumerate(sets))


def test_minhash(spark, frames):
    docs, _ = frames
    got = minhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == jaccard_components([(r[0], r[1]) for r in ROWS])
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)
    more = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    got = minhash.near_duplicates(more).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == jaccard_components([(r.doc_id, r.text) for r in more.collect()])
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def family(rng, n, size, changes, tag=""):
    """n texts of `size` words, each with one of the numbers of changed words."""
    out = []
    for _ in range(n):
        w = [f"t{i}{tag}" for i in range(size)]
        for _ in range(rng.choice(changes)):
            w[rng.randrange(size)] = f"r{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_minhash_crowded_buckets(spark, monkeypatch):
    """Chains and families near the threshold, with every bucket counted as crowded."""
    import random

    rng = random.Random(5)
    rows = list(enumerate(t for f in range(3) for t in family(rng, 25, 150, [1, 3, 5, 8], f"x{f}")))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = jaccard_components(rows)
    for crowded in (minhash.CROWDED, 2):
        monkeypatch.setattr(minhash, "CROWDED", crowded)
        got = minhash.near_duplicates(docs).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_minhash_refused_pairs_end_in_full_sets(spark, monkeypatch):
    """Long texts: sketches are full, and many pairs that reach T lie below the threshold."""
    import random

    rng = random.Random(11)
    rows = list(enumerate(family(rng, 50, 2600, [60, 62, 64, 66, 68, 70, 72, 74])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, seen, full = jaccard_components(rows), [], minhash.full_sets
    monkeypatch.setattr(minhash, "full_sets", lambda *a: seen.append(1) or full(*a))
    for elements in (minhash.ELEMENTS, 30_000):
        monkeypatch.setattr(minhash, "ELEMENTS", elements)
        seen.clear()
        got = minhash.near_duplicates(docs).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
        assert len(seen) == 3  # hubs, forest, and the pairs confirmed inside buckets


def test_minhash_pairs_grow_in_proportion(spark, monkeypatch):
    """Twice the near copies around the threshold: about twice the pairs that are confirmed, not four times."""
    import random

    counts, confirm = [], minhash.confirmed
    monkeypatch.setattr(minhash, "confirmed", lambda pairs, *a: counts.append(pairs.count()) or confirm(pairs, *a))
    total = []
    for n in (250, 500):
        counts.clear()
        docs = spark.createDataFrame(list(enumerate(family(random.Random(3), n, 150, range(1, 25)))), "doc_id long, text string")
        minhash.near_duplicates(docs).count()
        total.append(sum(counts))
    assert total[1] <= 2.5 * total[0] and total[1] <= 500 * 2 * minhash.Rule().posts


def test_minhash_rule():
    assert (minhash.Rule(3, 85).t, minhash.Rule(5, 80).t) == (11, 9)
    a, b = b"ab" * 300, b"ba" * 300  # long words are hashed another way than short ones
    assert len(minhash.shingle_hashes(a + b" x " + b + b" x " + a + b" x")) == 4


def test_near_dedup_stage_rule(spark):
    """The stage's rule: five words, 80 %; names of its own that the table has too do no harm."""
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(1, base, 1), (2, base + " " + " ".join(f"x{i}" for i in range(20)), 2), (3, base + " " + " ".join(f"y{i}" for i in range(28)), 3), (4, None, 4), (4, None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int").withColumn("_row", F.lit("z")).withColumn("_key", F.lit(1))
    got = corpus_pipeline.near_dedup(spark, docs, SMALL)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [1, 3, 4, 4]
    assert sorted(r.doc_id for r in minhash.deduplicate(docs, minhash.Rule(3, 85)).collect()) == [1, 2, 3, 4, 4]


def test_classifiers(spark, frames):
    docs, labels = frames
    for f, mod, fold in ((byte_cnn.quality, 3, 1), (toxicity.toxicity, 4, 2)):
        for lab in (labels, labels.limit(0)):
            got = f(docs, lab).collect()
            assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ROWS)
            for r in got:
                assert 0 <= r.score <= 1 and r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % mod == fold)
        assert f(docs.limit(0), labels).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    for f, label, least in ((queries.op4_byte_cnn, "quality", 0.9), (queries.op2_toxicity, "toxic", 0.93)):
        got = f(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
        assert np.mean([r.predicted == r[label] for r in got]) >= least


def brute_network(model, text):
    """One forward pass by plain loops over one text."""
    raw, c, w = list(text.encode()), byte_cnn.CHUNK, byte_cnn.WIDTH
    at = lambda i: raw[i] if 0 <= i < len(raw) else byte_cnn.PAD
    rows = []
    for s in range(0, max(1, len(raw)), c):
        top = [max(0.0, max(sum(float(model["tables"][j, at(i + j), f]) for j in range(w)) for i in range(s, s + c))) for f in range(byte_cnn.FILTERS)]
        best = []
        for v in range(s, s + c, byte_cnn.WINDOW):
            best.append(max(sum(at(i) == at(i - lag) and i < len(raw) for i in range(v, v + byte_cnn.WINDOW)) for lag in byte_cnn.LAGS) / byte_cnn.WINDOW)
        rows.append(top + [sum(best) / len(best), max(best)])
    f = [sum(col) / len(rows) for col in zip(*rows)] + [max(col) for col in zip(*rows)]
    z = sum(a * b for a, b in zip(f, model["w"])) + float(model["b"][0])
    return 1 / (1 + np.exp(-z))


def test_network_forward_pass(monkeypatch):
    """A score is that of the text alone: brute force, any batch, any order, any step."""
    import random

    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefgh é\n") for _ in range(rng.choice([0, 1, 5, 511, 512, 513, 700, 1500]))) for _ in range(40)] + ["ab" * 700, "ba" * 3, "", "語" * 600]
    model = byte_cnn.train([(t[:60], i % 2) for i, t in enumerate(texts)])
    model["w"] = np.random.default_rng(0).normal(0, 0.4, len(model["w"]))
    p = byte_cnn.predict(model, texts)
    assert np.ptp(p) > 0.1 and np.allclose(p[-12:], [brute_network(model, t) for t in texts[-12:]], atol=1e-5)
    assert np.abs(p - [byte_cnn.predict(model, [t])[0] for t in texts]).max() < 1e-12
    assert np.abs(p - byte_cnn.predict(model, texts[::-1])[::-1]).max() < 1e-12
    for step in (1, 7):
        monkeypatch.setattr(byte_cnn, "STEP", step)
        assert np.abs(p - byte_cnn.predict(model, texts)).max() < 1e-12


def test_network_scores_don_t_depend_on_partitions(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = byte_cnn.fit(docs, labels)
    a, b = ({r.doc_id: r.score for r in byte_cnn.score(d, model, ["doc_id"]).collect()} for d in (docs, docs.repartition(7)))
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-12
    clash = docs.limit(3).selectExpr("*", "'x' AS score", "1 AS held_out", "2 AS predicted")
    assert byte_cnn.quality(clash, labels).columns == ["doc_id", "held_out", "score", "predicted"]


def test_network_gradient():
    """The trained network separates two byte patterns."""
    sample = [("plain words here " * (5 + i), 1) for i in range(300)] + [("pl@@n w##ds h!!e " * (5 + i), 0) for i in range(300)]
    p = byte_cnn.predict(byte_cnn.train(sample), [t for t, _ in sample])
    assert all((x >= 0.5) == bool(y) for x, (_, y) in zip(p, sample))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_lexicon_automaton():
    terms = [("idiot", True), ("loser", True), ("lowei", False), ("moron", True)]
    m = toxicity.Matcher(terms)
    import random

    rng = random.Random(1)
    for _ in range(4000):
        t = list(rng.choice(terms)[0] + rng.choice(["", "", "x", "schaft"]))
        for _ in range(rng.choice([0, 1, 1, 2])):
            k = rng.randrange(len(t) + 1)
            t[k : k + rng.choice([0, 1])] = rng.choice(["", "a", "0"])
        token = "".join(t)
        near = any(edits(token, term) <= 1 if whole else min(edits(token[:k], term) for k in range(len(token) + 1)) <= 1 for term, whole in terms)
        m.learn({token})
        assert (token.strip(toxicity.STRIP) == token) <= ((token in m.hits) == near), token


def test_quotation_scores():
    m = toxicity.Matcher([("idiot", True)])
    assert m.features('he said "idiot" once')[4] > m.features("you idiot")[4] and m.features("")[0] == 0


def test_topk(spark):
    rows = [(1, [0.5, 1.0], 0), (2, [0.5, 1.0], 0), (3, None, 0), (4, [float("nan"), 0.0], 0), (5, [None, 1.0], 0), (None, [1.0, 1.0], 0), (6, [-0.001, 0.0], 0), (6, [-0.001, 0.0], 0), (7, [float("inf"), 1.0], 0), (8, [1.0], 0), (50, [1.0, 2.0], 0), (100, [], 0)]
    ints = topk.integers(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int"), "vec_id", "embedding")
    got = topk.exact_topk(ints, ints.where("vec_id % 50 = 0"), 3)
    assert [(r.vec_id, r.score) for r in got.where("query_id = 50").orderBy("rank").collect()] == [(1, 128 * 256 + 256 * 512), (2, 128 * 256 + 256 * 512), (8, 65536)]
    assert [r.vec_id for r in got.where("query_id = 100").orderBy("rank").collect()] == [1, 2, 6]
    assert topk.exact_topk(ints.limit(0), ints.limit(0), 5).count() == 0


def test_topk_blocks_equal_brute_force():
    rng = np.random.default_rng(0)
    v = np.floor(256 * rng.normal(0, 1, (3000, 20)) * rng.gamma(1, 1, (3000, 1)))
    v[100:200] = v[100]
    q, rot = v[:60], np.linalg.eigh(v.T @ v)[1][:, ::-1]
    qid, vid, s = topk.block_topk(np.arange(60), q, np.arange(3000), v, rot, 5)
    full = q @ v.T
    full[np.arange(60), np.arange(60)] = -np.inf
    want = np.lexsort((np.broadcast_to(np.arange(3000), full.shape), -full), axis=1)[:, :5]
    assert (vid.reshape(60, 5) == want).all() and (s.reshape(60, 5) == np.take_along_axis(full, want, 1)).all()


def test_topk_ranges(spark, monkeypatch):
    """Several ranges of length: the result of all pairs, with most of the table never entered by a query."""
    rng = np.random.default_rng(3)
    v = rng.normal(0, 1, (4000, 8)) * rng.gamma(0.5, 1, (4000, 1))
    v[7:40] = v[7]
    v[50] = v[100] = 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    ints = topk.integers(df, "vec_id", "embedding")
    monkeypatch.setattr(topk, "ELEMENTS", 8 * 100)
    bands = topk.ranges(ints, 4000, 8)[1]
    assert len(bands) == 4 and [b[1] for b in bands[:3]] == sorted(b[1] for b in bands[:3]) and [b[2] for b in bands] == sorted((b[2] for b in bands), reverse=True)
    got = sorted(tuple(r) for r in topk.exact_topk(ints, ints.where("vec_id % 50 = 0"), 5).collect())
    x = np.floor(256 * v).astype(np.int64)
    want = []
    for q in range(0, 4000, 50):
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(4000), -s)) if i != q][:5]
        want += [(q, r + 1, int(i), int(s[i])) for r, i in enumerate(order)]
    assert got == sorted(want)
    scored = []
    order = np.argsort(-np.linalg.norm(x, axis=1))
    rest = x[order[100:]].astype(float)
    floor = np.sort(x[::50] @ x[order[:100]].T, axis=1)[:, -5].astype(float)
    topk.block_topk(np.arange(0, 4000, 50), x[::50].astype(float), order[100:], rest, np.linalg.eigh(rest.T @ rest)[1][:, ::-1], 5, floor, scored)
    assert sum(scored) < 80 * 3900 / 4


def test_mixing(spark, frames):
    docs, _ = frames
    got = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(split(r[1]))) for r in ROWS)
    total, by, target = sum(r.size for r in got), defaultdict(int), {}
    for r in got:
        by[r.source] += r.size
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    assert all(r.source_size == by[r.source] for r in got) and sum(target.values()) <= 1.5 * total + 1e-6
    assert all(target[s] <= 2 * by[s] + 1e-6 for s in by)
    again = Counter((r.doc_id, r.size, r.taken) for r in mixing.mix(docs.repartition(7)).collect())
    assert again == Counter((r.doc_id, r.size, r.taken) for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0
    names = {c: F.lit(f"user {c}") for c in ("src", "_src", "h", "cell", "n", "before", "r", "i", "_cell")}
    clash = mixing.mix(docs.drop(*names).withColumns(names))
    assert all(r[c] == f"user {c}" for r in mixing.emit(clash, clash.columns).collect() for c in names)
    more = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for r in mixing.mix(more).groupBy("source").agg({"taken": "sum", "target": "max", "size": "max"}).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 2 * r["max(size)"]


def test_pipeline_stages(spark, frames):
    docs, _ = frames
    sf = SMALL
    kept = corpus_pipeline.near_dedup(spark, docs, sf)
    assert kept.columns == docs.columns
    groups = jaccard_components([(r[0], r[1]) for r in ROWS])
    texts = [r.text for r in kept.collect()]
    assert sum(t == PROSE for t in texts) == 1 and len(texts) < len(ROWS) and sum(groups.values()) == len(ROWS)
    cut = corpus_pipeline.suffix_array_dedup(spark, docs, sf)
    assert cut.columns == docs.columns and cut.count() == len(ROWS) and not any(r.text for r in cut.where("doc_id = 1").collect())
    mixed = corpus_pipeline.source_mixing(spark, docs, sf)
    want = sum(r.copies for r in mixing.mix(docs).collect())
    assert mixed.columns == docs.columns and mixed.count() == want
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_pipeline_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    one = corpus_pipeline.quality_classifier(spark, docs, SMALL)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    left = {r.doc_id for r in one.collect()}
    good = [i for i, q in labels.items() if q == 1]
    bad = [i for i, q in labels.items() if q == 0]
    assert one.columns == docs.columns and np.mean([i in left for i in good]) > 0.95 and np.mean([i in left for i in bad]) < 0.1
    assert corpus_pipeline.quality_classifier(spark, docs.limit(3).withColumn("_quality", F.lit(1)).withColumn("score", F.lit(1)), SMALL).columns == [*docs.columns, "_quality", "score"]
    out = corpus_pipeline.run(spark, SMALL)
    seqs = defaultdict(int)
    for r in out.collect():
        seqs[r.sequence_id] += r.length
    assert max(seqs.values()) <= 2048


def within_one(a, b):
    """Edits between a and b, if one at most."""
    if a == b:
        return 0
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return 1 if a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] else None


def brute_toxicity(model, text, memo):
    """The score by comparing every token with every term, and every hit with every word of its window."""

    def nearest(token):
        if token not in memo:
            found = []
            for term, whole in model["terms"]:
                d = [within_one(x, term) for x in ([token] if whole else [token[:n] for n in range(len(term) - 1, len(term) + 2)])]
                found += [(x, term) for x in d if x == 0 or (x == 1 and len(term) >= 5)]
            memo[token] = min(found, default=None)
        return memo[token]

    raw = (text or "").lower().split()
    bare = [w.strip(toxicity.STRIP) for w in raw]
    hits = [nearest(w) for w in bare]
    at = [i for i, h in enumerate(hits) if h]
    if not at:
        x = [0.0] * 6
    else:
        exact = sum(hits[i][0] == 0 for i in at)
        quoted = addressed = 0
        for i in at:
            around = [j for j in range(len(raw)) if abs(i - j) <= 6]
            quoted += any({raw[j][0], raw[j][-1]} & toxicity.QUOTES or bare[j] in toxicity.REPORTING for j in around)
            addressed += any(bare[j] in toxicity.ADDRESS or (hits[j] and raw[j] != raw[i]) for j in around)
        rate = 100 * exact / max(20, len(raw))
        x = [np.log1p(exact), np.log1p(len(at) - exact), exact > 1, np.log1p(rate), (quoted - addressed) / len(at), np.log1p(len({hits[i][1] for i in at}))]
    return 1 / (1 + np.exp(-np.dot(model["w"], [*x, 1.0])))


def test_toxicity_scores_by_brute_force(spark):
    """Every document of a whole table, and awkward ones: misspelled, quoted, addressed and repeated terms, a text of megabytes."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    learned = spark.createDataFrame([tuple(r) for r in labels.collect() if fold(r.doc_id) != 2], labels.schema)
    model = toxicity.train(toxicity.labelled_sample(docs, learned, "toxic", toxicity.SAMPLE, toxicity.SAMPLE_CHARS))
    term, other = (model["terms"][i][0] for i in (0, -1))
    words = [f"you {term}", f'he said "{term}" once', f"{term[0]}{term[2:]} {other}x {other}", f"{term[:2]}0{term[3:]}!!", f"«{term}»", f"{term} " * 40, "", None, f"{'plain words ' * 150_000}{term} you", f"x{term}", f"{term}{term}"]
    more = spark.createDataFrame([(10**7 + i, t) for i, t in enumerate(words)], "doc_id long, text string")
    rows, memo = docs.select("doc_id", "text").unionByName(more).collect(), {}
    got = {r.doc_id: r for r in toxicity.toxicity(docs.select("doc_id", "text").unionByName(more), labels).collect()}
    assert len(got) == len(rows) and len(model["terms"]) > 2
    for r in rows:
        g, want = got[r.doc_id], brute_toxicity(model, r.text, memo)
        assert g.score == pytest.approx(want, abs=1e-9), (r.doc_id, r.text and r.text[:200])
        assert g.held_out == (fold(r.doc_id) == 2) and g.predicted == (g.score >= 0.3)
    assert sum(v is not None and v[0] == 1 for v in memo.values()) > 2
