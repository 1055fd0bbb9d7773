import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sextant.llm import packing, ppm

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, extra string, sequence_id string"
ROWS = [(1, "the cat sat", "a", "x"), (1, "the cat sat", "a", "x"), (2, None, None, None), (None, "dog <|endoftext|> dog", "b", None), (3, "", "", ""), (4, "word " * 9000, None, None), (5, "Ünï çødé 😀 \t x", "", "")]


def check_packing(rows, texts, length=2048):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for doc, text in texts:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = packing.cut(len(ids), length)
        assert sum(n for _, n in cuts) == len(ids) and all(n == length for _, n in cuts[1:])
        want.update((doc, i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(cuts))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= length
    return len(seqs), sum(r.length for r in rows)


def test_packing_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    n, total = check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert n <= math.ceil(total / 2048) * 1.05 + 1


def test_packing_edges(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    check_packing(rows, [(r[0], r[1]) for r in ROWS])
    assert packing.pack(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 2048), max_size=300))
def test_plan_places_everything_once(lengths):
    hist = np.bincount(lengths, minlength=2049) if lengths else np.zeros(2049, int)
    p = packing.plan(hist.astype(np.int64))
    load, seen = Counter(), set()
    for n in set(lengths):
        seq, slot = packing.place(p, n, np.arange(hist[n]))
        for s, k in zip(seq, slot):
            assert (s, k) not in seen
            seen.add((s, k))
            load[s] += n
    assert max(load.values(), default=0) <= 2048 and set(load) == set(range(p["sequences"]))
    assert len(load) <= 2 * sum(lengths) / 2048 + 1


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=17, max_size=17))
def test_nnls_is_optimal(counts):
    """The gradient is zero where a pattern is used and points outward where it isn't."""
    cols, h = packing.patterns(16), np.array([0, *counts[1:]], float)
    x = packing.nnls(cols, h)
    r = packing.columns(cols, len(h)) @ x - h
    r[0] = 0
    grad = (r[cols] * (cols > 0)).sum(axis=1)
    assert (x >= 0).all() and grad.min() > -1e-6 and np.abs(grad[x > 1e-9]).max(initial=0) < 1e-6


def test_most_pieces_come_through_patterns(spark):
    """At sf0.01 patterns fitted by least squares place most pieces, and the sequences are nearly full."""
    lengths = [r.length for r in packing.pieces(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json")).select("length").collect()]
    hist = np.bincount(lengths, minlength=2049).astype(np.int64)
    p = packing.plan(hist)
    assert p["fitted"] >= 0.6 * len(lengths) and sum(lengths) / (2048 * p["sequences"]) > 0.98


def test_cells_divide_a_length(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 50, "same text " * (i % 3)) for i in range(400)], "doc_id long, text string")
    monkeypatch.setattr(packing, "CELL", 7)
    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()])


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=200))
def test_encoder_equals_tokenizers(text):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.encoder(path)(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def plain_ppm(trained, order=ppm.ORDER):
    """Partial matching written another way: every suffix of the past is a key of one table; the code of a text in log10."""
    seen = Counter()
    for t in trained:
        b = b"\0" * order + t + b"\xff"
        seen.update((b[i - k : i], b[i]) for i in range(order, len(b)) for k in range(order + 1))
    after = defaultdict(dict)
    for (c, s), n in seen.items():
        after[c][s] = n

    def code(t):
        b, out = b"\0" * order + t + b"\xff", 0.0
        for i in range(order, len(b)):
            gone, p = set(), 1.0
            for k in range(order, -1, -1):
                here = {s: n for s, n in after.get(b[i - k : i], {}).items() if s not in gone}
                if b[i] in here:
                    p *= (here[b[i]] - 0.5) / sum(here.values())
                    break
                if here:
                    p *= len(here) / 2 / sum(here.values())
                    gone.update(here)
            else:
                p /= 256 - len(gone)
            out += math.log10(p)
        return out

    return code


def brute_ppm(rows, trained):
    low = lambda t: re.sub(rb"[A-Z]", lambda m: bytes([m[0][0] + 32]), (t or "").encode())
    c, code = Counter(), plain_ppm([low(t) for t in trained])
    for t in trained:
        c.update([*re.findall(rb"[^\x20\x09-\x0d]+", low(t)), "end"])
    total, kinds = sum(c.values()), len(c)
    out = []
    for t in rows:
        w = [*re.findall(rb"[^\x20\x09-\x0d]+", low(t)), "end"]
        out.append((len(w), sum(c[x] > 0 for x in w), total, sum(math.log10((c[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in w), code(low(t))))
    return out


def held(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 10 == 0


def same_scores(got, rows, trained):
    """got: rows with doc_id; rows: (doc_id, text, ...)."""
    key = lambda x: (str(x[0]), *x[1:4], round(x[4], 4))
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    want = sorted(((r[0], *w) for r, w in zip(rows, brute_ppm([r[1] for r in rows], trained))), key=key)
    for g, w in zip(got, want, strict=True):
        assert g[:4] == w[:4] and g[4] == pytest.approx(w[4], rel=1e-9, abs=1e-9) and g[5] == pytest.approx(w[5], rel=1e-6)


def test_ppm_edges(spark):
    rows = [*ROWS[:4], (3, "", "", ""), (4, "word " * 300, None, None), ROWS[6], (8, "a\0b \u212a K\x0b" * 5, "", "")]
    got = ppm.scored(spark.createDataFrame(rows, DOCS)).collect()
    same_scores(got, rows, [r[1] for r in rows if not held(r[0])])
    assert all(r.held_out == held(r.doc_id) for r in got)
    assert ppm.scored(spark.createDataFrame([], DOCS)).count() == 0
    none = ppm.lm_scores(spark.createDataFrame(rows, DOCS), spark.createDataFrame([], DOCS)).collect()
    same_scores(none, rows, [])
    clash = spark.createDataFrame([(1, "a b", 3, 4, 0.5, "k", 1)] * 2 + [(2, "a", 3, 4, 0.5, "k", 1)], "doc_id long, text string, block int, part int, score double, _key string, b int")
    out = ppm.lm_scores(clash, clash)
    assert out.columns == ["doc_id", "block", "part", "_key", "b", *ppm.ADDED]
    assert Counter((r.block, r.part, r._key, r.b, r.n_tokens) for r in out.collect()) == Counter({(3, 4, "k", 1, 3): 2, (3, 4, "k", 1, 2): 1})


def test_ppm_whole_table(spark, monkeypatch):
    """Many blocks, parts, steps and levels of summing give the plain model's scores."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40)
    docs = spark.createDataFrame(docs.collect(), docs.schema).repartition(5)
    rows = docs.collect()
    trained = [r.text for r in rows if r.doc_id % 3 == 0]
    for block, parts, segment, most, tasks in ((1 << 24, None, ppm.SEGMENT, ppm.HELD, ppm.FAN_IN), (3000, 7, 999, 2000, 2), (9000, 150, 5000, 300, 64)):
        for name, value in (("SEGMENT", segment), ("HELD", most), ("FAN_IN", tasks)):
            monkeypatch.setattr(ppm, name, value)
        got = ppm.lm_scores(docs.select("doc_id", "text"), docs.where("doc_id % 3 = 0").select("text"), block, parts).collect()
        same_scores(got, [(r.doc_id, r.text) for r in rows], trained)


def test_ppm_divided_contexts(spark):
    """Frequent contexts are dealt by one more byte: no group that stays together exceeds a part's mean, and strings without an answer are an error."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").na.drop()
    low = ppm.low_counts(docs)
    texts = [r.text.encode().lower() for r in docs.collect()]
    assert low[ppm.LOW].counts.sum() == sum(len(t) + 1 for t in texts)
    u, divided = ppm.distinct(texts), ppm.frequent(low, 400)
    assert 0 < len(divided) < 400 * ppm.SHARE
    before, after = (max(map(len, ppm.by_part(u, 400, d))) * 400 / len(u) for d in (divided[:0], divided))
    assert after < before
    three, four = (u >> np.uint64(8)) & np.uint64(256**3 - 1), (u >> np.uint64(8)) & np.uint64(256**4 - 1)
    held = np.isin(three, divided)
    together = [np.unique(x, return_counts=True)[1].max() * 400 / len(u) for x in (three, three[~held], four[held])]
    assert together[0] > 3 and max(together[1:]) < 1
    index = ppm.Index(u[:50])
    assert (index[u[10:30]] == np.arange(10, 30)).all()
    for keys, asked in ((u[:50], u[45:60]), (u[:0], u[:1])):
        with pytest.raises(KeyError):
            ppm.Index(keys)[asked]


def test_ppm_very_long_text(spark):
    rows = [(1, "ab" * 1_500_000 + "c"), (2, "ab"), (3, "xyz " * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in ppm.lm_scores(docs, docs).collect()}
    trie = ppm.ByteTrie()
    for _, t in rows:
        trie.train(t.encode())
    assert got[1].n_tokens == 2 and all(got[i].score == pytest.approx(trie.log10(t.encode()), rel=1e-6) for i, t in rows[1:])


def test_ppm_tells_repeats_apart(spark):
    """Texts that the corpus holds twice have shorter codes a byte than those it holds once; held-out ones beat the base."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [r for r in docs.where("doc_id % 7 = 0 and length(text) between 400 and 3000").collect()]
    twice = {r.doc_id for r in rows[::2]}
    more = docs.unionByName(docs.where(docs.doc_id.isin(twice)).selectExpr("doc_id + 1000000 AS doc_id", "text"))
    got = {r.doc_id: r.score / len(r.text.encode()) for r in ppm.lm_scores(docs, more).join(docs, "doc_id").collect()}
    a, b = [got[i] for i in twice], [got[r.doc_id] for r in rows if r.doc_id not in twice]
    assert np.mean([x > np.median(b) for x in a]) > 0.9
    held_out = ppm.scored(docs).where("held_out").agg({"score": "sum", "base_score": "sum"}).collect()[0]
    assert held_out["sum(score)"] > held_out["sum(base_score)"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=30), max_size=6), st.lists(st.binary(max_size=20), max_size=4))
def test_levels_equal_the_trie(trained, probes):
    """The levels of one part, on arbitrary bytes but the one that closes a text."""
    trained, probes = ([x.replace(b"\xff", b"") for x in t] for t in (trained, probes))
    trie = ppm.ByteTrie()
    for t in trained:
        trie.train(t)
    u, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *ppm.grams(trained)]), return_counts=True)
    low = ppm.low_levels(*ppm.add_up([u & np.uint64(256 ** (ppm.LOW + 1) - 1)], [n]))
    model = ppm.PartialMatching(u, n, low)
    plain = plain_ppm(trained)
    for t in [*probes, *trained]:
        got = sum(model.log10(g).sum() for g in ppm.grams([t]))
        assert got == pytest.approx(trie.log10(t), rel=1e-9) and got == pytest.approx(plain(t), rel=1e-9)
    assert (ppm.unpack_sorted(ppm.pack_sorted(u)) == u).all() and (ppm.unpack(ppm.pack(n), np.int64) == n).all()


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=40), st.binary(max_size=3))
def test_trie_probabilities_sum_to_one(text, past):
    t = ppm.ByteTrie()
    t.train(text)
    assert sum(t.probability(past, s) for s in range(256)) == pytest.approx(1)
    full = ppm.ByteTrie(1)
    full.train(bytes(range(255)))
    assert sum(full.probability(past, s) for s in range(256)) == pytest.approx(1)
    assert ppm.ByteTrie().log10(text, adaptive=True) <= 0
