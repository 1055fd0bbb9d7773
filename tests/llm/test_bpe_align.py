"""op11 and op13 against the libraries on whole texts."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sextant.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(seed: int, n: int):
    """Texts of runs that are awkward to cut: long words, spaces, digits, marks, other scripts, special tokens."""
    r = random.Random(seed)
    kinds = ["abc", "the", "  ", " ", "\n", "\t ", "'s", "'re", "'", "12", "é", "中文", "あ", "!", "...", "\U0001f600", "́", " ", " ", "<|endoftext|>", "<|endo", "A", "xq", "ஸ", "ǰ", "ẞ", "͸", "\U0001fae0"]
    for _ in range(n):
        some = r.sample(kinds, r.randint(1, 6))
        yield "".join(r.choice(some) * r.choice([1, 1, 1, 2, 30]) for _ in range(r.randint(0, 40)))


def test_tree_is_the_library(library):
    model = bpe.Bpe(PATH)
    for i, t in enumerate(texts(1, 1500)):
        for size in (1, 2 + i % 7, 16):
            got = [x for p in model.parts(t) for x in ([model.special[p]] if p in model.special else model.tree(p, 0, len(p), size).tolist())]
            assert got == library.encode(t, add_special_tokens=False).ids, (t, size)


def test_long_runs(library, monkeypatch):
    """Runs that the pattern never splits are joined inside; the whole is encoded anew for none of them."""
    model, r = bpe.Bpe(PATH), random.Random(2)
    monkeypatch.setattr(bpe, "NEAR", 64)
    calls = []
    leaf = model.leaf
    model.leaf = lambda t: (calls.append(len(t)), leaf(t))[1]
    for chars in ("abcdefghij", "etaoin", "0123456789", "中文字符", "!?.,", " ", "éèe"):
        t = "".join(r.choice(chars) for _ in range(20000))
        assert model.tree(t, 0, len(t), 500).tolist() == library.encode(t, add_special_tokens=False).ids
    assert max(calls) < 1500


def test_vocabulary_is_its_own_encoding():
    """Each token's bytes merge to the token, which the join inside a run rests on."""
    model = bpe.Bpe(PATH)
    for t in random.Random(3).sample(sorted(model.ranks), 4000):
        assert model.merge(t).tolist() == [model.ranks[t]]


def test_encode_rows(spark, library, monkeypatch):
    for name, size in (("LEAF", 50), ("PIECE", 300), ("SPREAD", 700), ("OUT", 2000)):
        monkeypatch.setattr(bpe, name, size)
    rows = [(i, t) for i, t in enumerate(texts(4, 120))] + [(7, "same " * 400)] * 3 + [(None, None), (None, ""), (None, "long" * 500), (5, "x<|endoftext|>" * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as key")
    got = sorted((str(r.doc_id), r.ids, r.decoded) for r in bpe.encode(docs, PATH, decoded=True).collect())
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), ids, library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    empty = bpe.digests(docs.limit(0), PATH)
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_decode(spark, library):
    r = random.Random(5)
    rows = [(i, [r.randrange(50257) for _ in range(r.randint(0, 30))]) for i in range(200)] + [(None, None), (1, [50256, 99999, -1])]
    got = dict((str(x.doc_id) + str(x.ids), x.decoded) for x in bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), PATH).withColumn("ids", bpe.F.lit(None)).collect())
    model = bpe.Bpe(PATH)
    for i, ids in rows[:200]:
        assert model.decode(np.array(ids, "i4")) == library.decode(ids, skip_special_tokens=False)
    assert len(got) == 201


def brute_alignment(rows):
    """The contract on whole texts: offsets where tokens of both sides end, links and counts."""
    import sentencepiece
    from collections import Counter, defaultdict

    a_side = Tokenizer.from_file(PATH)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    model = bpe.Bpe(PATH)
    docs, counts = [], Counter()
    for i, t in rows:
        groups, links, n = [], [], (0, 0)
        if t:
            given = (" " + t).encode()
            a, b = a_side.encode(" " + t, add_special_tokens=False).ids, b_side.encode(t)
            sides = [model.tokens[x] for x in a], [bytes([int(p[3:-1], 16)]) if b_side.is_byte(x) else p.replace("▁", " ").encode() for x, p in zip(b, b_side.encode(t, out_type=str))]
            if all(b"".join(s) == given for s in sides):
                ends = [np.cumsum([len(x) for x in s]).tolist() for s in sides]
                n = len(a), len(b)
                both = sorted(set(ends[0]) & set(ends[1]))
                links = [(a[ends[0].index(e)], b[ends[1].index(e)]) for e in both]
                for lo, hi in zip([0, *both], both):
                    groups.append([",".join(str(x) for x, e in zip(ids, side) if lo < e <= hi) for ids, side in ((a, ends[0]), (b, ends[1]))])
        counts.update(links)
        docs.append((i, n, groups, links))
    top = defaultdict(int)
    for (_, y), c in counts.items():
        top[y] = max(top[y], c)
    import hashlib

    told = lambda g: hashlib.sha256(";".join("|".join(x) for x in g).encode()).hexdigest() if g else ""
    return sorted((str(i), *n, len(g), len(k), sum(counts[x] == top[x[1]] for x in k), sum(counts[x] for x in k), told(g)) for i, n, g, k in docs)


def test_alignment_rows(spark):
    from sextant.llm import align

    rows = [(i, t) for i, t in enumerate(texts(6, 300))] + [(1, "the cat sat on the mat"), (1, "the cat sat on the mat"), (None, None), (None, ""), (2, "a▁b c"), (3, "a▁ b"), (4, "<s> x </s>\0y\r\n z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as pairs", "2 as n_a")
    paths = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    got = align.digests(docs.repartition(3), *paths)
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == brute_alignment(rows)
    assert align.digests(docs.limit(0), *paths).count() == 0
    short = [r for r in align.align(docs.where("doc_id = 1 and text like 'the%'"), *paths).collect()]
    assert len(short) == 2 and short[0].groups.count("|") == short[0].n_groups == sum(short[0].counts)
