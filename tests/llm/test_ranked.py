"""op12 on awkward rows against scoring every document in plain Python."""

import math
import re
from collections import Counter

from sextant.llm import ranked

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute(items, docs, k):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    held = [(i, Counter(WORD.findall(low(t)))) for i, t in docs]
    full, total = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(x for _, c in held for x in c)
    out = []
    for item, text in set(items):
        scored = []
        for at, (i, c) in enumerate(held):
            m = 100 - 25 + (25 * sum(c.values()) * full) // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * full + 2) / (2 * df[x] + 1))) * ((10**9 * c[x]) // (1000 * c[x] + 12 * m)) for x in WORD.findall(low(text)) if x in c)
            if s > 0:
                scored.append((-s, math.inf if i is None else i))
        out += [(str(item), r + 1, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def test_against_brute_force(spark):
    words = ["Alpha", "beta", "GAMMA", "delta9", "ÉTÉ", "été", "中文", "the", "THE", "x_y", "a-b"]
    docs = [(i, " ".join(words[(i * j + j) % len(words)] for j in range(1 + i % 13))) for i in range(150)]
    docs += [(3, docs[3][1]), (3, "alpha alpha"), (None, "alpha été"), (None, None), (400, None), (401, ""), (402, "_ - !"), (403, "alpha " * 30000)]
    items = [(1, "alpha BETA beta"), (1, "alpha BETA beta"), (1, "中文 x"), (2, None), (3, ""), (None, "the été"), (4, "nowhere"), (5, "the " * 40 + "gamma")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as term", "2 as shard", "3 as score")
    q = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as query_id", "2 as doc_id")
    for k in (1, 20):
        got = sorted(((str(r.item_id), r["rank"], r.doc_id, r.score) for r in ranked.ranked(q, d, k).collect()), key=str)
        assert got == brute(items, docs, k)
    built = ranked.index(d)  # all terms
    assert sorted(((str(r.item_id), r["rank"], r.doc_id, r.score) for r in ranked.rank(q, built).collect()), key=str) == brute(items, docs, 20)
    assert ranked.ranked(q.limit(0), d).count() == 0 == ranked.ranked(q, d.limit(0)).count()
