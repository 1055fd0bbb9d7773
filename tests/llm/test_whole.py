"""No row is dropped from op5 and none without a word from near_dedup."""

from sextant.llm import minhash, topk


def test_topk_takes_every_row_of_an_id(spark):
    """Two vectors of one id are both candidates and both queries; the query's SQL agrees."""
    import duckdb

    rows = [(1, [1.0, 0.0]), (1, [0.0, 3.0]), (1, [0.0, 3.0]), (2, [2.0, 2.0]), (50, [1.0, 1.0]), (50, [5.0, -1.0]), (100, [0.0, 1.0]), (3, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    ints = topk.integers(df, "vec_id", "embedding")
    got = sorted(tuple(r) for r in topk.exact_topk(ints, ints.where("vec_id % 50 = 0"), 5).collect())
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding float[])")
    con.executemany("insert into embeddings values (?, ?)", rows)
    assert got == sorted(con.execute(topk.SQL).fetchall())
    assert [r[2] for r in got if r[0] == 100].count(1) == 3


def test_rows_of_empty_sets_all_stay(spark):
    """Equal ids and equal texts without a word are no copies; rows of other texts are."""
    empty = [(1, "", "a"), (1, "", "b"), (None, None, "a"), (None, None, "b"), (2, " \t\n\x0b", "a"), (2, " \t\n\x0b", "a")]
    docs = spark.createDataFrame([*empty, (3, "one two three four", "a"), (3, "one two three four", "b"), (4, "ONE two  three four", "c"), (5, "\u00a0", "d")], "doc_id long, text string, source string")
    kept = minhash.deduplicate(docs)
    assert kept.columns == docs.columns
    got = [tuple(r) for r in kept.collect()]
    assert sorted(map(str, (r for r in got if r[0] not in (3, 4, 5)))) == sorted(map(str, empty))
    assert [r[0] for r in got if r[0] in (3, 4)] == [3] and [r[0] for r in got if r[0] == 5] == [5]


def test_topk_beyond_doubles():
    """Scores that doubles can't tell apart are ordered exactly; those beyond a long end at its limits."""
    import numpy as np

    rng = np.random.default_rng(4)
    for size, n in ((10**6, 200), (2**28, 200), (2**40, 40)):
        v = rng.integers(-3, 4, (n, 4)) + rng.choice([-size, size], (n, 4))
        q = v[:9]
        qid, vid, s = topk.block_topk(np.arange(9), q.astype(float), np.arange(n), v.astype(float), np.eye(4), 5)
        want = []
        for i in range(9):
            every = [(max(min(sum(int(a) * int(b) for a, b in zip(q[i], v[j])), 2**63 - 1), 1 - 2**63), j) for j in range(n) if j != i]
            want += [(i, j, x) for x, j in sorted(every, key=lambda e: (-e[0], e[1]))[:5]]
        assert list(zip(qid.tolist(), vid.tolist(), s.tolist())) == want

