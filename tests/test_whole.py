"""Whole texts, long paths and the ends of the pipeline's thresholds."""

import hashlib

from sextant import catalog
from sextant.operators import chunking, graph


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_markdown_of_whole_texts(spark, tmp_path):
    """Long sections, texts without headings, both heading styles, null sources and languages; the query's SQL agrees."""
    import duckdb

    long = "word é😀 " * 300
    cases = [long, "", None, "x\n#\u00a0A ##\n" + "y" * 700 + "\nSet \n===\n# \n\n\u2003B\n####### no\n#\n---\n-----\nend\n", "## C\r\n###\tD\x0b\n#" + long, "a\n----\nb\n# c\n---"]
    heads = [("s", "en"), (None, "en"), ("s", None), (None, None), ("", "")]
    docs = [(i, t, *h) for i, (t, h) in enumerate((t, h) for t in cases for h in heads)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    cols = ["doc_id", "chunk_index", "start", "end", "heading", "level", "h"]
    got = rows(catalog.QUERIES["chunk_markdown_text"](spark, str(tmp_path)), *cols)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    names = ", ".join(f'"{c}"' for c in cols)
    assert got == sorted(con.execute(f"select {names} from ({catalog.ORACLE_SQL['chunk_markdown_text']})").fetchall(), key=str)
    want = []
    for i, t, source, lang in docs:
        x = "\n".join(p for p in (None if source is None else f"# {source}", None if lang is None else f"{lang}\n---", t) if p is not None)
        want += [(i, j, s, e, title, level, hashlib.md5(part.encode()).hexdigest()) for j, s, e, part, title, level in chunking.markdown_rows(x, 500, 50)]
    assert got == sorted(want, key=str)
    assert sum(r[0] == 0 for r in got) > 4 and {r[4] for r in got if r[0] == 3} == {None} and {"A", "B", "C", "Set"} <= {r[4] for r in got}




def test_shortest_path_has_no_bound(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(i, 1) for i in range(2, 40, 7)] + [(60, 61)], "source long, target long")
    assert graph.shortest_path(chain, 1, 35).first().path == list(range(1, 36))
    assert graph.shortest_path(chain, 60, 1).count() == 0
    assert graph.shortest_path(chain, 1, 6, most=5).first().path == [1, 2, 3, 4, 5, 6] and graph.shortest_path(chain, 1, 6, most=4).count() == 0
