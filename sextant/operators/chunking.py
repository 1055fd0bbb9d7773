"""Chunkers: one text to many rows."""

import re
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def guard(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap in [0, size)")


def simple(docs: DataFrame, size: int = 500, overlap: int = 50, text: Column | None = None) -> DataFrame:
    """doc_id, chunk_index, start, end, text: windows of `size` characters, `size - overlap` apart, all built-in."""
    guard(size, overlap)
    step = size - overlap
    t = docs.select("doc_id", (F.col("text") if text is None else text).alias("_t")).where(F.length("_t") > 0)
    n = F.length("_t")
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step))).cast("int")
    rows = t.select("doc_id", "_t", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    start = F.col("chunk_index") * step
    return rows.select("doc_id", "chunk_index", start.alias("start"), F.least(start + size, n).alias("end"), F.substring("_t", start + 1, F.lit(size)).alias("text"))


def lines(docs: DataFrame, size: int = 20, overlap: int = 0) -> DataFrame:
    """doc_id, chunk_index, line_start (from 1), line_end, text: windows of whole lines, line ends kept."""
    guard(size, overlap)
    step = size - overlap
    parts = F.split("text", "\n", -1)
    whole = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x: F.concat(x, F.lit("\n")))
    tail = F.element_at(parts, -1)
    t = docs.where(F.length("text") > 0).select("doc_id", F.when(tail == "", whole).otherwise(F.concat(whole, F.array(tail))).alias("_l"))
    n = F.size("_l")
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step))).cast("int")
    rows = t.select("doc_id", "_l", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    start = F.col("chunk_index") * step
    return rows.select("doc_id", "chunk_index", (start + 1).alias("line_start"), F.least(start + size, n).alias("line_end"), F.array_join(F.slice("_l", start + 1, F.lit(size)), "").alias("text"))


#: What counts as a heading.
_ATX = re.compile(r"^(#{1,6})\s+(.+?)(?:\s+#+)?$", re.M)
_SETEXT = re.compile(r"^(.+?)\n([=-]{3,})$", re.M)


def headings(text: str) -> list[tuple[int, int, str]]:
    """(place, level, heading) by place."""
    found = [(m.start(), len(m[1]), m[2].strip()) for m in _ATX.finditer(text)]
    found += [(m.start(), 1 if m[2][0] == "=" else 2, m[1].strip()) for m in _SETEXT.finditer(text)]
    return sorted(found, key=lambda x: x[0])


def pieces(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    out, at = [], 0
    while text:
        end = min(at + size, len(text))
        out.append((at, end))
        if end >= len(text):
            break
        at += size - overlap
    return out


def markdown_rows(text: str, size: int, overlap: int):
    heads = headings(text)
    if not text:
        return
    if not heads:
        for i, (s, e) in enumerate(pieces(text, size, overlap)):
            yield i, s, e, text[s:e], None, None
        return
    for i, (s, level, title) in enumerate(heads):
        e = heads[i + 1][0] if i + 1 < len(heads) else len(text)
        if e - s <= size:
            yield i, s, e, text[s:e], title, level
        else:
            for j, (a, b) in enumerate(pieces(text[s:e], size, overlap)):
                yield j, s + a, s + b, text[s + a : s + b], title, None


#: Rows that a table function gives out at once, so that a batch of long texts isn't held with all its rows.
ROWS = 4096


def _table(docs: DataFrame, make, ddl: str) -> DataFrame:
    """A Python table function by Arrow batches: make(text) gives the rows of one text."""
    import pandas as pd

    names = ["doc_id", *(c.split()[0] for c in ddl.split(", "))]

    def run(batches):
        for b in batches:
            rows = ((d, *r) for d, t in zip(b["doc_id"], b["text"]) if t is not None for r in make(t))
            while part := list(islice(rows, ROWS)):
                yield pd.DataFrame(part, columns=names)

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {ddl}")


def markdown(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """Sections from heading to heading; long ones are divided.  Text before the first heading is dropped."""
    guard(size, overlap)
    return _table(docs, lambda t: markdown_rows(t, size, overlap), "chunk_index int, start int, end int, text string, heading string, level double").withColumn("level", F.col("level").cast("int"))


def python_rows(code: str):
    import ast

    if not code.strip():
        return
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError):
        yield 0, "parse_error", None, 1, code.count("\n") + 1, 0, len(code.encode()), code
        return
    at = [0]
    for line in code.encode().splitlines(keepends=True):
        at.append(at[-1] + len(line))
    found = [n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
    raw = code.encode()
    for i, n in enumerate(sorted(found, key=lambda n: (n.lineno, n.col_offset))):
        s, e = at[n.lineno - 1] + n.col_offset, at[n.end_lineno - 1] + n.end_col_offset
        yield i, "class_definition" if isinstance(n, ast.ClassDef) else "function_definition", n.name, n.lineno, n.end_lineno, s, e, raw[s:e].decode()
    if not found:
        yield 0, "source_file", None, 1, code.count("\n") + 1, 0, len(raw), code


def braces_rows(code: str, language: str):
    """TypeScript and Go by declarations and matching braces: an approximation, without a parser."""
    go = r"^[ \t]*(?:func\s*(?:\([^)]*\)\s*)?(?P<f>\w+)|type\s+(?P<c>\w+))"
    ts = r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\s+(?P<f>\w+)|(?:abstract\s+)?class\s+(?P<c>\w+)|const\s+(?P<a>\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>)"
    for i, m in enumerate(re.finditer(go if language == "go" else ts, code, re.M)):
        open_at, depth, end = code.find("{", m.end()), 0, len(code)
        if open_at < 0:
            end = (code.find("\n", m.end()) + 1) or len(code)
        for j in range(open_at, len(code) if open_at >= 0 else open_at):
            depth += (code[j] == "{") - (code[j] == "}")
            if not depth:
                end = j + 1
                break
        d = m.groupdict()
        kind = "class_declaration" if d.get("c") else "function_declaration"
        s = m.start()
        yield i, kind, d.get("f") or d.get("c") or d.get("a"), code.count("\n", 0, s) + 1, code.count("\n", 0, end) + 1, len(code[:s].encode()), len(code[:end].encode()), code[s:end]


def code(docs: DataFrame, language: str) -> DataFrame:
    """Definitions of source texts as chunks; byte offsets."""
    ddl = "chunk_index int, type string, name string, start_line int, end_line int, start_byte int, end_byte int, text string"
    return _table(docs, python_rows if language == "python" else lambda t: braces_rows(t, language), ddl)


CHUNKERS = {"simple": simple, "line": lines, "markdown": markdown}


def register(name: str):
    def add(f):
        CHUNKERS[name] = f
        return f

    return add


def for_language(docs: DataFrame, language: str, size: int = 500, overlap: int = 50) -> DataFrame:
    """doc_id, chunk_index, text by the language's chunker; texts it finds nothing in fall back to the simple one."""
    if language in ("python", "typescript", "go"):
        out = code(docs, language)
    else:
        out = CHUNKERS.get(language, simple)(docs, size, overlap)
    rest = docs.join(out.select("doc_id").distinct(), "doc_id", "left_anti")
    cols = ["doc_id", "chunk_index", "text"]
    return out.select(*cols).unionByName(simple(rest, size, overlap).select(*cols))


def estimated(docs: DataFrame, per: str, size: Column | str = "n_chars", chunk_size: int = 500) -> DataFrame:
    """per, chunks: how many chunks its documents are estimated to give, one each at least; a null size counts as none."""
    length = F.coalesce(F.col(size) if isinstance(size, str) else size, F.lit(0))
    return docs.groupBy(per).agg(F.sum(F.greatest(F.lit(1), F.floor(length / chunk_size))).alias("chunks"))


def ingest(docs: DataFrame, chunk_size: int = 500) -> DataFrame:
    """Trimmed texts chunked by characters, with ids and counts: id, doc_id, chunk_index, chunk_count, text."""
    from pyspark.sql import Window

    size = max(50, min(10_000, chunk_size))
    trimmed = F.regexp_replace(F.regexp_replace("text", r"^[\s  - 　]+", ""), r"[\s  - 　]+$", "")
    c = simple(docs, size, min(50, size // 10), trimmed)
    return c.select(
        F.concat_ws(":chunk:", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("id"), "doc_id", "chunk_index",
        F.count("*").over(Window.partitionBy("doc_id")).alias("chunk_count"), "text",
    )


#: Languages of each chunker; one that names none takes all.
LANGUAGES = {"simple": [], "line": [], "markdown": ["markdown", "md"], "code": ["python", "typescript", "go"]}


def supports(chunker: str, language: str) -> bool:
    known = LANGUAGES.get(chunker, [])
    return not known or language.lower() in known
