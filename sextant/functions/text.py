"""Scalar text functions shared by the lexical operators."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The usual English stop words of lexical search.
STOPWORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
TOKEN = r"[\p{L}\p{N}_]{2,}"

#: File extension to language.
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "rs": "rust", "java": "java",
    "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "scala": "scala",
    "md": "markdown", "txt": "text", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "html": "html", "css": "css", "sql": "sql", "sh": "shell",
}


def tokens(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0)), lambda t: ~t.isin(STOPWORDS))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("text"))


def excluded(path: Column, dirs: list[str]) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, dirs)))


def password_problems(p: Column) -> Column:
    """Rules that a password breaks, in a fixed order."""
    rules = [("length", F.length(p) < 8), ("upper", ~p.rlike("[A-Z]")), ("lower", ~p.rlike("[a-z]")), ("digit", ~p.rlike("[0-9]"))]
    return F.filter(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules)), lambda x: x.isNotNull())


def path_allowed(path: Column, roots: list[str], forbidden: list[str]) -> Column:
    """No parent steps, no forbidden tree (by whole components), inside one of the roots if any are given."""
    inside = lambda r: (path == r) | path.startswith(r.rstrip("/") + "/")
    ok = ~F.array_contains(F.split(path, "/"), "..")
    for f in forbidden:
        ok = ok & ~inside(f)
    any_root = F.lit(not roots)
    for r in roots:
        any_root = any_root | inside(r)
    return ok & any_root
