"""Metadata maps of documents, and the checks of incoming values."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits of names, texts and batches.
NAME, NAME_LENGTH, TEXT_LENGTH, BATCH = r"^[a-zA-Z0-9_-]+$", 128, 1_000_000, 1000


def split_payload(payload: Column, key: str = "document") -> tuple[Column, Column]:
    """(document text, the rest of the map)."""
    return payload[key], F.map_filter(payload, lambda k, _: k != key)


def merge(base: Column, extra: Column) -> Column:
    """Both maps; where a key is in both, the later one wins."""
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(extra, k))
    return F.when(base.isNull(), extra).when(extra.isNull(), base).otherwise(F.map_concat(kept, extra))


def with_doc_id(doc_id: Column, extra: Column) -> Column:
    """A string map with doc_id put in first, so that a doc_id of the document's own stays."""
    return merge(F.create_map(F.lit("doc_id"), doc_id.cast("string")), extra)


def name_problem(name: Column) -> Column:
    """Why a collection name is refused; null if it isn't.  Blanks around it don't count."""
    t = F.trim(name)
    return F.when(name.isNull() | (t == ""), "empty").when(~t.rlike(NAME), "characters").when(F.length(t) > NAME_LENGTH, "length")


def text_problem(text: Column, most: int = TEXT_LENGTH) -> Column:
    return F.when(text.isNull(), "missing").when(F.regexp_replace(text, r"\s+", "") == "", "blank").when(F.length(text) > most, "length")


def range_problem(value: Column, low: int, high: int) -> Column:
    return F.when(value.isNull(), "required").when((value < low) | (value > high), "range")


def depth_problem(metadata, most: int = 3) -> str | None:
    """Of one decoded JSON value: nesting beyond most, keys that aren't strings or types that JSON lacks."""
    todo = [(metadata, 0)]
    while todo:
        x, depth = todo.pop()
        if depth > most:
            return "depth"
        if isinstance(x, dict):
            if not all(isinstance(k, str) for k in x):
                return "key"
            todo += [(v, depth + 1) for v in x.values()]
        elif isinstance(x, list):
            todo += [(v, depth + 1) for v in x]
        elif not (x is None or isinstance(x, (str, int, float, bool))):
            return "type"
    return None


def json_problem(text: Column, most: int = 3) -> Column:
    """The same of a column of JSON texts: json (not valid), type (not an object), depth, or null.

    Strings and empty containers are taken out of a text's structure; the open brackets that are left at a time are its depth.
    """
    bare = F.regexp_replace(F.regexp_replace(text, r'"(\\.|[^"\\])*"', "s"), r"\s+", "")
    marks = F.regexp_replace(F.regexp_replace(bare, r"\{\}|\[\]", "v"), r"[^{}\[\]]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"))

    def step(acc: Column, mark: Column) -> Column:
        now = acc["now"] + F.when(mark.isin("{", "["), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(acc["top"], now).alias("top"))

    depth = F.aggregate(F.filter(F.split(marks, ""), lambda x: x != ""), start, step)["top"]
    kind = F.schema_of_variant(F.try_parse_json(text))
    return F.when(kind.isNull(), "json").when(~kind.startswith("OBJECT"), "type").when(depth > most, "depth")


def first_within(spans: DataFrame, names: DataFrame, width: int = 1024) -> DataFrame:
    """spans (doc_id, start, end, ...) with the first name (doc_id, pos, name) that starts inside; null if there is none.

    Both sides are dealt to bins of `width` places, a span to each bin that it touches: what meets is a bin's spans and names,
    however many a document has.  Spans much longer than width stand in many bins, so take about their mean length.
    """
    n = names.select("doc_id", F.col("pos").alias("_p"), F.col("name").alias("_n"), F.floor(F.col("pos") / width).alias("_bin"))
    bins = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))
    inside = spans.select("doc_id", "start", "end").where("`end` > start").distinct().withColumn("_bin", F.explode(bins))
    inside = inside.join(n, ["doc_id", "_bin"]).where("_p >= start and _p < `end`")
    first = inside.groupBy("doc_id", "start", "end").agg(F.min_by("_n", "_p").alias("name"))
    return spans.join(first, ["doc_id", "start", "end"], "left")


def semver(version: Column) -> Column:
    """struct(major, minor, patch) of a version such as 1.2.3 or v1.2.3-rc1; null if it isn't one."""
    pattern = r"^v?(\d+)\.(\d+)\.(\d+)(?:[-+].*)?$"
    part = lambda i: F.regexp_extract(version, pattern, i).cast("int")
    return F.when(version.rlike(pattern), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


def sanitised(df: DataFrame, *cols: str) -> Column:
    """A JSON object of the columns: texts, numbers, booleans and nulls stay, everything else becomes its text."""
    plain = ("string", "tinyint", "smallint", "int", "bigint", "float", "double", "boolean")
    kinds = dict(df.dtypes)
    return F.to_json(F.struct(*(F.col(c) if kinds[c] in plain else F.col(c).cast("string").alias(c) for c in cols)), {"ignoreNullFields": "false"})
