"""Small helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.sources.files import scratch

#: The characters that separate words, as a Java character class.
SPACE = r"[\x20\x09-\x0D]"

#: Largest table, in rows, that an operator hands to F.broadcast (under 200 bytes a row: 40 MB at most).
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read back, so that a lost executor repeats nothing."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(taken, *names: str) -> list[str]:
    """Names for private columns that aren't among those taken (Spark compares without regard to case)."""
    held = {c.lower() for c in (taken.columns if isinstance(taken, DataFrame) else taken)}
    out = []
    for n in names:
        while n.lower() in held:
            n = f"_{n}"
        held.add(n.lower())
        out.append(n)
    return out


def row_id(*cols: str) -> Column:
    """md5 of columns as text, as 16 bytes; null differs from every text, and lengths keep columns apart."""
    text = lambda c: F.coalesce(F.encode(F.col(c).cast("string"), "UTF-8"), F.lit(b""))
    size = lambda c: F.encode(F.coalesce(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit("-")), "UTF-8")
    return F.unhex(F.md5(F.concat(*(x for c in cols for x in (size(c), F.lit(b":"), text(c))))))


def checked_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting; a larger table is left to a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def words(text: Column) -> Column:
    """Array of words of a text; null counts as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+", -1), lambda w: w != "")


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod (a null id counts as the empty text)."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(mod))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once per row: a lambda variable isn't inlined again."""
    return F.transform(F.array(value), body)[0]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int) -> list[tuple[str, int]]:
    """Whole texts of at most per_class labelled documents of each class, in the order of a hash of the id.

    labels: (doc_id, label) rows that may be learned from.  The two bounds are parameters of the fit alone: they bound
    what is collected, also where an id has many rows (then one of its texts, the greatest by hash, is taken).
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("_y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = rows.where("_y = 1").orderBy(*order).limit(per_class).unionByName(rows.where("_y = 0").orderBy(*order).limit(per_class))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= max_chars).join(F.broadcast(ids), "doc_id")
    one = texts.groupBy("doc_id", "_y").agg(F.max(F.struct(F.xxhash64("text", "doc_id").alias("h"), "text")).alias("t"))
    found = one.select("t.h", "t.text", "_y").collect()
    return list({r.text: (r.text, r._y) for r in sorted(found, key=lambda r: (r.h, r._y), reverse=True)}.values())


def map_texts(docs: DataFrame, columns: list[str], score, schema: str) -> DataFrame:
    """mapInArrow over (columns..., text): score(list of texts) gives a list of lists, the new columns.

    New columns replace given ones of the same name.
    """
    import pyarrow as pa
    from pyspark.sql.types import StructType

    extra = StructType.fromDDL(schema)
    columns = [c for c in columns if c.lower() not in {n.lower() for n in extra.names}]
    rows = docs.select(*columns, *(["text"] if "text" not in columns else []))
    kept, at = len(columns), rows.columns.index("text")
    out = StructType([rows.schema[c] for c in columns] + extra.fields)
    names = out.names

    def run(batches):
        for b in batches:
            new = score([t or "" for t in b.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[:kept], *map(pa.array, new)], names=names)

    return rows.mapInArrow(run, out)
