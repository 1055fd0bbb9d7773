"""Mixing sources to target weights by systematic sampling.

Sources in code-point order (null last) get weights 5, 2, 1, 5, 2, 1, ...; together they get `share` times all
words, and no source more than `cap` times its own (the excess is dealt out again by weight: a water level).  Within
a source every document expects target / size copies.  Documents are ranked by size and a hash, the expected copies
are summed along the rank, one offset per source is added, and a copy is emitted for each integer crossed.  Since
neighbours in rank have near-equal sizes, the taken words stay within about one long document of the target.

The rank is found in two levels: rows are counted per (source, size, hash prefix), the counts are summed over this
small table, and rows are numbered only within one such cell.  No source is gathered in one task, and the cells meet the
rows in a join by cell, which the numbering is dealt by anyway.  The counts come from a table of (source, size, prefix)
written once; the texts are read twice, to write it and to number the rows.

Null text has size 0; a null source is a source of its own; repeated rows are sampled one by one, and ties (one size)
are ordered by the md5 of the id and of the text; a very long text is one row that is taken at most CAP times; an empty
table gives an empty result.  Other columns are carried along by mix(), whatever their names, except those it computes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import BROADCAST_ROWS, fresh, materialize, words

#: The repeating weights.
WEIGHTS = (5, 2, 1)
SHARE, CAP, SEED = 1.5, 2.0, "mix-1"


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sizes: one row per source with src (ordered key) and source_size.  Adds target.  (A row a source: one task.)"""
    order = Window.orderBy("src")
    cyc = (F.row_number().over(order) - 1) % len(weights)
    t = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (cyc + 1).cast("int")).cast("double"))
    t = t.withColumn("cap", cap * F.col("source_size")).withColumn("q", F.col("cap") / F.col("w"))
    up = Window.orderBy("q", "src")
    everything = Window.partitionBy()
    t = t.withColumn("before", F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("rest", F.sum("w").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    t = t.withColumn("level", (share * F.sum("source_size").over(everything) - F.col("before")) / F.col("rest"))
    level = F.min(F.when(F.col("level") <= F.col("q"), F.struct("q", "src", "level"))).over(everything).getField("level")
    return t.withColumn("target", F.coalesce(F.least(F.col("cap"), level * F.col("w")), F.col("cap"))).select("src", "source_size", "target")


def source_key(source: Column) -> Column:
    """Sorts as the source by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def offset(src: Column, seed: str = SEED) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), src)), 1, 8), 16, 10).cast("double") / 4294967296.0


#: Hex digits of the hash that divide the documents of one source and size.
PREFIX = 2


def mix(docs: DataFrame, *, seed: str = SEED, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """docs (doc_id, text, source, ...) plus size, source_size, target, copies and taken."""
    added = ("size", "source_size", "target", "copies", "taken")
    docs = docs.drop(*added)
    src, h, cell, n, before, r = fresh([*docs.columns, *added], "src", "h", "cell", "n", "before", "r")
    hashed = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    own = [n_words(F.col("text")).alias("size"), source_key(F.col("source")).alias(src)]
    slim = docs.select(*own, F.substring(hashed, 1, PREFIX).alias(cell)).groupBy(src, "size", cell).agg(F.count("*").alias(n))
    cells = materialize(slim)
    plan = targets(cells.groupBy(F.col(src).alias("src")).agg(F.sum(F.col("size") * F.col(n)).cast("long").alias("source_size")), weights, share, cap)
    plan = materialize(plan.withColumnRenamed("src", src))
    small = F.broadcast(plan) if plan.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else plan
    ahead = Window.partitionBy(src).orderBy("size", cell).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn(before, F.coalesce(F.sum(n).over(ahead), F.lit(0))).drop(n)
    rows = docs.select("*", *own, hashed.alias(h)).withColumn(cell, F.substring(h, 1, PREFIX))
    within = Window.partitionBy(src, "size", cell).orderBy(h, F.md5(F.coalesce(F.col("text"), F.lit(""))))
    # The numbering deals the rows by cell; the join finds them there.
    ranked = rows.withColumn(r, F.row_number().over(within)).join(cells.hint("merge"), [src, "size", cell]).join(small, src)
    rank = (F.col(before) + F.col(r)).cast("double")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = offset(F.col(src), seed)
    copies = F.floor(rank * rate + u) - F.floor((rank - 1) * rate + u)
    out = ranked.withColumn("copies", copies.cast("long")).withColumn("taken", (copies * F.col("size")).cast("long"))
    return out.select(*docs.columns, *added)


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The documents of the mix, a row for each copy."""
    i = fresh(mixed, "i")[0]
    return mixed.where("copies > 0").withColumn(i, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*columns)


#: DuckDB SQL for the query (same formulas, one window over each source).
SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('0' || source, '1') AS src, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS h, md5(coalesce(text, '')) AS th
  FROM documents),
s AS (SELECT src, sum(size)::BIGINT AS source_size FROM d GROUP BY src),
w AS (SELECT *, ([5, 2, 1])[1 + ((row_number() OVER (ORDER BY src) - 1) % 3)]::DOUBLE AS w FROM s),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS q FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY q, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(w) OVER (ORDER BY q, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
v AS (SELECT level FROM l WHERE level <= q ORDER BY q, src LIMIT 1),
t AS (SELECT src, source_size, coalesce(least(cap, (SELECT level FROM v) * w), cap) AS target, ('0x' || substr(md5('mix-1' || src), 1, 8))::UBIGINT / 4294967296.0::DOUBLE AS u FROM l),
r AS (SELECT doc_id, size, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
             (row_number() OVER (PARTITION BY d.src ORDER BY size, h, th))::DOUBLE AS k
      FROM d JOIN t USING (src))
SELECT doc_id, size, source_size, target, ((floor(k * rate + u) - floor((k - 1) * rate + u)) * size)::BIGINT AS taken FROM r
"""
