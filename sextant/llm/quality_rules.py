"""Quality rules: text counters and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed 1- and 2-grams are counted from the whole tables: a trusted target and the raw
corpus.  A document's score is the mean log ratio of its n-grams, so that length doesn't matter; a fixed
threshold decides for every document (no sampling).  Everything is a built-in expression: the ratio table has a
fixed number of buckets and reaches the rows as one array from a scalar subquery.

Null and empty texts have no words: zero counters, score 0, base_failed, not kept.  Repeated rows and null ids
are scored like any other row (a null id is never trusted); other columns of the input are carried along, but for
those that bear the name of a new one.  Very long texts are scored whole, in memory linear in their words.  An empty
table gives an empty result; with no trusted document every score is that of an empty target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import checked_broadcast, fresh, let, words

#: Hash buckets of the multinomials (one double each is broadcast: 512 KB).
BUCKETS = 1 << 16
#: Pseudo-count of a bucket: the target is smoothed towards the raw corpus.
PRIOR = 4.0
#: A document is kept if its mean log ratio is at least this.
THRESHOLD = -0.05


def base_counters(text: Column) -> dict[str, Column]:
    """Counters of one text; every one is linear or n log n in the text's words."""
    text = F.coalesce(text, F.lit(""))

    def counted(w: Column) -> Column:
        n = F.size(w)
        windows = F.when(
            n >= 3,
            F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("p"))),
        ).otherwise(F.array().cast("array<struct<g:string,p:int>>"))

        def repeated(s: Column) -> Column:
            """Places of windows equal to a neighbour in sorted order."""
            same = lambda x, j: F.coalesce(F.get(s, j).getField("g") == x.getField("g"), F.lit(False))
            return F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x.getField("p"))

        covered = let(F.sort_array(windows), lambda s: F.size(F.array_distinct(F.flatten(F.transform(repeated(s), lambda p: F.array(p, p + 1, p + 2))))))
        return F.struct(n.cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), covered.cast("long").alias("n_repeat_words"))

    lines = let(F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != ""), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return {"_words": let(words(text), counted), "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"), "n_dup_lines": lines.cast("long")}


def with_counters(docs: DataFrame) -> DataFrame:
    """docs plus the counters; columns of docs with their names give way."""
    docs = docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")
    c, held = base_counters(F.col("text")), fresh([*docs.columns, "n_symbols", "n_dup_lines"], "held")[0]
    out = docs.select("*", c["_words"].alias(held), c["n_symbols"].alias("n_symbols"), c["n_dup_lines"].alias("n_dup_lines"))
    out = out.select("*", *(F.col(held).getField(k).alias(k) for k in ("n_words", "word_chars", "n_repeat_words"))).drop(held)
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _bucket(buckets: int, *cols: Column) -> Column:
    return F.pmod(F.hash(*cols), F.lit(buckets))


def grams(w: Column, buckets: int) -> Column:
    """Buckets of the 1- and 2-grams of an array of words."""
    pairs = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: _bucket(buckets, x, F.get(w, i + 1)))
    return F.concat(F.transform(w, lambda x: _bucket(buckets, x)), pairs)


def log_ratios(raw: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> DataFrame:
    """One row with two arrays by bucket: log(p_target / p_raw) for an n-gram of a trusted document and of another.

    raw: columns text and _target (boolean: the row also belongs to the trusted target).  The n-gram itself is left out
    of the counts that judge it (also of the target's, if its document is trusted): counts that hold it would favour
    trusted documents, the more the smaller the corpus.  An n-gram whose bucket holds nothing else is neutral, 0.
    """
    hits = raw.select(F.coalesce(F.col("_target"), F.lit(False)).cast("int").alias("t"), F.explode(let(words(F.col("text")), lambda w: grams(w, buckets))).alias("b"))
    counts = hits.groupBy("b").agg(F.count("*").alias("raw"), F.sum("t").alias("tgt"))
    every = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(F.broadcast(counts), "b", "left")
    one = every.agg(F.array_sort(F.collect_list(F.struct("b", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("tgt", F.lit(0)).alias("tgt")))).alias("c"))
    summed = lambda k: F.aggregate("c", F.lit(0.0), lambda a, x: a + x.getField(k))
    one = one.select("c", summed("raw").alias("n"), summed("tgt").alias("m"))

    def ratio(x: Column, own: int) -> Column:
        # An array of trusted documents is read only where the bucket holds one; greatest() keeps the rest defined.
        p_raw = (x.getField("raw") - 1) / (F.col("n") - 1)
        tgt, m = F.greatest(x.getField("tgt") - own, F.lit(0)), F.greatest(F.col("m") - own, F.lit(0.0))
        return F.when(x.getField("raw") <= 1, F.lit(0.0)).otherwise(F.log((tgt + prior * buckets * p_raw) / ((m + prior * buckets) * p_raw)))

    return one.select(F.struct(F.transform("c", lambda x: ratio(x, 1)).alias("trusted"), F.transform("c", lambda x: ratio(x, 0)).alias("other")).alias("ratios"))


def quality_rules(docs: DataFrame, target_ids: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR, threshold: float = THRESHOLD) -> DataFrame:
    """documents plus the counters, score, base_failed and kept.

    target_ids: column doc_id, the documents of the trusted target.
    """
    out = with_counters(docs)
    mark, ratios = fresh([*out.columns, "base_failed", "score", "kept"], "trusted", "ratios")
    ids = checked_broadcast(target_ids.select("doc_id").dropna().distinct().withColumn("_target", F.lit(True)))
    table = log_ratios(docs.select("doc_id", "text").join(ids, "doc_id", "left"), buckets, prior)

    def mean(r: Column, g: Column) -> Column:
        total = F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(r, b))
        return F.when(F.size(g) == 0, F.lit(0.0)).otherwise(total / F.size(g))

    # One reference to the subquery, bound to a lambda variable: the arrays are shared, not copied into rows.
    side = F.when(F.col(mark), F.col(ratios)["trusted"]).otherwise(F.col(ratios)["other"])
    score = let(side, lambda r: let(words(F.col("text")), lambda w: let(grams(w, buckets), lambda g: mean(r, g))))
    out = out.join(ids.withColumnRenamed("_target", mark), "doc_id", "left").select(*out.columns, mark)
    out = out.withColumn(ratios, table.scalar()).withColumn("score", score).drop(ratios, mark)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
