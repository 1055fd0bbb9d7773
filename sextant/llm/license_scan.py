"""License scans by diagonal voting.

Every rolling k-gram of words of a text is hashed and joined with the k-grams of the templates (a small fixed table).
A hit is checked word by word and votes for its diagonal: (text, template, place in text - place in template).  Votes are
counted per diagonal; each diagonal is merged with its neighbours up to SHIFT words away (words were inserted or dropped,
or others stand in their place), whatever stray hits lie between.  The best of neighbouring merged diagonals is a span.
It is verified by the share of the template's words that its hits cover, and by what tells the template's licence, variant and
version from others: words marked * must be covered, and phrases in brackets must stand in the text word by word.  A span that
lies within another one of its text goes, so that "spdx license identifier mit 0" isn't the MIT licence too.  Those that stay
give their labels.  Base phrases are looked for exactly, all places.

Everything is built-in expressions.  Hits are few, so only they are shuffled; a text is never brought together in one row
of hits, only the diagonals of one text and template are.  Null text is empty: no words, no labels, score 0.  Very long
texts are one row each.  Rows of equal id and text give equal results; a null id is carried along; ties (two spans of one
label) give the label once and the better share.  An empty table gives an empty result.  Other columns aren't read.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.llm.common import let, row_id

#: Words of a gram; words by which merged diagonals may lie from the one in the middle.
K, SHIFT = 3, 8
#: Share of a template's words that gives its label, and words that must be covered in any case, if it has so many.
COVER, LEAST = 0.75, 6
#: Base phrases and labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices and names of well-known licenses, several of one label under label/number.  *: a word that must be
#: covered; brackets: a phrase of three words or more that must stand there whole.
TEMPLATES = {
    "agpl-3.0": "[gnu affero general public license version 3]",
    "agpl-3.0/2": "[gnu affero general public license] as published by the free software foundation [either version 3 of the license] or at your option any later version",
    "apache-2.0": "licensed under the *apache license version *2 0",
    "apache-2.0/2": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-2.0/3": "[apache license version 2 0] january 2004",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd/2": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd/3": "[bsd 2 clause license]",
    "bsd/4": "[bsd 3 clause license]",
    "bsl-1.0": "[boost software license version 1 0]",
    "cc-by-4.0": "this work is licensed under a creative commons [attribution 4 0 international] license",
    "cc-by-nc-4.0": "licensed under [cc by nc 4 0]",
    "cc-by-nc-4.0/2": "this work is licensed under a creative commons [attribution noncommercial 4 0 international] license",
    "cc-by-nc-nd-4.0": "this work is licensed under a creative commons [attribution noncommercial noderivatives 4 0 international] license",
    "cc-by-nc-sa-4.0": "this work is licensed under a creative commons [attribution noncommercial sharealike 4 0 international] license",
    "cc-by-nd-4.0": "this work is licensed under a creative commons [attribution noderivatives 4 0 international] license",
    "cc-by-sa-4.0": "this work is licensed under a creative commons [attribution sharealike 4 0 international] license",
    "cc0-1.0": "[cc0 1 0 universal]",
    "cc0-1.0/2": "has waived all copyright and related or neighboring rights to this work",
    "epl-2.0": "this program and the accompanying materials are made available under the terms of the [eclipse public license 2 0]",
    "gpl-2.0": "[gnu general public license version 2]",
    "gpl-2.0/2": "[gnu general public license] as published by the free software foundation [either version 2 of the license] or at your option any later version",
    "gpl-3.0": "[gnu general public license version 3]",
    "gpl-3.0/2": "[gnu general public license] as published by the free software foundation [either version 3 of the license] or at your option any later version",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "lgpl": "[gnu lesser general public license]",
    "lgpl-2.1": "[gnu lesser general public license version 2 1]",
    "lgpl-2.1/2": "[gnu lesser general public license] as published by the free software foundation [either version 2 1 of the license] or at your option any later version",
    "lgpl-3.0": "[gnu lesser general public license version 3]",
    "lgpl-3.0/2": "[gnu lesser general public license] as published by the free software foundation [either version 3 of the license] or at your option any later version",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit/2": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit/3": "[under the mit license]",
    "mit/4": "[the mit license]",
    "mit/5": "[mit license copyright]",
    "mpl-2.0": "this source code form is subject to the terms of the [mozilla public license v 2 0]",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
}
#: Licences that are named by an identifier line, as its words.
IDENTIFIED = ["agpl 3 0", "apache 2 0", "bsd 2 clause", "bsd 3 clause", "bsl 1 0", "cc by 4 0", "cc by nc 4 0", "cc by nc nd 4 0", "cc by nc sa 4 0", "cc by nd 4 0", "cc by sa 4 0", "cc0 1 0", "epl 2 0", "gpl 2 0", "gpl 3 0", "isc", "lgpl 2 1", "lgpl 3 0", "mit", "mit 0", "mpl 2 0", "unlicense", "zlib"]
_LABELS = {re.sub(r"\W", " ", t.split("/")[0]): t.split("/")[0] for t in TEMPLATES} | {"bsd 2 clause": "bsd", "bsd 3 clause": "bsd", "mit 0": "mit-0"}
TEMPLATES |= {f"{_LABELS[x]}/spdx {x}": f"[spdx license identifier {x}]" for x in IDENTIFIED}
#: The letters that are lower-cased; no others are.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scan_words(text: Column) -> Column:
    """Words with A-Z lower-cased."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), lambda w: w != "")


def parsed(template: str, k: int = K) -> tuple[list[str], list[int], list[int]]:
    """Words, places of words that must be covered, and places of k-grams that must stand in the text."""
    words, covered, grams, open_at = [], [], [], 0
    for w in template.split():
        if w[0] == "[":
            open_at = len(words)
        if w[0] == "*":
            covered.append(len(words))
        words.append(w.strip("[]*"))
        if w[-1] == "]":
            grams += range(open_at, max(open_at, len(words) - k) + 1)
    return words, covered, grams


def template_table(spark: SparkSession, templates: dict[str, str], k: int) -> DataFrame:
    rows = [(label, i, " ".join(w[i : i + k]), len(w)) for label, t in sorted(templates.items()) for w in [parsed(t, k)[0]] for i in range(len(w) - k + 1)]
    return spark.createDataFrame(rows, "tpl string, tpos int, tgram string, twords int").withColumn("h", F.xxhash64(*[F.split("tgram", " ")[i] for i in range(k)]))


def must_table(spark: SparkSession, templates: dict[str, str], k: int) -> DataFrame:
    """tpl, must_words, must_grams."""
    return spark.createDataFrame([(label, *parsed(t, k)[1:]) for label, t in sorted(templates.items())], "tpl string, must_words array<int>, must_grams array<int>")


def base_places(w: Column, phrase: str) -> Column:
    """Starts of a phrase in an array of words; the texts that don't hold it are passed over by a substring test."""
    parts = phrase.split()
    joined = F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    at = lambda i: reduce(lambda a, b: a & b, [F.coalesce(F.get(w, i + j) == p, F.lit(False)) for j, p in enumerate(parts)])
    none = F.array().cast("array<int>")
    return F.when(F.contains(joined, F.lit(f" {phrase} ")), F.filter(F.sequence(F.lit(0), F.size(w) - 1), at)).otherwise(none)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, base: dict[str, str] | None = None, k: int = K, cover: float = COVER, shift: int = SHIFT) -> tuple[DataFrame, DataFrame]:
    """(one row per document, one row per verified span: key, tpl, first, last, votes, covered)."""
    templates, base = templates or TEMPLATES, base or BASE
    spark = docs.sparkSession
    rows = docs.select("doc_id", row_id("doc_id", "text").alias("key"), "text")

    def counted(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), *(base_places(w, p).alias(label) for p, label in sorted(base.items())))

    per = rows.select("doc_id", "key", let(scan_words(F.col("text")), counted).alias("b"))
    places = F.concat(*(F.col("b").getField(v) for v in base.values()))
    found = F.array_sort(F.filter(F.array(*(F.when(F.size(F.col("b").getField(v)) > 0, F.lit(v)) for v in base.values())), lambda x: x.isNotNull()))
    per = per.select("doc_id", "key", F.col("b.n_words").alias("n_words"), F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"), found.alias("base"))

    grams = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.struct(F.xxhash64(*(F.get(w, i + j) for j in range(k))).alias("h"), F.array_join(F.slice(w, i + 1, F.lit(k)), " ").alias("gram")))
    some = F.filter(F.array(scan_words(F.col("text"))), lambda w: F.size(w) >= k)
    table = F.broadcast(template_table(spark, templates, k))  # as long as the templates
    hits = rows.select("key", F.posexplode(F.flatten(F.transform(some, grams))).alias("pos", "g")).join(table, F.col("g.h") == F.col("h"))
    hits = hits.where(F.col("g.gram") == F.col("tgram")).select("key", "tpl", "twords", "tpos", "pos", (F.col("pos") - F.col("tpos")).alias("diag"))
    # On one diagonal the place in the text tells that in the template: it holds a template once at most.
    votes = hits.distinct().groupBy("key", "tpl", "twords", "diag").agg(F.count("*").alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set("tpos").alias("t"))
    # Each diagonal with its neighbours; a span is where no neighbour's share is better.
    near = Window.partitionBy("key", "tpl").orderBy("diag").rangeBetween(-shift, shift)
    every = F.array_distinct(F.flatten(F.collect_list("t").over(near)))
    merged = votes.select("key", "tpl", "twords", "diag", F.sum("votes").over(near).alias("votes"), F.min("first").over(near).alias("first"), (F.max("last").over(near) + k - 1).alias("last"), every.alias("grams"))
    merged = merged.withColumn("words", F.array_distinct(F.flatten(F.transform("grams", lambda t: F.sequence(t, t + k - 1))))).withColumn("covered", F.size("words") / F.col("twords"))
    strength = F.struct("covered", "votes", -F.col("diag"))
    spans = merged.withColumn("best", F.max(strength).over(near) == strength).where("best")
    spans = spans.where(F.col("covered") * F.col("twords") > F.least("twords", F.lit(LEAST)) - 0.5).where(F.col("covered") >= cover)
    spans = spans.join(F.broadcast(must_table(spark, templates, k)), "tpl").where("size(array_except(must_words, words)) = 0 and size(array_except(must_grams, grams)) = 0")
    # Within another span of the text: one that begins no later and ends no earlier, the one of more words if they are equal.
    order = Window.partitionBy("key").orderBy("first", F.desc("last"), F.desc(F.size("words")), "tpl")
    outer = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("outer", outer).where("`outer` is null or `outer` < last")
    return per, spans.select("key", F.split("tpl", "/")[0].alias("tpl"), "first", "last", "votes", "covered")


def license_scan(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: a row per row of docs."""
    per, spans = scan(docs, **options)
    best = spans.groupBy("key").agg(F.collect_set("tpl").alias("tpl"), F.max("covered").alias("covered"))
    out = per.join(best, "key", "left")
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("tpl", F.array().cast("array<string>")))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("covered", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
