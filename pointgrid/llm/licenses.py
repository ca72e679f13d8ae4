"""License notices by diagonal voting.

Templates are short phrases (the base labels) and sentences of well-known notices. All rolling word K-grams of
the corpus are joined with the K-grams of the templates by their hash. A match at word p of a document with word
q of a template votes for the diagonal p - q; every place of a document where a template stands unchanged is one
diagonal with all votes. Diagonals of one template at most ``GAP`` apart are merged, so that a notice with words
added or left out is one span. A span is verified by its words: the hashed words are compared themselves, and a
span of a notice counts if at least ``LEAST`` of the template's words stand in it and it is at most ``LONGEST`` times as
long as the template. A base label needs all votes of its phrase on one diagonal.

Only the (few) matches are shuffled, counted before they are; each document keeps one row besides. The templates'
K-grams are a constant table of some 150 rows.

Defined results: A-Z are lower-cased; words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; a null text is empty. A document
without a match has no labels, null places and score 0. Score is the largest share of a template's words in one span,
1 for a whole phrase. Rows that repeat doc_id and text (null doc_ids too) get one result each. Texts are scanned whole.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointgrid.llm.arrow_text import NO_ID
from pointgrid.stages import cut, measured

K = 3
GAP = 3
LEAST, LONGEST = 0.7, 1.5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Base phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Sentences of well-known notices (at most 63 words each) and their labels.
NOTICES = {
    "all rights reserved": "all-rights-reserved",
    "the gnu general public license": "gpl",
    "licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
    "the software to deal in the software without restriction": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-2",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
}


def with_grams(df: DataFrame, text: str) -> DataFrame:
    """A row for each word of ``text`` (one row if there is none): n_words, at, w0 to w2, and their hash ``gram`` if all are there."""
    keep = [c for c in df.columns if c != text]
    df = df.withColumn("_w", F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)))
    later = [F.slice("_w", i + 1, F.greatest(F.size("_w") - i, F.lit(0))).alias(f"w{i}") for i in range(1, K)]
    df = df.select(*keep, F.size("_w").cast("long").alias("n_words"), F.posexplode_outer(F.arrays_zip(F.col("_w").alias("w0"), *later)).alias("at", "_g"))
    words = [F.col(f"_g.w{i}") for i in range(K)]
    gram = F.when(words[-1].isNotNull(), F.xxhash64(*words))
    return df.select(*keep, "n_words", "at", *(w.alias(f"w{i}") for i, w in enumerate(words)), gram.alias("gram"))


def template_grams(spark: SparkSession, phrases: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """template, label, base, size, place, gram, t0 to t2: K-grams of all templates; a constant table."""
    every = [(t, label, True) for t, label in phrases.items()] + [(t, label, False) for t, label in notices.items()]
    if any(not K <= len(t.split()) <= 63 for t, _, _ in every):
        raise ValueError(f"templates have {K} to 63 words")
    listed = F.array(*(F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(base).alias("base"), F.lit(t).alias("text")) for i, (t, label, base) in enumerate(every)))
    rows = spark.range(1, numPartitions=1).select(F.explode(listed).alias("t")).select("t.*")
    grams = with_grams(rows, "text").where("gram IS NOT NULL")
    return measured(grams.select("template", "label", "base", F.col("n_words").alias("size"), F.col("at").alias("place"), "gram", *(F.col(f"w{i}").alias(f"t{i}") for i in range(K))))


def matches(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """Stored rows (id, key, n_words, at, template, label, base, size, place, copies): every match of a K-gram, and every document's first word.

    ``copies`` is the number of rows of the document; template is null where the first word begins no match.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    grams = template_grams(docs.sparkSession, phrases, notices)
    same = [F.col(f"w{i}") == F.col(f"t{i}") for i in range(K)]
    found = with_grams(base, "text").withColumnRenamed("gram", "_gram")
    found = found.join(grams, [found._gram == grams.gram, *same], "left").where("template IS NOT NULL OR at IS NULL OR at = 0")
    columns = ["id", "key", "n_words", "at", "template", "label", "base", "size", "place"]
    return cut(found.groupBy(*columns).agg(F.count("*").alias("copies")), "matches")


def diagonals(found: DataFrame) -> DataFrame:
    """A row for each document, template and diagonal: votes, the words of the template that stand there (as bits), first and last word."""
    bits = F.expr(f"shiftleft({2**K - 1}L, place)")
    hits = found.where("template IS NOT NULL").withColumn("diagonal", F.col("at") - F.col("place"))
    return hits.groupBy("id", "key", "template", "label", "base", "size", "diagonal").agg(
        F.count("*").alias("votes"), F.bit_or(bits).alias("words"), F.min("at").alias("first"), F.max(F.col("at") + K).alias("end")
    )


def spans(diagonal: DataFrame) -> DataFrame:
    """id, key, template, label, first, end, share, verified (of a notice): diagonals and merged diagonals, with the share of the template's words found."""
    by = ["id", "key", "template", "label", "base", "size"]
    order = W.partitionBy("id", "key", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > GAP, F.lit(True))
    merged = diagonal.withColumn("_new", apart.cast("int")).withColumn("_run", F.sum("_new").over(order))
    merged = merged.groupBy(*by, "_run").agg(F.bit_or("words").alias("words"), F.min("first").alias("first"), F.max("end").alias("end")).drop("_run")
    every = diagonal.select(merged.columns).unionByName(merged)
    share = F.bit_count("words") / F.col("size")
    fits = ~F.col("base") & (share >= LEAST) & (F.col("end") - F.col("first") <= LONGEST * F.col("size"))
    return every.select("id", "key", "template", "label", "first", "end", share.alias("share"), fits.alias("verified")).distinct()


def scanned(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document."""
    found = matches(docs, phrases, notices)
    diagonal = cut(diagonals(found), "diagonals")
    whole = diagonal.where(f"base AND votes = size - {K - 1}")
    none = lambda kind: F.lit(None).cast(kind)
    rows = (
        found.where("coalesce(at, 0) = 0").select("id", "key", "n_words", "copies", none("long").alias("place"), none("string").alias("base_label"), none("string").alias("label"), none("double").alias("share"))
        .unionAll(whole.select("id", "key", none("long"), none("long"), F.col("first").cast("long"), "label", "label", F.lit(1.0)))
        .unionAll(spans(diagonal).select("id", "key", none("long"), none("long"), none("long"), none("string"), F.when(F.col("verified"), F.col("label")), "share"))
    )
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    each = rows.groupBy("id", "key").agg(
        F.max("n_words").alias("n_words"), F.max("copies").alias("copies"), F.count("place").alias("n_base"), F.min("place").alias("first_word"), F.max("place").alias("last_word"),
        listed("base_label").alias("base_labels"), listed("label").alias("labels"), F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    )
    doc_id = F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id")
    each = each.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return each.select(doc_id, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
