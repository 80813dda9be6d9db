"""License texts by diagonal voting.

The hashes of all runs of three words of a text are joined with those of the templates. A hit at word p of a
text and word q of a template votes for the diagonal p - q: an unchanged copy puts all its votes on one diagonal,
inserted or missing words move the rest to a neighbouring one. Votes are added up by diagonal, neighbouring
diagonals of a template are merged, and the span is verified by the share of the template that it covers. A
template marked as exact counts only where one diagonal has all its words.

Edge cases: a null text counts as empty; a text without words has no place and no label, n_words 0 and score 0.0.
Rows that agree in id and text share their votes, which are distinct places, and get equal rows. Null ids are kept.
An empty table gives no rows; other columns are not looked at. The templates are a fixed list of a few hundred words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docvec.llm.common import whole

GRAM = 3
SLACK = 3  # diagonals up to so far apart are one copy
COVERED = 0.6  # of a template's runs of words, where it isn't exact
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases to be found word by word, with their labels.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
# What the notices of well-known licenses say, with their labels.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction including without limitation the "
            "rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3", "gnu general public license version 3"),
    ("gpl-2", "gnu general public license version 2"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl-3", "gnu affero general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-nd", "cc by nd"),
    ("cc-by", "creative commons attribution license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("all-rights", "all rights reserved"),
]


def words(text: Column) -> Column:
    """Runs of digits, letters a-z and characters beyond ASCII, after lower-casing A-Z."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def grams(w: Column) -> Column:
    """Hash and text of the three words from each place on that has three; no word holds a blank."""
    places = F.when(F.size(w) >= GRAM, F.sequence(F.lit(1), F.size(w) - (GRAM - 1))).otherwise(F.array().cast("array<int>"))

    def gram(i: Column) -> Column:
        three = [F.element_at(w, i + k) for k in range(GRAM)]
        return F.struct(F.xxhash64(*three).alias("hash"), F.concat_ws(" ", *three).alias("gram"))

    return F.transform(places, gram)


def template_grams(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """template, label, exact, size (its runs of three words), q, hash and gram of each of them."""
    rows = [F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(exact).alias("exact"), F.lit(text).alias("text"))
            for i, (label, text, exact) in enumerate([*((*p, True) for p in phrases), *((*n, False) for n in notices)])]
    t = spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.*").withColumn("w", words(F.col("text")))
    placed = t.select("template", "label", "exact", (F.size("w") - (GRAM - 1)).alias("size"), F.posexplode(grams(F.col("w"))).alias("q", "g"))
    return placed.select("template", "label", "exact", "size", "q", "g.hash", "g.gram")


def license_places(docs: DataFrame, templates: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verified copies: doc_id, text_hash, label, exact, start (word where the template begins), covered (0 to 1).

    A row of a run of words carries these words only, so that the time follows a text's length. The fixed templates go to
    all tasks; those of a caller, of any number, meet the runs as Spark sees fit.
    """
    templates = F.broadcast(template_grams(docs.sparkSession)) if templates is None else templates
    w = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(whole(text_col)).alias("text_hash"), words(whole(text_col)).alias("w"))
    runs = w.select("doc_id", "text_hash", F.posexplode(grams(F.col("w"))).alias("p", "g")).select("doc_id", "text_hash", "p", "g.hash", "g.gram")
    hits = runs.join(templates, ["hash", "gram"])
    copy = ["doc_id", "text_hash", "template", "label", "exact", "size"]
    diagonals = hits.groupBy(*copy, (F.col("p") - F.col("q")).alias("diagonal")).agg(F.collect_set("q").alias("votes"))
    by_template = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(by_template)
    begins = F.when(F.col("exact") | step.isNull() | (step > SLACK), 1).otherwise(0)
    merged = (
        diagonals.withColumn("_begins", begins)
        .withColumn("_span", F.sum("_begins").over(by_template.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*copy, "_span")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("votes")))).alias("n"), F.min("diagonal").alias("start"))
    )
    covered = F.col("n") / F.col("size")
    return merged.where((covered >= COVERED) & (~F.col("exact") | (F.col("n") == F.col("size")))).select(
        "doc_id", "text_hash", "label", "exact", F.col("start").cast("long").alias("start"), covered.alias("covered")
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: DataFrame | None = None) -> DataFrame:
    """Per document: words, exact places (number, first, last, labels), all labels, and the best cover as score."""
    places = license_places(docs, templates, id_col, text_col)
    base = F.when(F.col("exact"), F.col("start"))
    joined = lambda label: F.array_join(F.sort_array(F.collect_set(label)), ",")
    found = places.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.count(base).alias("n_base"),
        F.min(base).alias("first_word"),
        F.max(base).alias("last_word"),
        joined(F.when(F.col("exact"), F.col("label"))).alias("base_labels"),
        joined(F.col("label")).alias("labels"),
        F.max("covered").alias("score"),
    )
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.size(words(whole(text_col))).cast("long").alias("n_words"), F.xxhash64(whole(text_col)).alias("text_hash")
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    return rows.join(found, same, "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
