"""License notices in texts, found by diagonal voting over word pairs.

Hashes of all rolling pairs of words are joined to the places of the same pairs in the templates. A
hit votes for the diagonal "place in the text minus place in the template"; a notice that stands
word by word puts all its votes on one diagonal, and one with a few words more or less puts them on
neighbouring diagonals, which are merged before the span is verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snapforge.llm.common import LOWER, UPPER
from snapforge.session import keep, local_frame

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SLACK = 3  # diagonals this near belong together
LEAST = 0.85  # share of a template's pairs that a span must hold

# Phrases that give a label wherever their words stand one after the other.
BASE = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
# The notices and what they are called. At most 60 words each.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache",
    "unless required by applicable law or agreed to in writing software distributed under the license": "apache",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "this program is free software you can redistribute it and or modify it": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "licensed under cc by 4 0": "cc-by",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "creative commons attribution noncommercial": "cc-by-nc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
}


def words(text: Column) -> Column:
    """Words of a text after A-Z has been lower-cased; none for null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(lowered, F.lit(WORDS), F.lit(0))


def template_pairs(spark: SparkSession, base: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """One row per template and place of a pair; a few hundred rows, whatever the corpus."""
    rows = []
    for number, (phrase, label) in enumerate([*base.items(), *notices.items()]):
        w = phrase.split()
        if not 2 <= len(w) <= 60:
            raise ValueError(f"a template has 2 to 60 words: {phrase}")
        rows += [(number, number < len(base), label, len(w) - 1, i, a, b) for i, (a, b) in enumerate(zip(w, w[1:]))]
    return local_frame(spark, rows, "template int, is_base boolean, label string, pairs int, at int, w1 string, w2 string")


def scan(
    docs: DataFrame, base: dict[str, str] | None = None, notices: dict[str, str] | None = None, slack: int = SLACK, least: float = LEAST
) -> DataFrame:
    """Verified spans: ``key``, ``template``, ``label``, ``is_base``, ``first_word``, ``last_word``, ``coverage``.

    ``docs`` has text and the column key, which names a document (rows of one key have one text and
    count once). A base phrase must stand whole on one diagonal. A notice is a merged group of
    diagonals that holds at least ``least`` of its pairs. No word, or no hit: no row.
    """
    templates = template_pairs(docs.sparkSession, BASE if base is None else base, NOTICES if notices is None else notices)
    hashed = templates.withColumn("hash", F.xxhash64("w1", "w2"))
    w = docs.select("key", words(F.col("text")).alias("w"))
    pairs = F.zip_with(F.col("w"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rolled = w.select("key", F.posexplode(pairs).alias("place", "p")).filter("p.b is not null")
    rolled = rolled.select("key", "place", F.col("p.a").alias("a"), F.col("p.b").alias("b"), F.xxhash64("p.a", "p.b").alias("hash"))
    # The templates are the fixed side: a few hundred rows.
    hits = rolled.join(F.broadcast(hashed), "hash").filter("a = w1 and b = w2")
    votes = (
        hits.groupBy("key", "template", "is_base", "label", "pairs", (F.col("place") - F.col("at")).alias("diagonal"))
        .agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("seen"), F.min("place").alias("lo"), F.max("place").alias("hi"))
    )
    votes = keep(votes, "votes")
    whole = votes.filter("is_base and bit_count(seen) = pairs").select(
        "key", "template", "label", "is_base", F.col("diagonal").cast("long").alias("first_word"),
        (F.col("diagonal") + F.col("pairs")).cast("long").alias("last_word"), F.lit(1.0).alias("coverage"),
    )
    by = Window.partitionBy("key", "template").orderBy("diagonal")
    fresh = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > slack).cast("int"), F.lit(1))
    merged = (
        votes.filter("not is_base").withColumn("fresh", fresh).withColumn("part", F.sum("fresh").over(by))
        .groupBy("key", "template", "label", "is_base", "pairs", "part")
        .agg(F.bit_or("seen").alias("seen"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .withColumn("coverage", F.bit_count("seen") / F.col("pairs"))
        .filter(F.col("coverage") >= least)
    )
    loose = merged.select("key", "template", "label", "is_base", F.col("lo").cast("long").alias("first_word"), (F.col("hi") + 1).cast("long").alias("last_word"), "coverage")
    return whole.unionByName(loose)


def license_report(docs: DataFrame, **options) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``.

    One row per row of ``docs``, also without any find: counts 0, places null, labels empty. first_word
    and last_word are the smallest and largest start of base places. score is the highest share of a
    notice's pairs that a span holds, 1 with a base place. A null text has no words; rows that repeat
    an id and a text get the same values. Other columns are not read.
    """
    keyed = docs.select("doc_id", "text", F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64("text", F.lit(1), "doc_id").alias("b")).alias("key"))
    spans = scan(keyed.select("key", "text"), **options)
    found = spans.groupBy("key").agg(
        F.count(F.when(F.col("is_base"), 1)).alias("n_base"),
        F.min(F.when(F.col("is_base"), F.col("first_word"))).alias("first_word"),
        F.max(F.when(F.col("is_base"), F.col("first_word"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("is_base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("coverage").alias("score"),
    )
    lowered = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    counted = keyed.select("doc_id", "key", F.regexp_count(lowered, F.lit(WORDS)).cast("long").alias("n_words"))
    return counted.join(found, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
