"""License scans: phrases, and an exact containment join with license templates.

A text's words are cut into blocks of BLOCK words, a new one every half block.
A template is contained in a block when the block has at least THRESHOLD percent
of the template's distinct words. The join orders all template words globally,
words of few documents first. With `need` the least overlap, a template of
`size` words and a block of `n` template words can only meet it if their first
common word is among the first size - need + 1 of the template (prefix) and the
first n - need + 1 of the block, if n >= need (length), and if the words common
so far and the fewer of those still to come reach it (position). What is left
is verified. Everything is DataFrame expressions.

Texts are cut into words once, by splitting: Spark's extraction of all matches
makes an object for each word and takes several times as long. The same pass
keeps which template words a text holds; only texts that hold enough words of
one template keep their own words, for the join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelio.functions.nulls import broadcast_if_small
from parcelio.llm.shared import written

#: What lies between words, once A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK = 64
#: Percent of a template's distinct words.
THRESHOLD = 80
#: Rows of a lookup table that every task may get.
SMALL = 100_000

# Phrases whose places are counted, with their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Sentences by which public licenses are named or granted, with their labels.
TEMPLATES = (
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "mit"),
    ("Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License", "apache-2"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gpl"),
    ("This work is licensed under the GNU General Public License, version 3", "gpl"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "lgpl"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl-2"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License", "epl"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "creative-commons"),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
    ("Distributed under the Boost Software License, Version 1.0", "boost"),
)


def words_of(text: Column) -> Column:
    """The words of a text (null: none). Only A-Z may become another word's letters, so the Kelvin sign is set aside."""
    plain = F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("K"), F.lit("ĸ"))
    return F.array_remove(F.split(F.lower(plain), GAP), "")


def _literal(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def _word_index(joined: Column, place: Column) -> Column:
    before = F.substring(joined, F.lit(1), place)
    return (F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit(""))) - 1).cast("long")


def phrase_places(joined: Column, phrase: str) -> tuple[Column, Column, Column]:
    """Number of places, first and last word index of a phrase, in words with a space around each; null indexes if none."""
    padded = f" {phrase} "
    here = F.contains(joined, F.lit(padded))
    back = F.instr(F.reverse(joined), padded[::-1])
    count = F.when(here, F.regexp_count(joined, F.lit(f" {phrase}(?= )"))).otherwise(0).cast("long")
    first = F.when(here, _word_index(joined, F.instr(joined, padded)))
    last = F.when(here, _word_index(joined, F.length(joined) - back - len(padded) + 2))
    return count, first, last


def _scanned(docs: DataFrame, templates: DataFrame, phrases: Sequence[tuple[str, str]]) -> DataFrame:
    """A row per document, from one pass over the texts.

    `doc_id`, `mark` (the MD5 of the text), `n_words`, the phrases' places and
    labels, `held` (the distinct template words of the text), and `words` of the
    texts that hold enough words of some template, else null.
    """
    rows = templates.select("tokens", "need").collect()
    universe = sorted({w for r in rows for w in r["tokens"]})
    enough = F.lit(False)
    for r in rows:
        enough = enough | (F.size(F.array_intersect("held", _literal(r["tokens"]))) >= r["need"])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text.cast("binary")).alias("mark"), words_of(F.col("text")).alias("words"))
    rows = rows.select(
        "doc_id", "mark", "words", F.size("words").cast("long").alias("n_words"),
        F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("joined"), F.array_intersect("words", _literal(universe)).alias("held"),
    )
    places = [phrase_places(F.col("joined"), phrase) for phrase, _ in phrases]
    rows = rows.select(
        "doc_id", "mark", "n_words", "held", F.when(enough, F.col("words")).alias("words"),
        *[c.alias(f"{kind}{k}") for k, three in enumerate(places) for kind, c in zip(("count", "first", "last"), three)],
    )
    found = F.array(*[F.when(F.col(f"count{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(phrases)])
    return rows.select(
        "doc_id",
        "mark",
        "n_words",
        "held",
        "words",
        sum((F.col(f"count{k}") for k in range(1, len(phrases))), F.col("count0")).alias("n_base"),
        F.array_min(F.array(*[F.col(f"first{k}") for k in range(len(phrases))])).alias("first_word"),
        F.array_max(F.array(*[F.col(f"last{k}") for k in range(len(phrases))])).alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(found))).alias("base"),
    )


def template_sets(spark: SparkSession, templates: Sequence[tuple[str, str]]) -> DataFrame:
    """`template`, `label`, `tokens` (the distinct words), `size`, `need`.

    Templates must not be longer than half a block, so that a whole notice is
    always inside one.
    """
    rows = spark.createDataFrame([(k, label, text) for k, (text, label) in enumerate(templates)], "template int, label string, text string")
    rows = rows.select("template", "label", words_of(F.col("text")).alias("words"))
    if rows.filter(F.size("words") > BLOCK // 2).limit(1).count():
        raise ValueError(f"a template has more than {BLOCK // 2} words")
    sets = rows.select("template", "label", F.array_distinct("words").alias("tokens"))
    sets = sets.withColumn("size", F.size("tokens")).filter("size > 0")
    return sets.withColumn("need", F.floor((F.col("size") * THRESHOLD + 99) / 100).cast("int"))


def in_order(sets: DataFrame, scanned: DataFrame) -> tuple[DataFrame, list[str]]:
    """The templates with their words in global order, and that order: by documents that hold the word, then by the word."""
    universe = {w for r in sets.select("tokens").collect() for w in r["tokens"]}
    held = scanned.select(F.explode("held").alias("token"))
    many = {r["token"]: r["count"] for r in held.groupBy("token").count().collect()}
    order = sorted(universe, key=lambda w: (many.get(w, 0), w))
    return sets.withColumn("tokens", F.array_intersect(_literal(order), F.col("tokens"))), order


def blocks_of(words: Column) -> Column:
    """The blocks of a text's words; a last one that lies inside the one before is left out."""
    half = BLOCK // 2
    last = F.greatest(F.ceil(F.size(words) / half).cast("int") - 2, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(words, k * half + 1, F.lit(BLOCK)))


def containments(scanned: DataFrame, sets: DataFrame) -> DataFrame:
    """`mark`, `block`, `template`, `label`, `overlap`, `size`: every block of a text that contains a template.

    `mark` is the MD5 of the text, so equal texts share their rows.
    """
    sets, order = in_order(sets, scanned)
    ranked = _literal(order)
    prefix = sets.select("template", "size", "need", F.posexplode("tokens").alias("p", "token")).filter("p <= size - need")
    rows = scanned.filter("words IS NOT NULL").select("mark", "words")
    blocks = rows.select("mark", F.posexplode(blocks_of(F.col("words"))).alias("block", "words"))
    blocks = blocks.select("mark", "block", F.array_intersect(ranked, F.col("words")).alias("held")).withColumn("n", F.size("held")).filter("n > 0")
    tokens = blocks.select("mark", "block", "n", "held", F.posexplode("held").alias("q", "token"))
    met = tokens.join(broadcast_if_small(prefix, SMALL), "token").filter("n >= need AND q <= n - need")
    # Equal texts bring the same words again, so the common ones are a set of bits.
    met = met.groupBy("mark", "block", "template").agg(
        F.bit_or(F.expr("shiftleft(1L, p)")).alias("common"),
        F.max("p").alias("p"),
        F.max("q").alias("q"),
        F.first("n").alias("n"),
        F.first("size").alias("size"),
        F.first("need").alias("need"),
        F.first("held").alias("held"),
    )
    met = met.filter("bit_count(common) + least(size - p - 1, n - q - 1) >= need")
    sure = met.join(broadcast_if_small(sets.select("template", "label", "tokens"), SMALL), "template")
    sure = sure.withColumn("overlap", F.size(F.array_intersect("tokens", "held"))).filter("overlap >= need")
    return sure.select("mark", "block", "template", "label", "overlap", "size")


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES) -> DataFrame:
    """One row per document: `doc_id`, `n_words`, `n_base`, `first_word`, `last_word`, `base_labels`, `labels`, `score`.

    `n_base` counts the places of all phrases, `first_word` and `last_word` are
    the first and the last of them (words from 0; null without any),
    `base_labels` their labels. `labels` adds those of the templates that a block
    of the text contains. `score` is 1 with a phrase, else the largest share of a
    contained template's words, else 0. Labels are distinct, sorted and joined
    by commas. Null texts are empty: no words, no labels, score 0. Repeated rows
    get a row each; texts may be of any length; an empty table gives no rows;
    other columns are ignored.
    """
    sets = template_sets(docs.sparkSession, templates)
    scanned = written(_scanned(docs, sets, phrases), "scanned")
    hits = containments(scanned, sets).groupBy("mark").agg(F.collect_set("label").alias("more"), F.max(F.col("overlap") / F.col("size")).alias("share"))
    hits = written(hits, "licenses")
    rows = scanned.drop("held", "words").join(broadcast_if_small(hits, SMALL), "mark", "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0)))
    return rows.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.round(score, 6).alias("score"),
    )
