"""License scans by an exact set-similarity join (operator 3).

A text block is a run of ``BLOCK`` words, starting every ``STEP`` words of the whole text. Templates of
more than ``STEP`` words have blocks of their own, twice as long until the step holds the template, so a
template of any length lies whole in some block; there is one pass per block length. The join finds every (block, template) whose containment |T ∩ B| / |T| reaches ``threshold``:

* the words of all templates are ordered by their frequency over the whole corpus, rarest first;
* a block that reaches the threshold holds one of the first |T| - need + 1 words of the template
  (prefix filter), so only these are joined, word by word, with the words of all texts;
* a block with fewer template words than needed is left out (length filter);
* from the places of the joined word in both orders follows how much overlap is still possible
  (positional filter);
* what is left is counted exactly.

The side that is broadcast holds one row per prefix word of the fixed templates, whatever the
corpus. Base phrases are consecutive words and are found apart from blocks. Only DataFrame
functions run.

Results: null text counts as empty: no words, no places, labels empty strings, score 0. Rows are
matched by doc_id and text, so rows that share an id keep their own labels. The score is the
largest containment that reached the threshold, 1 where a base phrase stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.session import union_all

#: Words from block to block for short templates; a block is two steps long.
STEP = 32
BLOCK = 2 * STEP
THRESHOLD = 0.8

# Base phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Label and words of public licence notices.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "all rights reserved"),
]


def word_text(text: Column) -> Column:
    """The words of a text in lower case, one space between them, none around.

    ``lower`` also changes letters outside ASCII, which are word characters before and after; the
    two that would become ASCII letters are exchanged for another word character first.
    """
    kept = F.translate(F.coalesce(text, F.lit("")), "\u0130\u212a", "\u00e9\u00e9")
    return F.trim(F.regexp_replace(F.lower(kept), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " "))


def step_of(text: str) -> int:
    """Words from block to block for a template: the smallest doubling of ``STEP`` that holds it."""
    step = STEP
    while step < len(text.split(" ")):
        step *= 2
    return step


def template_rows(spark: SparkSession, templates: dict[int, tuple[str, str]], threshold: float) -> DataFrame:
    """(template, label, token, need, size), one row per distinct word of a numbered template."""
    rows = []
    for number, (label, text) in templates.items():
        words = sorted(set(text.split(" ")))
        need = next(k for k in range(1, len(words) + 1) if k >= threshold * len(words) - 1e-9)
        rows += [F.struct(F.lit(number).alias("template"), F.lit(label).alias("label"), F.lit(w).alias("token"), F.lit(need).alias("need"), F.lit(len(words)).alias("size")) for w in words]
    return spark.range(1).select(F.inline(F.array(*rows)))


def prefix_index(words: DataFrame, templates: DataFrame) -> DataFrame:
    """(token, template, label, need, size, place, tokens, ordered): the prefix words of every
    template in global frequency order; ``words`` has a column ``word`` of all words of the corpus."""
    vocabulary = templates.select("token").distinct()
    frequency = words.join(F.broadcast(vocabulary), F.col("word") == F.col("token"), "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counted = templates.join(frequency, F.col("token") == F.col("word"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # From here on one row per word of a template.
    place = F.row_number().over(Window.partitionBy("template").orderBy("n", "token")) - 1
    everything = F.sort_array(F.collect_set(F.struct("n", "token")).over(Window.partitionBy()))
    tokens = F.collect_list("token").over(Window.partitionBy("template"))
    placed = counted.withColumns({"place": place, "tokens": tokens, "ordered": F.transform(everything, lambda x: x["token"])})
    return placed.filter(F.col("place") <= F.col("size") - F.col("need")).drop("word", "n")


def matching_blocks(texts: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(key, block, template, label, containment) of every text block that reaches the threshold;
    ``texts`` has the columns key and words (an array). ``block`` counts the steps of its template's
    block length. Rows may repeat."""
    by_step: dict[int, dict[int, tuple[str, str]]] = {}
    for number, template in enumerate(templates):
        by_step.setdefault(step_of(template[1]), {})[number] = template
    return union_all([_matching(texts, chosen, step, threshold) for step, chosen in sorted(by_step.items())])


def _matching(texts: DataFrame, templates: dict[int, tuple[str, str]], step: int, threshold: float) -> DataFrame:
    """``matching_blocks`` of the templates that share a block length of two steps."""
    index = prefix_index(texts.select(F.explode("words").alias("word")), template_rows(texts.sparkSession, templates, threshold))
    placed = texts.select("key", "words", F.posexplode("words").alias("at", "word"))
    hits = placed.join(F.broadcast(index), F.col("word") == F.col("token"))
    last = F.floor(F.col("at") / step)
    blocks = F.when(last > 0, F.array(last, last - 1)).otherwise(F.array(last))
    inside = hits.select(
        "key", "token", "template", "label", "need", "size", "place", "tokens", "ordered", F.explode(blocks).alias("block"), "words"
    ).withColumn("held", F.slice("words", F.col("block").cast("int") * step + 1, 2 * step)).drop("words")
    known = inside.withColumn("known", F.array_intersect("ordered", "held")).filter(F.size("known") >= F.col("need"))
    later = F.least(F.col("size") - F.col("place") - 1, F.size("known") - F.array_position("known", F.col("token")))
    overlap = F.size(F.array_intersect("tokens", "held"))
    # The bound holds for the first shared word of a pair, and a pair that qualifies has it in its prefix.
    possible = known.filter(1 + later >= F.col("need")).withColumn("overlap", overlap).filter(F.col("overlap") >= F.col("need"))
    return possible.select("key", "block", "template", "label", (F.col("overlap") / F.col("size")).alias("containment"))


def phrase_columns(words: Column, n_words: Column, phrases: dict[str, str]) -> dict[str, Column]:
    """n_base, first_word, last_word and the found base labels of a text of spaced words."""
    padded = F.concat(F.lit(" "), words, F.lit(" "))
    spaces = lambda part: F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases.items():
        there = padded.contains(f" {phrase} ")
        before = F.locate(f" {phrase} ", padded)
        behind = F.locate(f" {phrase} "[::-1], F.reverse(padded))
        counts.append(F.when(there, F.regexp_count(padded, F.lit(f"(?<= ){phrase}(?= )"))).otherwise(0))
        firsts.append(F.when(there, spaces(F.substring(padded, F.lit(1), before)) - 1))
        lasts.append(F.when(there, n_words - spaces(F.substring(F.reverse(padded), F.lit(1), behind - 1)) - len(phrase.split(" "))))
        labels.append(F.when(there, F.lit(label)))
    return {
        "n_base": sum(counts[1:], counts[0]).cast("long"),
        "first_word": F.array_min(F.array(*firsts)).cast("long"), "last_word": F.array_max(F.array(*lasts)).cast("long"),
        "base": F.array_distinct(F.array_compact(F.array(*labels))),
    }


def scan(docs: DataFrame, key: str = "doc_id", phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row."""
    row = F.struct(F.col(key).alias("id"), F.xxhash64("text").alias("h")).alias("key")
    spaced = docs.select(row, word_text(F.col("text")).alias("spaced"))
    found = (
        matching_blocks(spaced.select("key", F.split("spaced", " ").alias("words")), templates, threshold)
        .groupBy("key").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
        .select(F.col("key.id").alias("fid"), F.col("key.h").alias("fh"), "found", "best")
    )
    n_words = F.when(F.col("spaced") == "", 0).otherwise(F.length("spaced") - F.length(F.replace("spaced", F.lit(" "), F.lit(""))) + 1).cast("long")
    base = spaced.withColumn("n_words", n_words)
    base = base.withColumns(phrase_columns(F.col("spaced"), F.col("n_words"), phrases)).drop("spaced")
    joined = base.join(found, F.expr("key.id <=> fid and key.h = fh"), "left")
    none = F.expr("cast(array() as array<string>)")
    joined_labels = lambda x: F.array_join(F.array_sort(x), ",")
    return joined.select(
        F.col("key.id").alias(key), "n_words", "n_base", "first_word", "last_word", joined_labels(F.col("base")).alias("base_labels"),
        joined_labels(F.array_union("base", F.coalesce("found", none))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
