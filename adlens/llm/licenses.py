"""License scans by an exact set-similarity join of text blocks with notice templates, in DataFrame functions only.

A block is a line of a text; a template is a sentence of a public license or of the usual notice for it, as a set of
words.  A block holds a template if it has at least ``CONTAINMENT_PERCENT`` of the template's distinct words.

1. Only words of templates can match, so a block is reduced to them; blocks with fewer than any template needs go
   at once (length filter).
2. The words are numbered by their frequency over all remaining blocks, the rarest first, and every set is ordered so.
3. Prefix filter: a template of m words that needs a of them shares one of its first m - a + 1 words with one of the
   first b - a + 1 words of any block of b words that holds it.  Blocks and templates meet on those words alone.
4. Positional filter: from the word they meet on, what is left of either must suffice for the a common words.
5. The remaining pairs are confirmed on the full sets.

The words of all templates are a fixed list (``TEMPLATES``), so what is broadcast or collected has that size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens.llm.common import land

CONTAINMENT_PERCENT = 80

# Phrases of the base figures.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

# Label and sentence, from the public texts of the licenses and their usual notices.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
            " documentation files to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general"
            " public license as published by the free software foundation"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that"
            " the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby"
            " granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The same words before A-Z are lower-cased.
_ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def needed(n_words: int, percent: int = CONTAINMENT_PERCENT) -> int:
    """How many of a template's distinct words a block must have."""
    return max(1, -(-n_words * percent // 100))


def _lowered(text: str = "text") -> Column:
    return F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), _UPPER, _LOWER)


def _starts(words: Column, phrase: str) -> Column:
    """Positions of ``words`` at which the words of ``phrase`` follow each other."""
    parts = phrase.split(" ")

    def here(i: Column) -> Column:
        out = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            out = out & (F.get(words, i + k) == part)
        return out

    return F.when(F.size(words) > 0, F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)).otherwise(F.array().cast("array<int>"))


def phrase_figures(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_words, n_base, first_word, last_word and base (sorted labels) of every row."""
    held = F.when(F.lower("text").rlike("|".join({p.rsplit(" ", 1)[1] for _, p in PHRASES})),
                  F.regexp_extract_all(_lowered(), F.lit(WORD), F.lit(0))).otherwise(F.array().cast("array<string>"))
    # The words are bound to a variable, so they are cut once and not for each position.
    found = F.transform(F.array(held), lambda words: F.array(*[_starts(words, p) for _, p in PHRASES]))[0]
    places = F.flatten("_found")
    labels = [F.when(F.size(F.col("_found")[i]) > 0, F.lit(label)) for i, (label, _) in enumerate(PHRASES)]
    return docs.select(
        F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("text_hash"),
        F.coalesce(F.regexp_count("text", F.lit(_ANY_CASE_WORD)), F.lit(0)).cast("bigint").alias("n_words"),
        found.alias("_found")).select(
            "doc_id", "text_hash", "n_words", F.size(places).cast("bigint").alias("n_base"),
            F.array_min(places).cast("bigint").alias("first_word"), F.array_max(places).cast("bigint").alias("last_word"),
            F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("base"))


def template_blocks(docs: DataFrame, templates=TEMPLATES, percent: int = CONTAINMENT_PERCENT) -> DataFrame:
    """doc_id, text_hash, line (from 0), template (its number), label, overlap, n_template of every block that holds a
    template; rows equal in doc_id and text give their blocks once.

    Null and empty texts have no block; a null doc_id stays null; a line of any length is one block; ties in frequency
    are ordered by the word; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    sets = [sorted(set(text.split(" "))) for _, text in templates]
    vocabulary = sorted(set().union(*sets))
    least = min(needed(len(s), percent) for s in sets)
    lines = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("text_hash"), F.posexplode(F.split(_lowered(), "\n", -1)).alias("line", "block"))
    words = F.filter(F.array_distinct(F.split("block", _BETWEEN, -1)), lambda w: w.isin(vocabulary))
    # Counted first, so that the filter does not cut the words a second time.
    reduced = lines.select("doc_id", "text_hash", "line", F.explode(F.array(words)).alias("words")).where(F.size("words") >= least)
    blocks = land(reduced.distinct(), "blocks")
    # One row per word of the templates.
    frequency = {r["w"]: r["c"] for r in blocks.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("c")).collect()}
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
    numbers = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    ordered = blocks.withColumn("ids", F.array_sort(F.transform("words", lambda w: numbers[w]))).withColumn("b", F.size("ids"))
    rows = []
    for t, ((label, _), words_of) in enumerate(zip(templates, sets)):
        ids, need = sorted(order[w] for w in words_of), needed(len(words_of), percent)
        rows += [(t, label, ids, len(ids), need, i, ids[i]) for i in range(len(ids) - need + 1)]
    prefixes = spark.createDataFrame(rows, "template int, label string, t_ids array<int>, m int, need int, i int, word int")
    probes = ordered.select("doc_id", "text_hash", "line", "ids", "b", F.posexplode(F.slice("ids", F.lit(1), F.col("b") - (least - 1))).alias("j", "word"))
    met = probes.join(F.broadcast(prefixes), "word").where(
        (F.col("b") >= F.col("need")) & (F.col("j") <= F.col("b") - F.col("need"))
        & (F.least(F.col("m") - F.col("i"), F.col("b") - F.col("j")) >= F.col("need")))
    overlap = F.size(F.array_intersect("ids", "t_ids"))
    return met.withColumn("overlap", overlap).where(F.col("overlap") >= F.col("need")) \
        .select("doc_id", "text_hash", "line", "template", "label", "overlap", F.col("m").alias("n_template")).distinct()


def scan_licenses(docs: DataFrame, templates=TEMPLATES, percent: int = CONTAINMENT_PERCENT) -> DataFrame:
    """One row per row of ``docs`` (columns doc_id, text; others are ignored): doc_id, n_words, n_base, first_word,
    last_word, base_labels, labels, score (the largest share of a template that a block holds; 0 without such a block)
    and n_blocks (blocks that hold a template).

    Null and empty texts have no word and no label; a null doc_id stays null; repeated rows are each returned; texts and
    lines may be of any length; an empty table gives an empty one.
    """
    found = template_blocks(docs, templates, percent).groupBy("doc_id", "text_hash").agg(
        F.collect_set("label").alias("_labels"), F.max(F.col("overlap") / F.col("n_template")).alias("_score"),
        F.count_distinct("line").alias("_blocks"))
    found = found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_labels", "_score", "_blocks")
    base = phrase_figures(docs)
    joined = base.join(found, base["doc_id"].eqNullSafe(found["_id"]) & (base["text_hash"] == found["_hash"]), "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("_labels", F.array().cast("array<string>"))))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
                         F.array_join(labels, ",").alias("labels"), F.coalesce("_score", F.lit(0.0)).alias("score"),
                         F.coalesce("_blocks", F.lit(0)).cast("bigint").alias("n_blocks"))
