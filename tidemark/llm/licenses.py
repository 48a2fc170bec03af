"""License scan: base phrases, and templates found by an exact set-similarity join.

A text block meets a template if it holds at least a threshold share of the template's distinct
words (containment). Blocks are lines and, for notices that are wrapped over lines, runs of the
text's words that are at most a quarter longer than the template; overlapping windows hold every
such run. Words are put in one global order, rarest in the corpus first:

* prefix filter: a block that meets a template of t words with `need` of them shares one of the
  template's t - need + 1 rarest words, so only these are indexed;
* length filter: the block must have at least `need` words that any template has;
* positional filter: the places of the shared word in both ordered sets bound the overlap.

Candidates are then counted exactly. Templates are a parameter, so their index is small by
construction; blocks, of any number, never meet each other.

Edge cases: null text counts as empty; repeated rows each give a row; an empty table gives an
empty table; without templates only base phrases label; other columns are not read.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.shared import materialise

# Base phrases and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices of common licenses (label, text).
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http www apache org licenses LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]
THRESHOLD = 0.85
#: Words of a run per word of the template, for notices over several lines.
SLACK = 1.25

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case. Two other letters have lower-case forms with ASCII in them; only
    texts that hold one of these take the slower way."""
    odd = F.contains(text, F.lit("K")) | F.contains(text, F.lit("İ"))
    return F.when(odd, F.translate(text, _UPPER, _UPPER.lower())).otherwise(F.lower(text))


def words_of(text: Column) -> Column:
    """Words of lower-cased text: runs of a-z, 0-9 and characters beyond ASCII."""
    return F.array_remove(F.split(text, SEPARATORS), "")


def template_words(text: str) -> list[str]:
    return sorted(set(re.findall(r"[0-9a-z]+", text.lower())))


def strings(values: list[str]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<string>")


def ordered_templates(texts: DataFrame, templates: list[tuple[str, str]], threshold: float) -> tuple[list[str], list[dict]]:
    """All template words, rarest in the texts first, and per template its words in that order.

    Frequencies are numbers of texts; they come back as one number per template word.
    """
    every = sorted({word for _, text in templates for word in template_words(text)})
    if not every:
        return [], []
    seen = (
        texts.select(F.explode(F.array_intersect(strings(every), words_of(ascii_lower(F.col("text"))))).alias("word"))
        .groupBy("word")
        .count()
        .collect()
    )
    frequency = {row["word"]: row["count"] for row in seen}
    order = sorted(every, key=lambda word: (frequency.get(word, 0), word))
    place = {word: k for k, word in enumerate(order)}
    sets = []
    for label, text in templates:
        words = sorted(template_words(text), key=place.__getitem__)
        # A hair is taken off so that an exact share is not lost to rounding.
        need = max(1, math.ceil(len(words) * threshold - 1e-9))
        span = math.ceil(len(re.findall(r"[0-9a-z]+", text.lower())) * SLACK)
        sets.append({"label": label, "words": words, "need": need, "span": span})
    return order, sets


def scanned(df: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score per row.

    score is 1 where a base phrase stands, else the best containment that met the threshold,
    else 0.
    """
    texts = df.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    order, sets = ordered_templates(texts, templates, threshold)
    rare = sorted({word for each in sets for word in each["words"][: len(each["words"]) - each["need"] + 1]})
    words = texts.select("doc_id", ascii_lower(F.col("text")).alias("text")).withColumn("w", words_of(F.col("text")))
    joined = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))

    def starts(phrase: str) -> Column:
        parts = phrase.split()
        test = " AND ".join(f"w[i + {k}] = '{part}'" for k, part in enumerate(parts))
        places = f"filter(sequence(0, size(w) - {len(parts)}), i -> {test})"
        return F.when(F.contains(F.col("joined"), F.lit(f" {phrase} ")), F.expr(places)).otherwise(F.array().cast("array<int>"))

    phrases = words.withColumn("joined", joined)
    places = F.struct(*[starts(phrase).alias(f"p{k}") for k, phrase in enumerate(BASE_PHRASES)])
    # Lines matter only in texts that have an indexed word at all.
    lines = F.when(F.arrays_overlap("w", strings(rare)), F.split("text", "\n")) if rare else F.lit(None)
    # Every run of up to `span` words lies in one of the windows of twice that length. The lines
    # serve texts of one line.
    span = max((each["span"] for each in sets), default=1)
    wrapped = F.expr(f"transform(sequence(0, greatest(size(w) - 1, 0), {span}), i -> slice(w, i + 1, {2 * span}))")
    windows = F.when(F.arrays_overlap("w", strings(rare)) & F.contains("text", F.lit("\n")), wrapped) if rare else F.lit(None)
    narrow = phrases.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        places.alias("places"),
        F.filter(lines.cast("array<string>"), lambda line: F.arrays_overlap(words_of(line), strings(rare))).alias("lines"),
        F.filter(windows.cast("array<array<string>>"), lambda window: F.arrays_overlap(window, strings(rare))).alias("windows"),
    )
    # Written once, so that a row keeps its number in both branches below.
    rows = materialise(narrow)
    all_places = F.concat(*[F.col(f"places.p{k}") for k in range(len(BASE_PHRASES))])
    base_labels = F.array_compact(
        F.array(*[F.when(F.size(f"places.p{k}") > 0, F.lit(label)) for k, label in enumerate(BASE_PHRASES.values())])
    )
    based = rows.select(
        "row",
        "doc_id",
        "n_words",
        F.size(all_places).cast("long").alias("n_base"),
        F.array_min(all_places).cast("long").alias("first_word"),
        F.array_max(all_places).cast("long").alias("last_word"),
        base_labels.alias("base"),
    )
    found = matches(rows, order, sets) if sets else None
    if found is not None:
        based = based.join(found, "row", "left")
    else:
        based = based.withColumns({"met": F.lit(None).cast("array<string>"), "share": F.lit(None).cast("double")})
    together = F.array_sort(F.array_union("base", F.coalesce("met", F.array().cast("array<string>"))))
    return based.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(together, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def matches(rows: DataFrame, order: list[str], sets: list[dict]) -> DataFrame:
    """(row, met, share): labels of templates that a block of `rows(row, lines, windows)` meets."""
    index = [
        {"word": word, "place": place, "label": each["label"], "need": each["need"], "span": each["span"], "words": each["words"]}
        for each in sets
        for place, word in enumerate(each["words"][: len(each["words"]) - each["need"] + 1])
    ]
    schema = "array<struct<word:string,place:int,label:string,need:int,span:int,words:array<string>>>"
    indexed = rows.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(index)), schema)))
    held = lambda words: F.array_intersect(strings(order), words).alias("block")
    lines = rows.select("row", F.explode("lines").alias("line")).select(
        "row", held(words_of(F.col("line"))), F.lit(None).cast("array<string>").alias("window")
    )
    windows = rows.select("row", F.explode("windows").alias("window")).select("row", held(F.col("window")), "window")
    blocks = lines.unionByName(windows)
    fewest = min(each["need"] for each in sets)
    tokens = blocks.where(F.size("block") >= fewest).select("row", "block", "window", F.posexplode("block").alias("at", "word"))
    # The index has at most one row per word of a template, which is a parameter.
    pairs = tokens.join(F.broadcast(indexed), "word").where(
        (F.size("block") >= F.col("need"))
        & (
            F.least("at", "place") + 1 + F.least(F.size("block") - F.col("at"), F.size("words") - F.col("place")) - 1
            >= F.col("need")
        )
    )
    # Of a window counts the best run that is not much longer than the template.
    overlap = F.expr(
        """CASE WHEN size(array_intersect(block, words)) < need OR window IS NULL THEN size(array_intersect(block, words))
            ELSE array_max(transform(sequence(0, greatest(size(window) - span, 0)),
                i -> size(array_intersect(words, slice(window, i + 1, span))))) END"""
    )
    counted = pairs.select("row", "label", "need", overlap.alias("shared"), F.size("words").alias("size"))
    return (
        counted.where("shared >= need")
        .groupBy("row")
        .agg(F.collect_set("label").alias("met"), F.max(F.col("shared") / F.col("size")).alias("share"))
    )


def result(df: DataFrame) -> DataFrame:
    return scanned(df).drop("n_words")


def _sql() -> str:
    """The same scan for DuckDB, every line against every template."""
    values = ", ".join(
        f"('{label}', {template_words(text)!r}, {max(1, math.ceil(len(template_words(text)) * THRESHOLD - 1e-9))})" for label, text in TEMPLATES
    )
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

    def hits(phrase: str) -> str:
        parts = phrase.split()
        test = " AND ".join(f"w[i + {k}] = '{part}'" for k, part in enumerate(parts))
        return f"CASE WHEN contains(' ' || array_to_string(w, ' ') || ' ', ' {phrase} ') THEN list_filter(range(1, len(w) - {len(parts)} + 2), lambda i: {test}) ELSE [] END"

    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{pattern}') AS w FROM d),
p AS (SELECT r, doc_id, t, {", ".join(f"{hits(phrase)} AS p{k}" for k, phrase in enumerate(BASE_PHRASES))} FROM w),
b AS (SELECT r, doc_id, list_concat(list_concat(p0, p1), p2) AS a,
  list_filter([{", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, label in enumerate(BASE_PHRASES.values()))}], lambda x: x IS NOT NULL) AS base FROM p),
tpl(label, words, need) AS (VALUES {values}),
lines AS (SELECT r, list_distinct(regexp_extract_all(unnest(string_split(t, chr(10))), '{pattern}')) AS lw FROM d),
m AS (SELECT r, label, len(list_intersect(lw, words)) / len(words) AS share FROM lines, tpl WHERE len(list_intersect(lw, words)) >= need),
g AS (SELECT r, list(DISTINCT label) AS met, max(share) AS share FROM m GROUP BY r)
SELECT doc_id, len(a)::BIGINT AS n_base, (list_min(a) - 1)::BIGINT AS first_word, (list_max(a) - 1)::BIGINT AS last_word,
  array_to_string(list_sort(base), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, coalesce(met, [])))), ',') AS labels,
  CASE WHEN len(a) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM b LEFT JOIN g USING (r)"""


ORACLE_SQL = _sql()
