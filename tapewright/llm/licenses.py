"""License notices: fixed phrases word by word, and an exact containment join of text blocks with license templates.

A block is a window of 64 words that begins at every 32nd word of a text, so
each run of at most 33 words lies whole in one. A template meets a block if the
block holds at least ``threshold`` of the template's different words. The join
is exact and filters in the order of global frequency, rarest first:

* prefix: a pair of enough common words shares one of the template's first
  ``size - least + 1`` words, where ``least`` is the number it must share;
* length: the block holds at least ``least`` words of the templates at all;
* position: the words from a shared one on, in either list, can still reach it.

Words of no template can't be shared and are left out of a block's list.
DataFrame functions only.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Common license notices and the labels they stand for.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

BLOCK_WORDS, STEP_WORDS = 64, 32
THRESHOLD = 0.8
#: The templates' words are kept in each task.
MOST_TEMPLATE_WORDS = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def spaced_words(text: Column) -> Column:
    """The text's words in lower case (A to Z only), each with a space before, and one at the end; a null text has none."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.regexp_replace(F.concat(F.lit(" "), low, F.lit(" ")), BETWEEN_WORDS, " ")


def words_of(text: str) -> list[str]:
    return [w for w in re.split(BETWEEN_WORDS, text.translate(str.maketrans(UPPER, LOWER))) if w]


def count_words(spaced: Column) -> Column:
    """Words of a text, or of a part of it cut before a word and after a space."""
    return F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))


def needed(size: int, threshold: float) -> int:
    """The least number of a template's words that meets the threshold."""
    return max(1, math.ceil(threshold * size - 1e-9))


def template_words(templates: Sequence[tuple[str, str]]) -> list[str]:
    found = sorted({w for _, text in templates for w in words_of(text)})
    if len(found) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"templates of more than {MOST_TEMPLATE_WORDS} different words")
    return found


def by_frequency(texts: DataFrame, words: Sequence[str]) -> list[str]:
    """The words from rarest to commonest by the documents of ``spaced`` that hold them, equal ones by name."""
    held = F.array_intersect(F.split("spaced", " "), F.array(*[F.lit(w) for w in words]))
    counts = {r["word"]: r["count"] for r in texts.select(F.explode(held).alias("word")).groupBy("word").count().collect()}
    return sorted(words, key=lambda w: (counts.get(w, 0), w))


def _prefixes(texts: DataFrame, templates: Sequence[tuple[str, str]], order: Sequence[str], threshold: float) -> DataFrame:
    """One row for each word of a template's prefix: ``word, place, template, label, least``; as many as the templates have words at most."""
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for label, text in templates:
        own = sorted(set(words_of(text)), key=rank.__getitem__)
        least = needed(len(own), threshold)
        whole = F.array(*[F.lit(w) for w in own])
        rows += [F.struct(F.lit(w).alias("word"), F.lit(i).alias("place"), whole.alias("template"), F.lit(label).alias("label"), F.lit(least).alias("least")) for i, w in enumerate(own[: len(own) - least + 1])]
    return texts.sparkSession.range(1).select(F.inline(F.array(*rows)))


def _windows(spaced: Column) -> Column:
    """Overlapping windows of the text's words, each a string of words with a space after each."""
    steps = F.regexp_extract_all(spaced, F.lit(f"(?:[^ ]+ ){{1,{STEP_WORDS}}}"), F.lit(0))
    return F.zip_with(steps, F.slice(steps, 2, F.greatest(F.size(steps), F.lit(1))), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))


def _places(spaced: Column, phrase: str) -> Column:
    """How often the phrase's words stand together, and the numbers of the first and the last place's first words."""
    parts = F.split(spaced, f"(?<= ){phrase}(?= )")
    size = len(phrase.split())
    # A part's words are those that end in it; the first begins with a space.
    first = count_words(F.element_at(parts, 1)) - 1
    last = count_words(spaced) - 1 - (count_words(F.element_at(parts, -1)) - 1) - size
    found = F.struct((F.size(parts) - 1).alias("n"), first.alias("first"), last.alias("last"))
    return F.when(F.contains(spaced, F.lit(f" {phrase} ")), found)


def noticed(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of every row of ``doc_id, text`` with ``n_words, n_base, first_word, last_word, base_labels, labels, score``.

    Null and empty texts have no words. Texts are read whole, also very long ones; rows that repeat an id, or are equal
    in all, stay rows of their own; an empty table has no rows. Columns other than ``keep`` and ``text`` are ignored.
    ``score`` is 1 where a phrase stands, else the greatest containment that meets the threshold, else 0. Ties between
    words of one frequency go by name; they change no result.
    """
    kept = [F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)]
    texts = docs.select(*kept, spaced_words(F.col("text")).alias("spaced"))
    order = by_frequency(texts, template_words(templates))
    prefixes = _prefixes(texts, templates, order, threshold)
    smallest = min(needed(len(set(words_of(t))), threshold) for _, t in templates)
    marks = sorted({r["word"] for r in prefixes.select("word").collect()}, key=order.index)
    ordered = F.array(*[F.lit(w) for w in order])
    held = F.transform(_windows(F.col("spaced")), lambda w: F.array_intersect(ordered, F.split(w, " ")))
    likely = F.filter(held, lambda w: (F.size(w) >= smallest) & F.arrays_overlap(w, F.array(*[F.lit(m) for m in marks])))
    marked = F.arrays_overlap(F.split("spaced", " "), F.array(*[F.lit(m) for m in marks]))
    rows = texts.select(
        F.monotonically_increasing_id().alias("row"), *[f"keep_{i}" for i in range(len(keep))], (count_words(F.col("spaced")) - 1).cast("long").alias("n_words"),
        *[_places(F.col("spaced"), phrase).alias(f"places_{i}") for i, (phrase, _) in enumerate(PHRASES)],
        F.when(marked, likely).otherwise(F.array().cast("array<array<string>>")).alias("blocks"),
    )
    base = [c for c in rows.columns if c not in ("row", "blocks")]
    blocks = rows.select("row", *base, F.explode_outer("blocks").alias("block"))
    words = blocks.select("row", *base, "block", F.posexplode_outer("block").alias("at", "word"))
    after = F.least(F.size("template") - F.col("place"), F.size("block") - F.col("at"))
    shared = F.size(F.array_intersect("block", "template"))
    pairs = words.join(F.broadcast(prefixes), "word", "left")  # no more rows than the templates have words
    met = (F.size("block") >= F.col("least")) & (after >= F.col("least")) & (shared >= F.col("least"))
    found = pairs.groupBy("row").agg(
        *[F.first(c).alias(c) for c in base], F.collect_set(F.when(met, F.col("label"))).alias("own"), F.max(F.when(met, shared / F.size("template"))).alias("share")
    )
    places = [F.col(f"places_{i}") for i in range(len(PHRASES))]
    labels = F.array_compact(F.array(*[F.when(p.isNotNull(), F.lit(label)) for p, (_, label) in zip(places, PHRASES, strict=True)]))
    n_base = sum((F.coalesce(p["n"], F.lit(0)) for p in places), F.lit(0)).cast("long")
    return found.select(
        *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)], "n_words", n_base.alias("n_base"),
        F.least(*[p["first"] for p in places]).cast("long").alias("first_word"), F.greatest(*[p["last"] for p in places]).cast("long").alias("last_word"),
        F.array_join(F.array_sort(labels), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(labels, "own")), ",").alias("labels"),
        F.when(n_base > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op12_license_scan(docs: DataFrame) -> DataFrame:
    return noticed(docs)


def _values(rows: Sequence[Sequence[str]]) -> str:
    return ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)


#: Every window against every template, without a filter.
OP12_SQL = f"""WITH texts AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words FROM documents),
phrases(phrase, label) AS (VALUES {_values(PHRASES)}),
templates AS (SELECT label, list_distinct(list_filter(regexp_split_to_array(translate(text, '{UPPER}', '{LOWER}'), '[^0-9a-z]+'), lambda w: w <> '')) AS template FROM (VALUES {_values(TEMPLATES)}) t(label, text)),
places AS (SELECT r, label, unnest(list_filter(range(len(words)), lambda i: words[i + 1:i + len(string_split(phrase, ' '))] = string_split(phrase, ' '))) AS place
  FROM texts, phrases WHERE list_contains(words, string_split(phrase, ' ')[1])),
base AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list_distinct(list(label))) AS labels FROM places GROUP BY r),
blocks AS (SELECT r, list_distinct(words[k * {STEP_WORDS} + 1:k * {STEP_WORDS} + {BLOCK_WORDS}]) AS block FROM (SELECT r, words, unnest(range((len(words) + {STEP_WORDS - 1}) // {STEP_WORDS})) AS k FROM texts)),
pairs AS (SELECT r, label, len(list_intersect(block, template)) AS shared, len(template) AS size FROM blocks, templates),
own AS (SELECT r, list(DISTINCT label) AS labels, max(shared / size) AS share FROM pairs WHERE shared >= ceil({THRESHOLD} * size - 1e-9) GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(b.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(o.labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1E0 ELSE coalesce(share, 0E0) END AS score
FROM texts t LEFT JOIN base b ON t.r = b.r LEFT JOIN own o ON t.r = o.r"""
