"""License scans: phrases, and an exact set-similarity join of text blocks with
license templates, in DataFrame functions only.

Templates are a short list and go along as a literal, so texts are never
shuffled. Every word of a template has a place in one order, rarest word of the
corpus first; only blocks that hold one of the first words of a template, in a
place that leaves room for enough others, are compared with it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases that count as such, and their labels.
PHRASES = [
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
]
# Notices of public licenses.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
     "software and associated documentation files (the Software), to deal in the Software without "
     "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
     "distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this "
     "file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms "
     "of the GNU General Public License as published by the Free Software Foundation, either version 3 "
     "of the License, or (at your option) any later version"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are "
     "permitted provided that the following conditions are met"),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc", "Licensed under CC BY-NC 4.0"),
]

# Blocks are windows of BLOCK words, a new one every STEP words, so any run of
# STEP words lies whole in one of them.
BLOCK, STEP = 128, 64
# Share of a template's different words that a block must hold.
CONTAINMENT = 0.8
# Bound of the list that travels with the plan, in words.
MOST_TEMPLATE_WORDS = 20_000

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, nothing else; plain ``lower`` where it does the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def words_of(text: Column) -> Column:
    """Words of a text: runs of a-z, 0-9 and characters beyond ASCII."""
    spaced = F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD, " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def template_words(templates: Sequence[tuple[str, str]]) -> list[tuple[str, list[str]]]:
    found = []
    for label, text in templates:
        words = [w for w in re.split(NOT_WORD, text.translate(str.maketrans(UPPER, LOWER))) if w]
        if not 0 < len(words) <= STEP:
            raise ValueError(f"a template must have 1 to {STEP} words, not {len(words)}")
        found.append((label, sorted(set(words))))
    if sum(len(words) for _, words in found) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"templates may have {MOST_TEMPLATE_WORDS} words in all")
    return found


def word_order(worded: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary of the templates, words of fewest documents first.

    Counted over all documents; a list no longer than the vocabulary comes back.
    """
    held = F.array_intersect(F.col("words"), F.lit(vocabulary))
    counts = worded.select(F.explode(held).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    found = {row.word: row.n for row in counts.toLocalIterator()} if vocabulary else {}
    return sorted(vocabulary, key=lambda word: (found.get(word, 0), word))


def contained(block: Column, order: list[str], templates: list[tuple[str, list[str]]], share: float) -> Column:
    """Array of (label, score) of the templates that a block contains.

    ``block`` holds its template words in the order of ``order``. A template of
    n words needs r of them: n - r + 1 rarest words of it, one of which a block
    must hold among its own first ones (prefix), r words in the block (length),
    and r - 1 words after the first common one on both sides (position).
    """
    place = {word: i for i, word in enumerate(order)}
    checked = []
    for label, words in templates:
        n = len(words)
        needed = math.ceil(share * n - 1e-9)
        ranked = sorted(words, key=place.__getitem__)
        prefix = F.lit(ranked[: n - needed + 1])
        head = F.slice(block, 1, F.greatest(F.size(block) - needed + 1, F.lit(0)))
        first = F.get(F.array_intersect(head, prefix), F.lit(0))
        room = F.least(
            F.size(block) - F.array_position(block, first), n - F.array_position(F.lit(ranked), first)
        )
        overlap = F.size(F.array_intersect(block, F.lit(ranked)))
        passes = (F.size(block) >= needed) & F.arrays_overlap(head, prefix) & (room >= needed - 1)
        score = F.when(passes, F.when(overlap >= needed, overlap / F.lit(float(n))))
        checked.append(F.struct(F.lit(label).alias("label"), score.alias("score")))
    return F.filter(F.array(*checked), lambda found: found["score"].isNotNull())


def scan_licenses(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    containment: float = CONTAINMENT,
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``docs`` has (doc_id, text); other columns are ignored, and each row is
    scanned on its own, so repeated rows and null ids give rows of their own.
    Null and empty texts have no words, no places and empty labels. Places are
    starts of PHRASES, in words from 0; labels are those of the phrases and of
    the templates of which some block holds ``containment`` of the different
    words. ``score`` is 1 with a phrase, else the largest containment that
    reaches the threshold, else 0. An empty table gives no rows.
    """
    if not 0 < containment <= 1:
        raise ValueError(f"the containment must be in (0, 1], not {containment}")
    listed = template_words(templates)
    worded = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    order = word_order(worded, sorted({w for _, words in listed for w in words}))
    place = {word: i for i, word in enumerate(order)}
    rare = set()
    for _, words in listed:
        needed = math.ceil(containment * len(words) - 1e-9)
        rare.update(sorted(words, key=place.__getitem__)[: len(words) - needed + 1])

    words, n = F.col("words"), F.size("words")
    joined = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    has = {phrase: F.contains(joined, F.lit(f" {phrase} ")) for phrase, _ in PHRASES}
    some = F.lit(False)
    for found in has.values():
        some = some | found

    def begins(at: Column) -> Column:
        here = F.lit(False)
        for phrase, _ in PHRASES:
            same = F.lit(True)
            for i, word in enumerate(phrase.split()):
                same = same & F.coalesce(F.get(words, at + i) == word, F.lit(False))
            here = here | same
        return here

    none = F.array().cast("array<int>")
    places = F.when(some, F.filter(F.sequence(F.lit(0), n - 1), begins)).otherwise(none)
    base = F.array_compact(F.array(*[F.when(has[p], F.lit(label)) for p, label in PHRASES]))

    starts = F.sequence(F.lit(0), F.greatest(n - STEP - 1, F.lit(0)), F.lit(STEP))
    block = lambda at: F.array_intersect(F.lit(order), F.slice(words, at + 1, BLOCK))
    matches = F.flatten(
        F.transform(
            F.transform(starts, block), lambda held: contained(held, order, listed, containment)
        )
    )
    nothing = F.array().cast("array<struct<label:string,score:double>>")
    found = F.when(F.arrays_overlap(words, F.lit(sorted(rare))), matches).otherwise(nothing) if rare else nothing
    scanned = worded.select("doc_id", n.cast("bigint").alias("n_words"), places.alias("places"),
                            base.alias("base"), found.alias("found"))
    best = F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0.0))
    both = F.array_union("base", F.transform("found", lambda x: x["label"]))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places").cast("bigint").alias("first_word"),
        F.array_max("places").cast("bigint").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(both), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )
