"""License scans by a positional index of rare words.

Templates are licence notices.  Each word of a template has postings (template, place).  The inverse document frequency of every
template word is counted over all files.  A file is looked up by its own ``rare`` licence words of the highest IDF: such a word at
place f of the file and p of a template proposes that the template starts at f - p.  A proposal's score is the share of the
template's IDF whose words stand at their places from there; it holds if the words of the mandatory key phrase all do.

Everything is DataFrame work: words come from string and array functions in one scan of the texts, whose results (numbers, and
the licence words of files that hold some key phrase) are written once; the postings are a literal table of fixed size, and
places are grouped by file, template and start.  A text without any key phrase can't have one at its place, so its words are only
counted for the IDF, not looked up.

Defined results: null and empty texts have no words and labels ''; very long texts are scanned whole; repeated rows are
scanned each by itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augury.llm.common import ascii_lower_col, materialise

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases whose places are counted, with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Notices by label, as words, and the phrase that must stand in each.
TEMPLATES = {
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "licensed under the mit license", "mit license"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache org licenses license 2 0"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", "general public license version 2"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "general public license version 3"),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "this permission notice shall be included in all copies or substantial portions of the software"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", "provided by the copyright holders and contributors as is"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", "alter it and redistribute it freely"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse public license 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights cc0 1 0 universal", "cc0 1 0 universal"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", "attribution noncommercial 4 0 international"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license", "attribution sharealike 4 0 international"),
    ("cc-by", "creative commons attribution 4 0 international license", "commons attribution 4 0 international"),
}
SCORE = 0.6  # least share of a template's IDF that a label of the method needs
RARE = 6  # licence words of the highest IDF by which a file is looked up


def normalised(text: Column) -> Column:
    """The words, each between single spaces, with a space before the first and after the last; '' without words."""
    spaced = F.regexp_replace(F.concat(F.lit(" "), ascii_lower_col(text), F.lit(" ")), SEPARATORS, " ")
    return F.when(spaced == " ", F.lit("")).otherwise(spaced)


def _count(text: Column, what: str) -> Column:
    """Occurrences of a string that cannot overlap itself."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))) / len(what)).cast("long")


def _n_words(spaced: Column) -> Column:
    return F.greatest(F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit(""))) - 1, F.lit(0)).cast("long")


def _places(spaced: Column) -> dict[str, Column]:
    """Numbers of places of each phrase; spaces are doubled so that phrases that follow each other share none."""
    twice = F.replace(spaced, F.lit(" "), F.lit("  "))
    return {p: F.when(F.contains(spaced, F.lit(f" {p} ")), _count(twice, f" {p.replace(' ', '  ')} ")).otherwise(F.lit(0).cast("long")) for p in PHRASES}


def _word_of(spaced: Column, start: Column) -> Column:
    """Number of the word that follows the space at ``start`` (counted from 1)."""
    head = F.substring(spaced, F.lit(1), start)
    return (F.length(head) - F.length(F.replace(head, F.lit(" "), F.lit(""))) - 1).cast("long")


def _first_and_last(spaced: Column) -> tuple[Column, Column]:
    firsts, lasts = [], []
    for p in PHRASES:
        what, has = f" {p} ", F.contains(spaced, F.lit(f" {p} "))
        firsts.append(F.when(has, _word_of(spaced, F.instr(spaced, what))))
        lasts.append(F.when(has, _word_of(spaced, F.length(spaced) - F.instr(F.reverse(spaced), what[::-1]) - len(what) + 2)))
    return F.least(*firsts), F.greatest(*lasts)


def scanned(docs: DataFrame, vocabulary: list[str], keys: list[str]) -> DataFrame:
    """Of every row, in one pass over the texts: row (a number), doc_id, the base columns, present (its licence words, each
    once) and hits (its licence words with their places, if it holds a key phrase)."""
    rows = docs.select("doc_id", normalised(F.col("text")).alias("spaced")).withColumn("words", F.split(F.trim("spaced"), " "))
    first, last = _first_and_last(F.col("spaced"))
    places = _places(F.col("spaced"))
    found = F.array_join(F.sort_array(F.array_distinct(F.array_compact(F.array(*[F.when(places[p] > 0, F.lit(label)) for p, label in PHRASES.items()])))), ",")
    some_key = F.contains(F.col("spaced"), F.lit(f" {keys[0]} "))
    for k in keys[1:]:
        some_key |= F.contains(F.col("spaced"), F.lit(f" {k} "))
    numbered = F.transform("words", lambda w, i: F.named_struct(F.lit("word"), w, F.lit("at"), i))
    hits = F.when(some_key, F.filter(numbered, lambda h: h["word"].isin(vocabulary)))
    present = F.array_intersect("words", F.array(*map(F.lit, vocabulary)))
    base = rows.select("doc_id", _n_words(F.col("spaced")).alias("n_words"), sum(places.values()).alias("n_base"), first.alias("first_word"), last.alias("last_word"), found.alias("base_labels"), present.alias("present"), hits.alias("hits"))
    return materialise(base.withColumn("row", F.monotonically_increasing_id()), "licenses")


def inverse_frequencies(rows: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """IDF of each template word over all rows of (present); the counts are a row for each word of the fixed vocabulary."""
    df = {r["w"]: r["count"] for r in rows.select(F.explode("present").alias("w")).groupBy("w").count().collect()}
    n = rows.count()
    return {w: math.log((n + 1) / (df.get(w, 0) + 0.5)) for w in vocabulary}


def proposals(rows: DataFrame, idf: dict[str, float], rare: int = RARE) -> DataFrame:
    """row, label, start and share of each place where a template's key phrase stands and a rare word of the file proposes it."""
    postings, phrases = [], {}
    for tid, (label, text, key) in enumerate(sorted(TEMPLATES)):
        words, phrase = text.split(), key.split()
        at = next(p for p in range(len(words)) if words[p : p + len(phrase)] == phrase)
        whole = sum(idf[w] for w in words)
        postings += [(w, tid, label, p, idf[w] / whole if whole else 1 / len(words), at <= p < at + len(phrase)) for p, w in enumerate(words)]
        phrases[tid] = len(phrase)
    table = rows.sparkSession.createDataFrame([(*x, phrases[x[1]]) for x in postings], "word string, tid int, label string, place int, share double, in_key boolean, key_words int")
    weights = F.create_map(*[F.lit(x) for kv in idf.items() for x in kv])
    # Licence words of the file, rarest first; as many as the fixed vocabulary has at most.
    best = F.slice(F.transform(F.sort_array(F.transform("present", lambda w: F.named_struct(F.lit("less"), -F.element_at(weights, w), F.lit("word"), w))), lambda s: s["word"]), 1, rare)
    each = rows.where("hits is not null").select("row", best.alias("best"), F.explode("hits").alias("hit"))
    votes = each.select("row", F.col("hit.at").alias("at"), F.col("hit.word").alias("word"), F.array_contains("best", F.col("hit.word")).alias("rare")).join(F.broadcast(table), "word")
    # A word of a template that occurs twice in it has two postings, so no place is counted twice.
    starts = votes.groupBy("row", "tid", "label", (F.col("at") - F.col("place")).alias("start")).agg(F.sum("share").alias("share"), F.bool_or("rare").alias("rare"), F.count_if("in_key").alias("n_key"), F.max("key_words").alias("key_words"))
    return starts.where("rare and n_key = key_words").select("row", "label", "start", "share")


def scan(docs: DataFrame, score: float = SCORE, rare: int = RARE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row."""
    vocabulary = sorted({w for _, words, _ in TEMPLATES for w in words.split()})
    rows = scanned(docs, vocabulary, sorted({key for _, _, key in TEMPLATES}))
    found = proposals(rows, inverse_frequencies(rows.select("present"), vocabulary), rare)
    best = found.groupBy("row").agg(F.max("share").alias("score"), F.collect_set(F.when(F.col("share") >= score, F.col("label"))).alias("more"))
    both = F.array_sort(F.array_union(F.filter(F.split("base_labels", ","), lambda x: x != ""), F.coalesce("more", F.array().cast("array<string>"))))
    return rows.join(best, "row", "left").select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", F.array_join(both, ",").alias("labels"), F.least(F.coalesce(F.round("score", 9), F.lit(0.0)), F.lit(1.0)).alias("score"))
