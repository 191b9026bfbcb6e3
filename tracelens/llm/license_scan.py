"""Licence scan by a positional index of rare licence words.

Words of the licence templates are ranked by their document frequency over the whole corpus (rarest first: highest IDF).
A file looks up its highest-IDF words of each template whose words it has enough of, turns each place and posting into a
relative position (place in the file less place in the template), and keeps those that NEEDED postings share. There the
template's mandatory phrases have to stand word for word, and LEAST_SHARE of its words. Both passes are narrow: the first
counts at most one row per licence word, the second needs no shuffle, since the ranked postings are constants.

Base phrases are found apart, by their words; their labels always stay. `score` is 1 where a base phrase stands, else the
largest share of a template that stands at a relative position, verified or not, else 0.

Defined results: a null or empty text has no words and no labels (empty strings), score 0 and null places; very long texts are
scanned whole; repeated rows are judged each, null ids too; of words of equal frequency the lesser in order counts as
rarer; only A-Z are lower-cased; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: What stands between words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Fixed values: (phrase, label).
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Fixed values, sentences of public licences: (label, words, mandatory phrases).
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge", "associated documentation files"]),
    ("mit", "spdx license identifier mit", ["spdx license identifier mit"]),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["except in compliance with the license", "apache org licenses"]),
    ("apache", "spdx license identifier apache 2 0", ["spdx license identifier apache"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license", "free software foundation"]),
    ("gpl", "spdx license identifier gpl", ["spdx license identifier gpl"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "conditions are met"]),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", ["endorse or promote products derived from this software"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["as is without any express or implied warranty", "authors be held liable"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0 international"]),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", ["cc0 1 0 universal"]),
]
#: A file's words of a template that are looked up; postings that have to agree; tenths of a template that have to stand.
LOOKED_UP, NEEDED, LEAST_TENTHS = 4, 3, 6


def vocabulary(templates: list[tuple[str, str, list[str]]] = TEMPLATES) -> list[str]:
    return sorted({w for _, text, _ in templates for w in text.split()})


def lowered(text_col: str = "text") -> Column:
    """The text with A-Z in lower case.

    lower() changes other letters too, but none into a separator, and the Kelvin sign alone into one of a-z, so that goes first.
    """
    return F.lower(F.replace(text_of(text_col), F.lit("\u212a"), F.lit("\u00e5")))


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, BETWEEN), lambda w: w != "")


def word_ranks(docs: DataFrame, words: list[str], text_col: str = "text") -> list[str]:
    """The licence words by falling IDF over all documents; the counts have a row per licence word at most."""
    own = F.array_distinct(F.filter(F.split(lowered(text_col), BETWEEN), lambda w: w.isin(words)))
    found = {r.word: r["count"] for r in docs.select(F.explode(own).alias("word")).groupBy("word").count().collect()}
    return sorted(words, key=lambda w: (found.get(w, 0), w))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value made once, whatever body's lambdas do with it."""
    return F.transform(F.array(value), body)[0]


def standing(words: Column, sought: Column, at: Column) -> Column:
    """True where the words sought (an array) stand from `at` on."""
    return F.slice(words, at + 1, F.size(sought)) == sought


def phrase_places(text: Column, words: Column, phrase: str, label: str) -> Column:
    """(place, label) where a phrase stands; words are looked at only if all of the phrase's are somewhere in the text."""
    sought = phrase.split()
    first = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: (F.get(words, i) == sought[0]) & standing(words, F.array(*map(F.lit, sought)), i))
    places = F.transform(first, lambda i: F.struct(i.cast("long").alias("place"), F.lit(label).alias("label")))
    some = reduce(lambda a, b: a & b, [F.contains(text, F.lit(w)) for w in sought])
    return F.when(some, places).otherwise(F.array().cast("array<struct<place:bigint,label:string>>"))


def index_of(templates: list[tuple[str, str, list[str]]], ranks: list[str]) -> Column:
    """The templates as a constant: label, words, their ranks (the postings), and mandatory phrases with their places."""
    number, texts = {w: k for k, w in enumerate(ranks)}, lambda words: F.array(*map(F.lit, words))
    rows = []
    for label, text, phrases in templates:
        words = text.split()
        place = {p: next(k for k in range(len(words)) if words[k : k + len(p.split())] == p.split()) for p in phrases}
        must = F.array(*[F.struct(F.lit(place[p]).alias("place"), texts(p.split()).alias("words")) for p in phrases])
        rows.append(F.struct(F.lit(label).alias("label"), texts(words).alias("words"), F.array(*[F.lit(number[w]) for w in words]).alias("ranks"), must.alias("phrases")))
    return F.array(*rows)


def aligned(words: Column, hits: Column, present: Column, template: Column) -> Column:
    """(share, verified, label) of a template at each relative position that enough of the file's rare words agree on.

    hits: (place, rank) of the file's licence words; present: their distinct ranks.
    """
    size = F.size(template["words"])
    covered = F.size(F.filter(template["ranks"], lambda k: F.array_contains(present, k)))

    def offsets(top: Column) -> Column:
        seen = F.filter(hits, lambda h: F.array_contains(top, h["rank"]))
        posted = F.transform(seen, lambda h: F.filter(F.transform(template["ranks"], lambda k, p: F.when(k == h["rank"], h["place"] - p)), lambda x: x.isNotNull()))
        return F.array_sort(F.flatten(posted))

    def agreed(found: Column) -> Column:
        return F.array_distinct(F.filter(found, lambda x, i: F.coalesce(F.get(found, i + (NEEDED - 1)) == x, F.lit(False))))

    def judged(at: Column) -> Column:
        stands = F.size(F.filter(F.sequence(F.lit(0), size - 1), lambda k: (at + k >= 0) & F.coalesce(F.get(words, at + k) == F.get(template["words"], k), F.lit(False))))
        exact = F.forall(template["phrases"], lambda p: (at + p["place"] >= 0) & standing(words, p["words"], F.greatest(at + p["place"], F.lit(0))))
        return F.struct((stands / size).alias("share"), (exact & (stands * 10 >= size * LEAST_TENTHS)).alias("verified"), template["label"].alias("label"))

    top = F.slice(F.array_sort(F.array_intersect(present, template["ranks"])), 1, LOOKED_UP)
    found = bound(bound(top, offsets), lambda s: F.transform(agreed(s), judged))
    return F.when(covered * 10 >= size * LEAST_TENTHS, found).otherwise(F.array().cast("array<struct<share:double,verified:boolean,label:string>>"))


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str, list[str]]] = TEMPLATES) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score of each document."""
    ranks = word_ranks(docs, vocabulary(templates), text_col)
    rank_of, index = F.create_map(*[x for k, w in enumerate(ranks) for x in (F.lit(w), F.lit(k))]), index_of(templates, ranks)

    def licence_words(words: Column) -> Column:
        marked = F.transform(words, lambda w, i: F.when(w.isin(ranks), F.struct(i.alias("place"), w.alias("word"))))
        return F.transform(F.filter(marked, lambda h: h.isNotNull()), lambda h: F.struct(h["place"].alias("place"), F.element_at(rank_of, h["word"]).alias("rank")))

    def found(words: Column, hits: Column) -> Column:
        return bound(F.array_distinct(hits["rank"]), lambda present: F.flatten(F.transform(index, lambda t: aligned(words, hits, present, t))))

    def judged(text: Column, words: Column) -> Column:
        base = F.concat(*[phrase_places(text, words, *b) for b in BASE])
        return F.struct(F.size(words).cast("long").alias("n_words"), base.alias("base"), bound(licence_words(words), lambda hits: found(words, hits)).alias("found"))

    whole = bound(lowered(text_col), lambda text: bound(split_words(text), lambda words: judged(text, words)))
    rows = docs.select(F.col(id_col).alias("id"), whole.alias("r")).select("id", "r.n_words", "r.base", "r.found")
    base_labels = F.transform("base", lambda b: b["label"])
    verified = F.transform(F.filter("found", lambda f: f["verified"]), lambda f: f["label"])
    text = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best = F.coalesce(F.array_max(F.transform("found", lambda f: f["share"])), F.lit(0.0))
    return rows.select(
        F.col("id").alias(id_col), "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(F.transform("base", lambda b: b["place"])).alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["place"])).alias("last_word"), text(base_labels).alias("base_labels"), text(F.concat(base_labels, verified)).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(best).alias("score"),
    )
