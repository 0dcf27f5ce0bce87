"""Licence scans by a positional index of rare words, in DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crivo.llm.common import words_of


@dataclass(frozen=True)
class Template:
    """A licence notice: its words, the words that must stand in it, and its label.

    A place counts if the mandatory words are there, at their position, and the IDF-weighted share
    of the template's words found at their positions is at least `least`.
    """

    label: str
    words: tuple[str, ...]
    key: tuple[str, ...]
    least: float
    base: bool = False

    @property
    def key_at(self) -> int:
        n = len(self.key)
        return next(i for i in range(len(self.words)) if self.words[i : i + n] == self.key)


def _base(label: str, phrase: str) -> Template:
    words = tuple(phrase.split())
    return Template(label, words, words, 1.0, True)


def _notice(label: str, notice: str, key: str) -> Template:
    return Template(label, tuple(notice.split()), tuple(key.split()), 0.5)


# Base phrases, and notices with their mandatory words.
BASE = (
    _base("cc-by", "cc by"),
    _base("gpl", "general public license"),
    _base("reserved", "all rights reserved"),
)
NOTICES = (
    _notice("agpl", "gnu affero general public license version 3", "affero general public license"),
    _notice("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    _notice("bsd", "released under the bsd license", "bsd license"),
    _notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    _notice("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    _notice("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    _notice("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    _notice("cc0", "cc0 1 0 universal", "cc0"),
    _notice("gpl-2", "licensed under the gnu general public license version 2", "general public license version 2"),
    _notice("gpl-3", "licensed under the gnu general public license version 3", "general public license version 3"),
    _notice("isc", "released under the isc license", "isc license"),
    _notice("lgpl", "gnu lesser general public license", "lesser general public license"),
    _notice("mit", "released under the mit license", "mit license"),
    _notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby granted free of charge"),
    _notice("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    _notice("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
)
TEMPLATES = BASE + NOTICES


def word_idf(docs: DataFrame, templates: tuple[Template, ...]) -> dict[str, float]:
    """IDF of every template word over all documents; as many numbers as the templates have words."""
    vocabulary = sorted({w for t in templates for w in t.words})
    present = F.array_intersect(words_of(F.col("text")), F.array(*map(F.lit, vocabulary)))
    held = docs.select(F.explode(F.concat(present, F.array(F.lit("")))).alias("word"))
    counts = {r.word: r["count"] for r in held.groupBy("word").count().collect()}
    total = counts.pop("", 0)
    return {w: math.log((total + 1) / (counts.get(w, 0) + 0.5)) + 1.0 for w in vocabulary}


def _postings(templates: tuple[Template, ...], idf: dict[str, float]) -> Column:
    """The index: for the rarest word of each template its position and the words around it.

    The rarest word is taken from the mandatory ones, so no counted place lacks it.
    """
    rows = []
    for t in templates:
        rare = max(range(len(t.key)), key=lambda i: (idf[t.key[i]], -i)) + t.key_at
        rows.append(
            F.struct(
                F.lit(t.words[rare]).alias("word"),
                F.lit(rare).alias("at"),
                F.array(*map(F.lit, t.words)).alias("words"),
                F.array(*[F.lit(idf[w]) for w in t.words]).alias("idf"),
                F.lit(sum(idf[w] for w in t.words)).alias("total"),
                F.array(*map(F.lit, t.key)).alias("key"),
                F.lit(t.key_at).alias("key_at"),
                F.lit(t.least).alias("least"),
                F.lit(t.label).alias("label"),
                F.lit(t.base).alias("base"),
            )
        )
    return F.array(*rows)


def license_matches(words: Column, templates: tuple[Template, ...], idf: dict[str, float]) -> Column:
    """Array of `first` (word position of the mandatory words), `label`, `base`, `score`.

    Occurrences of indexed rare words are looked up; a posting moves them to the template's start,
    where the other words are intersected by relative position and the mandatory words verified.
    """
    postings = _postings(templates, idf)
    rare = sorted({t.key[max(range(len(t.key)), key=lambda i: (idf[t.key[i]], -i))] for t in templates})
    places = F.filter(
        F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(rare)
    )

    def aligned(at: Column) -> Column:
        own = F.filter(postings, lambda p: p["word"] == F.get(words, at))
        return F.transform(own, lambda p: measured(p, at - p["at"]))

    def measured(p: Column, start: Column) -> Column:
        shared = F.aggregate(
            F.sequence(F.lit(0), F.size(p["words"]) - 1),
            F.lit(0.0),
            lambda acc, j: acc
            + F.when((start + j >= 0) & (F.get(words, start + j) == F.get(p["words"], j)), F.get(p["idf"], j)).otherwise(0.0),
        )
        first = start + p["key_at"]
        verified = F.when(first >= 0, F.slice(words, F.greatest(first, F.lit(0)) + 1, F.size(p["key"])) == p["key"])
        return F.struct(
            first.alias("first"), p["label"].alias("label"), p["base"].alias("base"), p["least"].alias("least"),
            F.least(shared / p["total"], F.lit(1.0)).alias("score"), F.coalesce(verified, F.lit(False)).alias("verified"),
        )

    found = F.flatten(F.transform(places, aligned))
    near = F.filter(found, lambda m: m["verified"] & (m["score"] >= m["least"] - 1e-9))
    return F.when(F.arrays_overlap(words, F.array(*map(F.lit, rare))), near)


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row per document: `doc_id`, `n_words`, `n_base`, `first_word`, `last_word`,
    `base_labels`, `labels`, `score`, `places` (all matches with position, label and score).

    Base phrases count at every place where their words stand consecutively; first and last are the
    smallest and largest start among them. Labels are distinct, sorted and comma-joined, empty
    without a match; the score is that of the best place, 0 without one. Null and empty texts have
    no words. Repeated rows are scanned alike, an empty table gives no rows, other columns are
    ignored. One pass counts the words' documents; the scan itself is one narrow stage.
    """
    idf = word_idf(docs, templates)
    rows = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    none = "array<struct<first:int,label:string,base:boolean,least:double,score:double,verified:boolean>>"
    matched = rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.coalesce(license_matches(F.col("words"), templates, idf), F.array().cast(none)).alias("found"),
    )
    base = F.filter("found", lambda m: m["base"])
    names = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda m: m["label"]))), ",")
    starts = F.transform(base, lambda m: m["first"])
    return matched.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda m: m["score"])), F.lit(0.0)).alias("score"),
        F.transform(
            "found", lambda m: F.struct(m["first"].alias("first"), m["label"].alias("label"), m["score"].alias("score"))
        ).alias("places"),
    )
