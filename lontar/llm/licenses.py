"""Licence scan through a positional index of rare tokens, in DataFrame expressions only.

Templates are phrases and notices; their content words have postings (template, position). Over all documents, the
document frequency of each of these words is counted. For a file and a template, the ``LOOKED_UP`` content words of
highest inverse document frequency that the file has are looked up: an occurrence at word i, for a posting at p, votes
for an alignment at i - p. Alignments on which enough looked-up words agree are kept if the template's mandatory key
phrases stand at their relative places. As a phrase's rarest word is part of each place where the phrase stands, no
place is missed; as alignments come from rare words, few are tried.

The corpus is tokenised once. What is kept of it is a row for each document, with words only where it has a content
word at all; all later work is within a row, so there is no shuffle but that of the frequencies.
"""

from __future__ import annotations

import re
from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lontar.llm.shared import Scratch

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOOKED_UP = 3
#: Words by which a notice's key phrase may be displaced.
SLACK = 2

# Phrases with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Notices as their licences word them, each with its label and mandatory key phrases.
NOTICES = [
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0", ["gnu general public license", "version 3"]),
    ("this work is licensed under the gnu general public license version 2", "gpl-2.0", ["gnu general public license", "version 2"]),
    ("this work is licensed under the gnu lesser general public license", "lgpl", ["gnu lesser general public license"]),
    ("this work is licensed under the gnu affero general public license", "agpl", ["gnu affero general public license"]),
    ("licensed under the apache license version 2 0", "apache-2.0", ["apache license", "version 2 0"]),
    ("released under the mit license", "mit-notice", ["released under the mit license"]),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0", ["cc by nc", "4 0"]),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0", ["cc by sa", "4 0"]),
    ("licensed under cc by 4 0", "cc-by-4.0", ["cc by 4 0"]),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit-text", ["permission is hereby granted", "free of charge"]),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", ["redistribution and use", "source and binary forms"]),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0", ["mozilla public license"]),
    ("this is free and unencumbered software released into the public domain", "unlicense", ["free and unencumbered software"]),
]

# Words too common to be looked up.
COMMON = frozenset("a and any are by for form free in into is of or person the this to under use v with without work 0 2 3 4".split())


class Template:
    def __init__(self, text: str, label: str, phrases: list[str], base: bool):
        words = text.split()
        self.label, self.base, self.slack = label, base, 0 if base else SLACK
        self.postings = [(w, i) for i, w in enumerate(words) if w not in COMMON]
        self.need = min(2, len({w for w, _ in self.postings}))
        self.phrases = []
        for phrase in phrases:
            part = phrase.split()
            at = next(i for i in range(len(words)) if words[i : i + len(part)] == part)
            self.phrases.append((at, part))

    def sql(self, idf: dict[str, float]) -> str:
        """The template as a struct; its words from the rarest on."""

        def q(w: str) -> str:
            return "'" + re.sub(r"([\\'])", r"\\\1", w) + "'"

        rare = sorted({w for w, _ in self.postings}, key=lambda w: (-idf[w], w))
        postings = ", ".join(f"named_struct('word', {q(w)}, 'at', {i}, 'idf', {idf[w]!r}D)" for w, i in self.postings)
        phrases = ", ".join(f"named_struct('at', {at}, 'words', array({', '.join(map(q, part))}))" for at, part in self.phrases)
        return f"named_struct('label', {q(self.label)}, 'base', {str(self.base).lower()}, 'need', {self.need}, 'slack', {self.slack}, 'rare', array({', '.join(map(q, rare))}), 'postings', array({postings}), 'phrases', array({phrases}))"


TEMPLATES = [Template(p, label, [p], True) for p, label in BASE.items()] + [Template(*n, False) for n in NOTICES]
VOCABULARY = sorted({w for t in TEMPLATES for w, _ in t.postings})

#: Within a lambda over a template t: looked-up words, alignments, those that are agreed on and verified.
_TOP = f"slice(filter(t.rare, w -> array_contains(present, w)), 1, {LOOKED_UP})"
_ALIGNED = "array_distinct(flatten(transform(filter(hits, h -> array_contains(top, h.word)), h -> transform(filter(t.postings, p -> p.word = h.word), p -> h.at - p.at))))"
_AGREED = "size(array_distinct(transform(filter(t.postings, p -> array_contains(top, p.word) and coalesce(get(words, o + p.at) = p.word, false)), p -> p.word))) >= least(t.need, size(top))"
_STANDS = "forall(t.phrases, f -> exists(sequence(-t.slack, t.slack), d -> forall(sequence(0, size(f.words) - 1), k -> coalesce(get(words, o + f.at + d + k) = f.words[k], false))))"
_MASS = "aggregate(t.postings, 0D, (a, p) -> a + if(coalesce(get(words, o + p.at) = p.word, false), p.idf, 0D)) / aggregate(t.postings, 0D, (a, p) -> a + p.idf)"
_PLACES = f"transform(filter({_ALIGNED}, o -> {_AGREED} and {_STANDS}), o -> named_struct('at', o, 'mass', {_MASS}))"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places; a row per row of ``docs``.

    places: array of (label, base, at, mass), every verified place with the share of its template's IDF that stands
    there; score is the largest share. A null or empty text has no words and no place. Null and repeated ids pass
    through. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.regexp_extract_all(plain, F.lit(WORD), F.lit(0)).alias("words"))
    known = F.array(*map(F.lit, VOCABULARY))
    kept = words.select("doc_id", F.size("words").cast("long").alias("n_words"), F.when(F.arrays_overlap("words", known), F.col("words")).alias("words"))
    kept = scratch.write(kept.withColumn("present", F.array_intersect("words", known)))
    n = kept.count()
    df = {r["word"]: r["n"] for r in kept.select(F.explode("present").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}  # a row for each word of the vocabulary
    idf = {w: log((2 + n) / (1 + df.get(w, 0))) for w in VOCABULARY}
    templates = f"array({', '.join(t.sql(idf) for t in TEMPLATES)})"
    hits = F.expr("transform(filter(sequence(0, size(words) - 1), i -> array_contains(present, words[i])), i -> named_struct('at', i, 'word', words[i]))")
    some = F.col("words").isNotNull()
    each = f"transform({templates}, t -> element_at(transform(array({_TOP}), top -> transform(if(size(top) = 0, array(), {_PLACES}), p -> named_struct('label', t.label, 'base', t.base, 'at', p.at, 'mass', p.mass))), 1))"
    found = kept.withColumn("hits", F.when(some, hits)).withColumn("places", F.when(some, F.flatten(F.expr(each))).otherwise(F.expr("cast(array() as array<struct<label:string,base:boolean,at:int,mass:double>>)")))
    base = F.filter("places", lambda p: p["base"])

    def joined(places: F.Column) -> F.Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")

    starts = F.transform(base, lambda p: p["at"].cast("long"))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["mass"])), F.lit(0.0)).alias("score"),
        "places",
    )

