"""Licence notices by a positional index of rare words.

A template is a sequence of words with a mandatory key phrase and a label.  The
index goes from a word to its postings, (template, rank, position): every template
posts the rarest words of its key phrase, where rarity is the document frequency of
the licence vocabulary in all documents and rank 0 is the rarest.  A document looks up
its own words.  Each posting found gives a possible start of its template; the starts
from the rarest word are intersected with those from the next rarest ones.  At those
left the key phrase is verified, and the share of the template's words that stand in
place is the score.

Index and templates are two constants of the expression, so the plan has the same size
for any number of templates, and a document's work grows with the postings it meets.
Everything runs inside a row, so hot sources or long texts move no data.  What
is collected is one row per word of the licence vocabulary.

Null and empty texts have no words: nothing is found, the score is 0.  Rows are
looked at one by one, so repeated or null ids need no care.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lapwise.functions.binding import let
from lapwise.llm.rows import packed, text_of, words

NOT_A_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Words of a key phrase that are indexed.
INDEXED_WORDS = 2
# Share of a template's words that must stand in place.
LEAST_SHARE = 0.6


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key_start: int
    key: tuple[str, ...]
    base: bool


def _template(label: str, text: str, key: str | None = None) -> Template:
    parts, phrase = tuple(text.split()), tuple((key or text).split())
    start = next(i for i in range(len(parts)) if parts[i : i + len(phrase)] == phrase)
    return Template(label, parts, start, phrase, key is None)


TEMPLATES = (
    _template("cc-by", "cc by"),
    _template("gpl", "general public license"),
    _template("reserved", "all rights reserved"),
    _template("apache", "licensed under the apache license version 2 0", "apache license"),
    _template("mit", "released under the mit license", "mit license"),
    _template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    _template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    _template("gnu-gpl", "licensed under the gnu general public license version 3", "gnu general public license"),
    _template("lgpl", "under the gnu lesser general public license", "lesser general public license"),
    _template("mpl", "subject to the terms of the mozilla public license", "mozilla public license"),
    _template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        "permission is hereby granted free of charge",
    ),
    _template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted",
        "redistribution and use in source and binary forms",
    ),
    # Whole texts of public licences.
    _template(
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the software the software is "
        "provided as is without warranty of any kind express or implied including but not limited to the warranties of "
        "merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright "
        "holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
        "arising from out of or in connection with the software or the use or other dealings in the software",
        "the above copyright notice and this permission notice shall be included",
    ),
    _template(
        "isc-text",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies the software is provided as "
        "is and the author disclaims all warranties with regard to this software including all implied warranties of "
        "merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential "
        "damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract "
        "negligence or other tortious action arising out of or in connection with the use or performance of this software",
        "the author disclaims all warranties with regard to this software",
    ),
)


def license_words(text: Column) -> Column:
    """Words after lower-casing A-Z; other letters stay apart from a-z.

    Two capitals outside ASCII have a lower case with an ASCII letter; they are
    replaced first, so that lower() cannot turn them into one.
    """
    safe = F.replace(F.replace(text, F.lit("K"), F.lit("�")), F.lit("İ"), F.lit("�"))
    return words(F.lower(safe), NOT_A_WORD)


def document_frequency(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, text_column: str = "text") -> dict[str, int]:
    """Documents that contain each word of the key phrases."""
    vocabulary = sorted({w for t in templates for w in t.key})
    found = F.array_intersect(license_words(text_of(text_column)), _constant(vocabulary, "array<string>"))
    counts = docs.select(F.explode(found).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return dict.fromkeys(vocabulary, 0) | {r["word"]: r["n"] for r in counts.collect()}


def postings(frequency: dict[str, int], templates: Sequence[Template] = TEMPLATES) -> dict[str, list[dict[str, int]]]:
    """Word to its postings: ``template``, ``rank`` among the rarest of the key phrase, ``position`` in the template."""
    index: dict[str, list[dict[str, int]]] = {}
    for number, t in enumerate(templates):
        first = {w: t.key_start + i for i, w in reversed(list(enumerate(t.key)))}
        rarest = sorted(first.items(), key=lambda p: (frequency[p[0]], p[1]))[:INDEXED_WORDS]
        # A phrase of fewer words posts its last one at the ranks that remain.
        for rank, (word, position) in enumerate(rarest + rarest[-1:] * (INDEXED_WORDS - len(rarest))):
            index.setdefault(word, []).append({"template": number, "rank": rank, "position": position})
    return index


def _constant(value, kind: str) -> Column:
    """A value as one literal, however large."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _candidates(w: Column, index: Column) -> Column:
    """Sorted array of (template, start) that the index allows."""
    hits = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("word"), i.alias("place"))), lambda h: F.map_contains_key(index, h["word"]))
    # Template and start as one number: whole numbers are intersected by hash.
    starts = F.flatten(
        F.transform(
            hits,
            lambda h: F.transform(
                F.element_at(index, h["word"]),
                lambda p: F.struct(p["rank"].alias("rank"), (p["template"] * _STARTS + h["place"] - p["position"] + _BEFORE).alias("start")),
            ),
        )
    )

    def intersected(starts: Column) -> Column:
        of = lambda rank: F.transform(F.filter(starts, lambda s: s["rank"] == rank), lambda s: s["start"])
        left = of(0)
        for rank in range(1, INDEXED_WORDS):
            left = F.array_intersect(left, of(rank))
        pair = lambda s: F.struct(
            F.floor(s / F.lit(_STARTS)).cast("int").alias("template"), (s % _STARTS - _BEFORE).cast("int").alias("start")
        )
        return F.transform(F.array_sort(F.array_distinct(left)), pair)

    return let(starts, intersected)


# A start may lie before the text when only the end of a template stands in it.
_BEFORE = 1 << 20
_STARTS = 1 << 40


def _notices(w: Column, candidates: Column, templates: Column) -> Column:
    """Candidates whose key phrase is there, with the share of words in place."""

    def notice(c: Column) -> Column:
        def of(t: Column) -> Column:
            in_place = F.filter(F.transform(t["words"], lambda x, i: F.get(w, c["start"] + i) == x), lambda same: same)
            key_at = c["start"] + t["key_start"]
            confirmed = (key_at >= 0) & (F.slice(w, F.greatest(key_at, F.lit(0)) + 1, F.size(t["key"])) == t["key"])
            found = F.struct(
                t["label"].alias("label"),
                t["base"].alias("base"),
                c["start"].alias("start"),
                F.size(t["words"]).alias("n_words"),
                F.round(F.size(in_place).cast("double") / F.size(t["words"]), 6).alias("share"),
            )
            return F.when(confirmed, found)

        return let(F.get(templates, c["template"]), of)

    return F.filter(F.array_compact(F.transform(candidates, notice)), lambda f: f["share"] >= LEAST_SHARE)


def scan_licenses(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", templates: Sequence[Template] = TEMPLATES
) -> DataFrame:
    """Notices of every document: id, ``n_words`` and ``found``, an array of (label, base, start, n_words, share)."""
    docs = packed(docs).select(F.col(f"row.{id_column}").alias("id"), F.col(f"row.{text_column}").alias("text"))
    posted = postings(document_frequency(docs, templates), templates)
    index = _constant(posted, "map<string,array<struct<template:bigint,rank:int,position:bigint>>>")
    fields = ("label", "base", "key_start", "key", "words")
    table = _constant(
        [{f: getattr(t, f) for f in fields} for t in templates],
        "array<struct<label:string,base:boolean,key_start:int,key:array<string>,words:array<string>>>",
    )
    kind = "array<struct<label:string,base:boolean,start:int,n_words:int,share:double>>"

    def found(w: Column) -> Column:
        notices = let(_candidates(w, index), lambda c: _notices(w, c, table)).cast(kind)
        return F.when(F.arrays_overlap(w, _constant(sorted(posted), "array<string>")), notices).otherwise(F.array().cast(kind))

    looked_up = let(license_words(text_of()), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), found(w).alias("found")))
    return docs.select("id", F.inline(F.array(looked_up)))
