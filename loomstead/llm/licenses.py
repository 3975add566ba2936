"""License scans by an exact set-similarity join (operator 5, DataFrame functions only).

Text blocks (the lines of a document and its paragraphs of several lines, so
that a notice may be wrapped) are joined with a fixed list of license templates. A block meets a template if it holds at least the threshold's share
of the template's distinct words. Template words are put in ascending order of
the number of blocks in the whole corpus that hold them. If s is a template's
size and a = ceil(threshold x s) the least overlap, a block that meets it holds
one of the template's first s - a + 1 words (prefix filter); it has at least a
words (length filter); and the first template word it holds leaves a words or
more of the template from there on (positional filter). What is left is
verified by intersecting the sets, and must hold the words that set the license
apart from others of nearly the same wording (NEEDS).

The templates are constants of this module, so their words may be broadcast.
The corpus is exploded only to the blocks that hold a prefix word.

Base labels are phrases whose words stand consecutively anywhere in the text.

Results for odd input: null and empty texts have no words, labels or places
and score 0; repeated rows give repeated results, rows of one doc_id share the
labels of all; null doc_ids are one document; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .line_dedup import LOWER, UPPER
from .scratch import texts

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Fixed values: (label, wording) of license statements.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution share alike 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("proprietary", "all rights reserved no part of this work may be reproduced without permission"),
]
# Words without which a wording means another license, whatever else it shares.
NEEDS = {
    "released under the mit license": ["mit"],
    "licensed under the apache license version 2 0": ["apache"],
    "you may not use this file except in compliance with the license": ["compliance"],
    "this work is licensed under the gnu general public license version 3": ["general", "gnu", "public"],
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": ["general", "gnu", "public"],
    "licensed under cc by nc 4 0": ["nc"],
    "licensed under a creative commons attribution share alike 4 0 international license": ["alike", "share"],
    "redistribution and use in source and binary forms with or without modification are permitted": ["binary", "redistribution"],
    "this source code form is subject to the terms of the mozilla public license": ["mozilla"],
    "all rights reserved no part of this work may be reproduced without permission": ["reserved", "rights"],
}
THRESHOLD = 0.8
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: What parts paragraphs: a line without a word.
GAP = r"\n[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\n"


def _lower(x) -> Column:
    return F.translate(x, UPPER, LOWER)


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _blocks(docs: DataFrame, wrapped: bool = False) -> DataFrame:
    """doc_id, line number and distinct words of every line with a word; with wrapped, of paragraphs of several lines too, numbered on after the lines."""
    blocks = F.split("text", "\n", -1)
    if wrapped:
        blocks = F.concat(blocks, F.filter(F.split("text", GAP, -1), lambda p: F.contains(p, F.lit("\n"))))
    lines = docs.select("doc_id", "uid", F.posexplode(blocks).alias("line", "block"))
    words = F.array_distinct(F.split(_lower("block"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1))
    return lines.select("doc_id", "uid", "line", words.alias("words"))


def ordered_templates(docs: DataFrame, templates=TEMPLATES) -> list[list[str]]:
    """Each template's distinct words, those in the fewest blocks of the corpus first."""
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    held = _blocks(docs).select(F.explode(F.array_intersect("words", _strings(vocabulary))).alias("word"))
    counts = {r.word: r["count"] for r in held.groupBy("word").count().collect()}  # one row per template word at most
    return [sorted(set(t.split()), key=lambda w: (counts.get(w, 0), w)) for _, t in templates]


def license_matches(docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES, wrapped: bool = False) -> DataFrame:
    """doc_id, line, template, label and containment of every block that meets a template; blocks as in _blocks."""
    spark = docs.sparkSession
    ordered = ordered_templates(docs, templates)
    least = [max(1, math.ceil(threshold * len(t) - 1e-9)) for t in ordered]
    prefix = [(w, i, p, len(t), a, t) for i, (t, a) in enumerate(zip(ordered, least, strict=True)) for p, w in enumerate(t[: len(t) - a + 1])]
    names = ("word", "template", "place", "size", "least")
    needs = lambda template: _strings(NEEDS.get(templates[template][1], [])).alias("needs")
    lines = [F.struct(*[F.lit(x).alias(n) for n, x in zip(names, p[:5], strict=True)], _strings(p[5]).alias("wording"), needs(p[1])) for p in prefix]
    table = spark.range(1).select(F.inline(F.array(*lines)))
    first_words = _strings(sorted({p[0] for p in prefix}))
    blocks = _blocks(docs, wrapped).where(F.arrays_overlap("words", first_words) & (F.size("words") >= min(least)))
    seeds = blocks.withColumn("word", F.explode(F.array_intersect("words", first_words)))
    near = seeds.join(F.broadcast(table), "word").where((F.size("words") >= F.col("least")) & (F.col("size") - F.col("place") >= F.col("least")))
    overlap = F.size(F.array_intersect("words", "wording"))
    met = near.withColumn("overlap", overlap).where("overlap >= least").where(F.size(F.array_except("needs", "words")) == 0)
    met = met.groupBy("doc_id", "uid", "line", "template").agg(F.max(F.col("overlap") / F.col("size")).alias("containment"))
    label = F.get(_strings([x for x, _ in templates]), F.col("template"))
    return met.select("doc_id", "line", "template", label.alias("label"), "containment")


def _places(phrase: list[str], label: str) -> Column:
    """Structs (at, label, length) of where the phrase's words stand one after another in the column words."""
    last = F.size("words") - len(phrase)

    def stands(i):
        ok = F.get("words", i) == phrase[0]
        for j in range(1, len(phrase)):
            ok = ok & (F.get("words", i + j) == phrase[j])
        return ok

    starts = F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), stands)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label"), F.lit(len(phrase)).alias("length")))


def license_report(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Words, places of base phrases, labels and score of every document."""
    rows = texts(docs)
    found = license_matches(rows, threshold, wrapped=True).groupBy(F.col("doc_id").alias("found_id")).agg(F.collect_set("label").alias("found"), F.max("containment").alias("containment"))
    low = _lower("text")
    words = F.regexp_extract_all(low, F.lit(WORD), F.lit(0))
    none = F.array().cast("array<struct<at:int,label:string,length:int>>")
    places = [_places(phrase.split(), label) for phrase, label in PHRASES.items()]
    rows = rows.select("doc_id", F.regexp_count("text", F.lit(WORD_ANY_CASE)).cast("long").alias("n_words"), F.when(F.contains(low, F.lit("license")), words).alias("words"))
    rows = rows.select("doc_id", "n_words", F.when(F.col("words").isNotNull(), F.concat(*places)).otherwise(none).alias("base"))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")), "left")
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    labels = F.array_sort(F.array_union(base_labels, F.coalesce("found", F.array().cast("array<string>"))))
    at = F.transform("base", lambda b: b["at"].cast("long"))
    score = F.greatest(F.coalesce("containment", F.lit(0.0)), F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return joined.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"),
    )
