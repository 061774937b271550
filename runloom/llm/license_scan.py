"""License scans by an exact set-similarity join, in DataFrame functions only.

A text is folded (A-Z to a-z) and cut into words (runs of digits, letters and non-ASCII characters). Its blocks are
windows of a number of words, one starting every half of that (``SCALES``), so that any passage of up to half a block lies whole in one. A template
is sought in the blocks of the first scale whose half is as long as it.
A block matches a template when it holds at least ``threshold`` of the template's distinct words (containment), and all of its
words that name the license (``NAMING``).

The join is exact. Template words are ordered by the number of documents that hold them, rarest first. A template of m words
of which t are needed is indexed by its first m - t + 1 words only (prefix filter): a matching block must hold one of
them. Blocks with fewer than t template words are passed over (length filter), and so are pairs whose first
common word leaves too few words on either side (positional filter); what remains is counted in full.

Exact phrases give base labels and places beside it. ``score`` is the largest containment found, 1 where a base phrase stands.

Defined results: null and empty texts have no words, places or labels and score 0; rows that share an id (null included) or all they hold are each
judged by their own text; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialise

SCALES, THRESHOLD = ((48, 24), (160, 80)), 0.8

# Base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Statements by which works name their license, short ones and the notices that license texts ask for.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"
     " you may obtain a copy of the license at"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
     " the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish"
     " distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as"
     " published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"
     " as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with"
     " this file you can obtain one at"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that"
     " the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile"
     " sell or distribute this software"),
    ("reserved", "no part of this publication may be reproduced without the prior written permission of the publisher"),
)

# Words by which a license is told from others, by label: a block matches only with those of them that its template has.
NAMING = {
    "apache": "apache", "mit": "mit", "gpl": "gnu general", "lgpl": "lesser", "mpl": "mozilla",
    "cc-by": "creative commons attribution", "cc-by-nc": "cc by nc", "bsd": "redistribution binary forms", "isc": "permission fee",
    "unlicense": "unencumbered public domain", "reserved": "reproduced publication",
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def folded(text: Column) -> Column:
    """The words of a text with one space between them."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), _GAPS, " "))


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _places(padded: Column, phrase: str) -> tuple[Column, Column, Column]:
    """(number, first word, last word) of the places of a phrase in a text with a space around each word."""
    key, there = f" {phrase} ", padded.contains(f" {phrase} ")
    at = F.instr(padded, key)
    back = F.length(padded) - F.instr(F.reverse(padded), key[::-1]) + 2 - len(key)
    index = lambda pos: _spaces(F.substring(padded, F.lit(1), pos)) - 1
    count = F.when(there, F.regexp_count(padded, F.lit(f"(?<= ){phrase}(?= )"))).otherwise(0)
    return count.cast("bigint"), F.when(there, index(at)).cast("bigint"), F.when(there, index(back)).cast("bigint")


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD,
) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), folded(F.col(text_col)).alias("s"))
    rows = rows.withColumn("words", F.when(F.col("s") == "", F.array().cast("array<string>")).otherwise(F.split("s", " ")))
    vocabulary = sorted({w for _, t in templates for w in t.split()})  # bounded by the templates
    held = rows.select(F.explode(F.array_intersect("words", F.lit(vocabulary))).alias("word")).groupBy("word").count()
    seen = {r[0]: r[1] for r in held.collect()}  # at most one row for each template word
    order = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for label, text in templates:
        t = sorted(set(text.split()), key=rank.get)
        need = max(1, math.ceil(threshold * len(t) - 1e-9))
        must = [w for w in NAMING.get(label, "").split() if w in t]
        scale = next((i for i, x in enumerate(SCALES) if len(text.split()) <= x[1]), len(SCALES) - 1)
        index += [(w, scale, i, label, need, t, must) for i, w in enumerate(t[: len(t) - need + 1])]
    prefix = sorted({x[0] for x in index})

    padded = F.concat(F.lit(" "), F.col("s"), F.lit(" "))
    found = [(label, *_places(padded, phrase)) for phrase, label in PHRASES]
    firsts, lasts = [x[2] for x in found], [x[3] for x in found]
    base = materialise(
        rows.select(
            "doc_id", F.monotonically_increasing_id().alias("row"), F.size("words").cast("bigint").alias("n_words"),
            sum((x[1] for x in found), F.lit(0).cast("bigint")).alias("n_base"),
            F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"),
            F.array_compact(F.array(*(F.when(x[1] > 0, F.lit(x[0])) for x in found))).alias("base"),
            F.when(F.arrays_overlap("words", F.lit(prefix)), F.col("words")).alias("words"),
        ),
        "licenses",
    )

    def held(size: int, step: int) -> Column:
        starts = F.sequence(F.lit(0), F.size("words") - 1, F.lit(step))
        return F.transform(starts, lambda i: F.array_intersect(F.lit(order), F.slice("words", i + 1, size)))

    some = base.where("words is not null")
    parts = [some.select("row", F.lit(i).alias("scale"), F.explode(held(*x)).alias("held")) for i, x in enumerate(SCALES)]
    block = reduce(DataFrame.union, parts)
    table = spark.createDataFrame(index, "word string, scale int, i int, label string, need int, tokens array<string>, must array<string>")
    hits = block.select("row", "scale", "held", F.size("held").alias("b"), F.posexplode("held").alias("j", "word")).join(F.broadcast(table), ["word", "scale"])  # a row for each prefix word of a template
    hits = hits.where("b >= need and 1 + least(size(tokens) - i - 1, b - j - 1) >= need")
    hits = hits.withColumn("overlap", F.size(F.array_intersect("held", "tokens"))).where("overlap >= need")
    hits = hits.where("size(array_except(must, held)) = 0")
    hits = hits.groupBy("row").agg(
        F.collect_set("label").alias("more"), F.max(F.col("overlap") / F.size("tokens")).alias("best")
    )
    out = base.drop("words").join(hits, "row", "left")
    none = F.array().cast("array<string>")
    join = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", join(F.col("base")).alias("base_labels"),
        join(F.concat("base", F.coalesce("more", none))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
