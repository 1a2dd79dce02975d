"""Operator 9, license scans by diagonal voting. DataFrame operations only.

All rolling word k-grams of all documents are hashed and joined to the positions
of the same hashes in license templates. A copy of a template puts its votes on
one offset diagonal (position in the document minus position in the template); an
inserted or missing word moves the rest to a neighbouring one, so near diagonals
are merged. Merged spans are then held against the template: how much of it they
cover, and how much longer they are.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

K = 3
#: Diagonals so close, in words, are one copy with words put in or left out.
NEAR = 4


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    coverage: float  # share of the template's k-grams that must be found
    base: bool = False


def template(label: str, text: str, coverage: float | None = None, base: bool = False) -> Template:
    words = tuple(re.findall(r"[0-9a-z]+", text.lower()))
    if len(words) < K:
        raise ValueError(f"a template has {K} words at least: {text!r}")
    return Template(label, words, coverage if coverage is not None else 1.0 if len(words) < 14 else 0.6, base)


# The base phrases and their labels.
BASE = (
    template("mit", "under the mit license", base=True),
    template("apache-2", "apache license version 2", base=True),
    template("cc-by-nc", "cc by nc", base=True),
)

# Short notices and opening passages of public licenses.
NOTICES = (
    template("mit", "the mit license mit"),
    template("mit", "spdx license identifier mit"),
    template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    template("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    template("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    template("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    template("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages"),
    template("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    template("apache-2", "licensed under the apache license 2 0"),
    template("apache-2", "spdx license identifier apache 2 0"),
    template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    template("gpl-2", "gnu general public license version 2"),
    template("gpl-3", "gnu general public license version 3"),
    template("gpl-2", "spdx license identifier gpl 2 0"),
    template("gpl-3", "spdx license identifier gpl 3 0"),
    template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    template("lgpl", "gnu lesser general public license"),
    template("agpl-3", "gnu affero general public license"),
    template("mpl-2", "mozilla public license version 2 0"),
    template("mpl-2", "mozilla public license v 2 0"),
    template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    template("bsd", "under the bsd license"),
    template("bsd-2-clause", "bsd 2 clause license"),
    template("bsd-3-clause", "bsd 3 clause license"),
    template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    template("unlicense", "this is free and unencumbered software released into the public domain"),
    template("cc0", "cc0 1 0 universal"),
    template("cc-by", "creative commons attribution 4 0 international"),
    template("cc-by-sa", "cc by sa"),
    template("cc-by-sa", "creative commons attribution sharealike"),
    template("cc-by-nc", "creative commons attribution noncommercial"),
    template("cc-by-nd", "cc by nd"),
)


def words_of(text: Column) -> Column:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased.

    ``lower`` is a fast built-in but also takes letters beyond A-Z; of those only
    U+212A and U+0130 would become ASCII, and they are put out of its way first.
    Whatever it does to other letters changes neither word borders nor matches.
    """
    plain = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("")), F.lit("İ"), F.lit(""))
    return F.array_remove(F.split(F.lower(plain), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _template_table(spark: SparkSession, templates: Sequence[Template]) -> DataFrame:
    """One row for each k-gram of each template, and one that every document's end mark meets."""
    rows = [(n, at, *t.words[at : at + K]) for n, t in enumerate(templates) for at in range(len(t.words) - K + 1)]
    grams = spark.createDataFrame(rows, "template int, at int, w0 string, w1 string, w2 string")
    return grams.select(F.xxhash64("w0", "w1", "w2").alias("hash"), "template", "at").union(spark.range(1).select(_end_mark().alias("hash"), F.lit(-1), F.lit(0)))


def _end_mark() -> Column:
    return F.xxhash64(F.lit(""), F.lit("end of document"))


def scan_licenses(docs: DataFrame, templates: Sequence[Template] = (*BASE, *NOTICES), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row ``key, n_words, places`` for each row of ``docs``.

    ``places`` holds ``struct<template, label, base, start, end, coverage>`` for
    every verified span, in words from 0, end exclusive, sorted by start; it is
    empty for null, empty and clean texts. A base phrase counts wherever its words
    stand consecutively; other templates count where merged diagonals cover the
    share of k-grams that they ask for within one and a half times their length;
    k-grams are the same where their 64-bit hashes are.
    Repeated rows come out as often as they went in; a null key is a key; other
    columns don't come out. An empty table gives an empty result.

    The template table has a row for each template word and is the only thing
    broadcast. Votes are grouped by document, template and diagonal, so no key
    gathers more than one document's hits.
    """
    spark = docs.sparkSession
    least = [t.coverage for t in templates]
    grams = [len(t.words) - K + 1 for t in templates]

    split = docs.select(docs[key].alias("key"), F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("tie"), words_of(docs[text]).alias("words"))
    # One lambda binds the words, so that the optimizer can't split the text anew for each k-gram.
    rolling = lambda ws: F.when(F.size(ws) >= K, F.transform(F.slice(ws, 1, F.size(ws) - (K - 1)), lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    both = let(F.col("words"), lambda ws: F.struct(F.size(ws).alias("n_words"), F.concat(rolling(ws), F.array(_end_mark())).alias("hashes")))
    hashed = split.select("key", "tie", both.alias("x")).select("key", "tie", "x.n_words", "x.hashes")
    votes = hashed.select("key", "tie", "n_words", F.posexplode("hashes").alias("pos", "hash")).join(F.broadcast(_template_table(spark, templates)), "hash")
    doc = ["key", "tie", "n_words"]
    # Repeated rows vote for the same places again: sets of template positions take each place once.
    diagonals = votes.groupBy(*doc, "template", F.when(F.col("template") >= 0, F.col("pos") - F.col("at")).otherwise(0).alias("diagonal")).agg(F.collect_set("at").alias("ats"), F.count("*").alias("votes"))
    per_doc = diagonals.groupBy(*doc).agg(
        F.max(F.when(F.col("template") < 0, F.col("votes"))).alias("copies"),
        F.array_sort(F.collect_list(F.when(F.col("template") >= 0, F.struct("template", "diagonal", "ats")))).alias("hits"),
    )
    # Neighbouring diagonals of a template in order: a gap begins a new span. Whole
    # phrases (coverage 1) are exact, their diagonals are never merged.
    of = lambda values, x: F.get(F.array(*[F.lit(v) for v in values]), x["template"])
    exact = [t.coverage >= 1.0 for t in templates]
    here, last = lambda i: F.get("hits", i - 1), lambda i: F.get("hits", i - 2)
    opens = F.filter(
        F.sequence(F.lit(1), F.size("hits")),
        lambda i: (i == 1) | (here(i)["template"] != last(i)["template"]) | of(exact, here(i)) | (here(i)["diagonal"] - last(i)["diagonal"] > NEAR),
    )
    starts = per_doc.select(*doc, "copies", "hits", F.when(F.size("hits") > 0, opens).otherwise(F.array().cast("array<int>")).alias("opens"))
    spans = let(F.col("opens"), lambda os: F.transform(os, lambda o, k: F.slice("hits", o, F.coalesce(F.get(os, k + 1), F.size("hits") + 1) - o)))
    merged = F.transform(
        spans,
        lambda s: F.struct(
            s[0]["template"].alias("template"),
            F.size(F.array_distinct(F.flatten(F.transform(s, lambda x: x["ats"])))).alias("found"),
            F.array_min(F.transform(s, lambda x: x["diagonal"] + F.array_min(x["ats"]))).alias("start"),
            (F.array_max(F.transform(s, lambda x: x["diagonal"] + F.array_max(x["ats"]))) + K).alias("end"),
        ),
    )
    held = F.filter(merged, lambda x: (x["found"] / of(grams, x) >= of(least, x)) & (x["end"] - x["start"] <= F.floor((of(grams, x) + K - 1) * 1.5)))
    places = F.transform(
        held,
        lambda x: F.struct(
            x["start"].cast("long").alias("start"),
            x["end"].cast("long").alias("end"),
            of([t.label for t in templates], x).alias("label"),
            of([t.base for t in templates], x).alias("base"),
            x["template"].alias("template"),
            (x["found"] / of(grams, x)).cast("double").alias("coverage"),
        ),
    )
    found = starts.select(*doc, "copies", F.array_sort(places).alias("places"))
    return found.select(F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))), "*").select(F.col("key").alias(key), F.col("n_words").cast("long").alias("n_words"), "places")

