"""License scans: rolling word hashes joined to the positions of templates, votes by diagonal, verified spans. DataFrame only."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, let, text_column

#: Phrases whose places are counted, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: What separates words, after A-Z are lower-cased.
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Labels and wordings of public licenses and of notices that name them.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
]
#: Templates are a table of this many words at most, which every executor holds.
MOST_WORDS = 1 << 20
#: Shorter templates have to stand whole: in a notice of a few words each of them tells licenses apart.
WHOLE_BELOW = 20


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), APART), "")


def rolling(words: Column, k: int) -> Column:
    """A 64-bit hash of each k neighbouring words, in order; none for fewer words."""

    def grams(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - k), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))

    return F.when(F.size(words) >= k, let(F.transform(words, lambda w: F.xxhash64(w)), grams)).otherwise(F.array().cast("array<bigint>"))


def phrase_places(words: Column, phrases: dict[str, str]) -> Column:
    """array<struct<at:int,label:string>> of the places where the words of a phrase stand one after the other."""

    def at(i: Column, phrase: list[str]) -> Column:
        fits = F.get(words, i) == phrase[0]
        for j, w in enumerate(phrase[1:], 1):
            fits = fits & F.coalesce(F.get(words, i + j) == w, F.lit(False))
        return fits

    def places(phrase: str, label: str) -> Column:
        found = F.filter(F.transform(words, lambda w, i: F.when(at(i, phrase.split(" ")), i)), lambda i: i.isNotNull())
        here = F.transform(found, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))
        return F.when(F.arrays_overlap(words, F.array(F.lit(phrase.split(" ")[0]))), here).otherwise(F.array().cast("array<struct<at:int,label:string>>"))

    return F.concat(*[places(p, label) for p, label in phrases.items()])


def template_table(spark: SparkSession, templates: list[tuple[str, str]], k: int, share: float) -> DataFrame:
    """(t, label, words, size, share) of the templates; those of fewer than k words can't be found and are refused."""
    given = json.dumps([{"t": i, "label": label, "text": text} for i, (label, text) in enumerate(templates)])
    rows = spark.range(1).select(F.inline(F.from_json(F.lit(given), "array<struct<t:int,label:string,text:string>>")))
    rows = rows.select("t", "label", words_of(F.col("text")).alias("words")).withColumn("size", F.size("words"))
    rows = rows.withColumn("share", F.when(F.col("size") < WHOLE_BELOW, 1.0).otherwise(share))
    least, total = rows.agg(F.min("size"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if templates and (least < k or total > MOST_WORDS):
        raise ValueError(f"templates of {k} words or more, and of {MOST_WORDS} words in all at most")
    return rows


def diagonals(texts: DataFrame, templates: DataFrame, k: int) -> DataFrame:
    """texts(id, key, words) -> (id, key, t, d, first, last, votes): k-grams that a text and a template share, by the offset d of
    their places. Each place of a template is a bit, so rows equal in id and text give one result and don't vote twice."""
    places = templates.select("t", F.posexplode(rolling(F.col("words"), k)).alias("p", "h"))
    grams = texts.select("id", "key", F.posexplode(rolling(F.col("words"), k)).alias("at", "h"))
    hits = grams.join(F.broadcast(places), "h")  # MOST_WORDS rows at most
    part = hits.groupBy("id", "key", "t", (F.col("at") - F.col("p")).alias("d"), F.floor(F.col("p") / 64).alias("block")).agg(
        F.bit_or(F.expr("shiftleft(1L, p % 64)")).alias("bits"), F.min("at").alias("first"), F.max("at").alias("last"))
    return part.groupBy("id", "key", "t", "d").agg(F.sum(F.bit_count("bits")).alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"))


def candidates(votes: DataFrame, templates: DataFrame, k: int, gap: int) -> DataFrame:
    """(id, key, spans): offsets that differ by `gap` and a quarter of the template at most are merged into spans.

    Each word that differs costs k votes at most and each change of offset k - 1, so that a span with fewer votes than the
    share leaves goes; the others are verified.
    """
    line = Window.partitionBy("id", "key", "t").orderBy("d")
    near = F.col("d") - F.lag("d").over(line) <= F.least(F.lit(gap), F.floor(F.col("size") / 4))
    group = F.sum(F.when(near, 0).otherwise(1)).over(line.rowsBetween(Window.unboundedPreceding, 0))
    sized = votes.join(F.broadcast(templates.select("t", "size", "share")), "t")  # MOST_WORDS / k rows at most
    merged = sized.withColumn("g", group).groupBy("id", "key", "t", "g").agg(
        F.first("size").alias("size"), F.first("share").alias("share"), F.sum("votes").alias("votes"), F.min("first").alias("start"), (F.max("last") + k).alias("stop"), F.sort_array(F.collect_list("d")).alias("offsets"))
    least = F.col("size") - k + 1 - k * F.floor((1 - F.col("share")) * F.col("size") + 1e-9)
    fit = merged.where(F.col("votes") + (k - 1) * (F.size("offsets") - 1) >= least)
    return fit.groupBy("id", "key").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "t", "offsets"))).alias("spans"))


def verified(words: Column, spans: Column, table: Column) -> Column:
    """array<struct<start,stop,label,share>>: spans in which at least its share of a template's words stand at one of its offsets."""

    def one(s: Column) -> Column:
        template = F.get(table, s["t"])
        same = lambda w, i: F.exists(s["offsets"], lambda d: F.coalesce(F.get(words, i + d) == w, F.lit(False)))
        found = F.size(F.filter(template["words"], same)) / F.size(template["words"])
        return F.struct(s["start"].alias("start"), s["stop"].alias("stop"), template["label"].alias("label"), found.alias("share"), template["share"].alias("least"))

    good = F.filter(F.transform(spans, one), lambda s: s["share"] >= s["least"] - 1e-9)
    return F.transform(good, lambda s: s.dropFields("least"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, k: int = 4, gap: int = 8, share: float = 0.8) -> DataFrame:
    """(id_col, n_words, places, found) for every row: places of phrases, and spans that repeat a template.

    places is array<struct<at,label>>, found array<struct<start,stop,label,share>> in words from 0, stop exclusive. All k-grams
    of all texts are joined to the templates' by hash; hits vote for the offset between the two places; offsets that differ by
    `gap` words or less (and by a quarter of the template or less), as insertions and deletions leave them, make one span; a span counts if at least `share` of the
    template's words (all, below WHOLE_BELOW words) stand at one of its offsets. A null text is empty. Rows stay as often as they come; a null id is like any
    other. Other columns aren't read.
    """
    spark = docs.sparkSession
    known = template_table(spark, templates, k, share)
    rows = docs.select(docs[id_col].cast("long").alias("id"), text_column(docs, text_col).alias("text"))
    rows = rows.select("id", F.xxhash64("text", F.length("text")).alias("key"), words_of(F.col("text")).alias("words"))
    spans = keep(candidates(diagonals(rows, known, k), known, k, gap), "license_spans")
    spans = spans.withColumnsRenamed({"id": "_id", "key": "_key"})
    table = known.agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "label", "words", "share"))), lambda x: x.dropFields("t")).alias("table"))
    joined = rows.join(spans, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left").crossJoin(F.broadcast(table))  # one row
    none = F.array().cast("array<struct<start:int,stop:int,label:string,share:double>>")
    found = F.when(F.col("spans").isNotNull(), verified(F.col("words"), F.col("spans"), F.col("table"))).otherwise(none)
    return joined.select(F.col("id").alias(id_col), F.size("words").cast("long").alias("n_words"), phrase_places(F.col("words"), phrases).alias("places"), found.alias("found"))
