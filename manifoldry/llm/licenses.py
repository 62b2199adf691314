"""License scans by MinHash bands over overlapping text windows, in DataFrame functions only.

Texts are words of ASCII letters and digits, in lower case, and five-word shingles. For templates of each length, windows about twice as long with half a window's
step hold any such template whole in at least one. A window that holds the share `contained` of a template's shingles has a similarity to it of at least that of `least_similarity`,
between 0.25 and 0.4 for the share of 0.8, and the number of one-row bands is set so that such a pair meets in none of them with a probability of MISS at most. A collision needs a shared
shingle, so windows without any template shingle are left out beforehand and nothing is lost. Matches are then verified by the exact share of the template's
shingles that stand in the text around the window.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
CONTAINED = 0.8
#: Highest probability that a window and a template that it holds meet in no band.
MISS = 1e-4

# Notices and headers of public licenses.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    (
        "MIT",
        'The Software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. '
        "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software "
        "or the use or other dealings in the Software.",
    ),
    (
        "BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    (
        "AGPL-3.0",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "BSL-1.0",
        "Distributed under the Boost Software License, Version 1.0.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this "
        "software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    ),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _shingles(words: Column) -> Column:
    """Hashes of the shingles; fewer words: none. A one-element array binds the words to a variable: they are made once a row, not once a shingle."""
    each = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(SHINGLE))))
    bound = F.transform(F.array(words), lambda w: F.when(F.size(w) >= SHINGLE, each(w)).otherwise(F.array().cast("array<bigint>")))
    return F.get(bound, F.lit(0))


def _bands(shingles: Column, bands: int) -> Column:
    """The least of each band's hashes of the shingles."""
    def hashed(b: int):
        return lambda x: F.xxhash64(x, F.lit(b))

    return F.array(*(F.struct(F.lit(b).alias("band"), F.array_min(F.transform(shingles, hashed(b))).alias("least")) for b in range(bands)))


def _span(words: int) -> int:
    """The window length of templates of so many words: a multiple of 8, with the template in at most half a window and one word."""
    return max(8, 8 * -(-2 * (words - 1) // 8))


def least_similarity(words: int, contained: float) -> float:
    """The least Jaccard similarity of a template of so many words, all shingles distinct, and a window that holds the share `contained` of its shingles."""
    n, window = words - SHINGLE + 1, _span(words) - SHINGLE + 1
    held = math.ceil(contained * n - 1e-9)
    return held / (n + window - held)


def n_bands(lengths: list[int], contained: float) -> int:
    """Bands enough for templates of these lengths."""
    worst = min(least_similarity(n, contained) for n in lengths)
    return 1 if worst >= 1 else math.ceil(math.log(MISS) / math.log(1 - worst))


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(template, license, span, words, shingles): a stated list, small enough to send to every task. templates: pairs of a license and a text, or a table with these columns."""
    if isinstance(templates, DataFrame):
        templates = sorted((r.license, r.text) for r in templates.select("license", "text").collect())
    rows = []
    for i, (name, text) in enumerate(templates):
        n = len(re.findall("[a-z0-9]+", text.lower()))
        if n < SHINGLE:
            raise ValueError(f"template {i} has under {SHINGLE} words")
        rows.append((i, name, text, _span(n), n))
    made = spark.createDataFrame(rows, "template int, license string, text string, span int, words int")
    return made.select("template", "license", "span", "words", F.array_distinct(_shingles(_words(F.col("text")))).alias("shingles"))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, contained: float = CONTAINED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, template, contained, from_word, to_word): every template that a text holds to a share of `contained` of its shingles or more.

    One row a text and template, for the window of largest share (the first of these), with the words from the first to the last of its shingles around that window. templates: pairs of a
    license and a text, or a table of these. Null, empty and short texts hold nothing; long ones are scanned whole. Null ids are kept as null. Repeated rows of one id and text give one row. Other
    columns are not read. Empty table or no templates: empty result.
    """
    spark = docs.sparkSession
    table = template_table(spark, templates)
    # a stated list of a few templates: its shingles are constants of the plan
    known = [(r.template, r.license, r.span, list(r.shingles), r.words) for r in table.collect()]
    bands = n_bands([x[4] for x in known], contained) if known else 1
    longs = lambda values: F.array(*(F.lit(v).cast("bigint") for v in sorted(values)))
    every = longs({s for _, _, _, x, _ in known for s in x}) if known else F.array().cast("array<bigint>")
    text = F.col(f"`{text_col}`")
    held = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("k"), _shingles(_words(text)).alias("s")).where(F.arrays_overlap("s", every)).dropDuplicates(["doc_id", "k"])
    least = table.select("template", "license", "span", "shingles", F.explode(_bands(F.col("shingles"), bands)).alias("b")).select("template", "license", "span", "shingles", "b.band", "b.least")
    of_span = {span: longs({s for _, _, sp, x, _ in known if sp == span for s in x}) for span in sorted({x[2] for x in known})}
    # only window lengths for which the text holds a shingle of some template, and of those only windows that do
    able = F.filter(F.array(*(F.when(F.arrays_overlap("s", some), F.lit(span)) for span, some in of_span.items())).cast("array<int>"), lambda x: x.isNotNull())
    cut = held.select("doc_id", "k", "s", F.explode(able).alias("span"))
    cut = cut.select("doc_id", "k", "s", "span", F.explode(F.sequence(F.lit(0), F.size("s") - 1, (F.col("span") / 2).cast("int"))).alias("at"))
    cut = cut.withColumn("window", F.slice("s", F.col("at") + 1, F.col("span") - SHINGLE + 1))
    near = F.lit(False)
    for span, some in of_span.items():
        near = near | ((F.col("span") == span) & F.arrays_overlap("window", some))
    begin = F.greatest(F.col("at") - F.col("span"), F.lit(0))
    sent = cut.where(near).select("doc_id", "k", "span", "at", begin.alias("begin"), F.slice("s", begin + 1, F.col("span") * 3).alias("around"), F.explode(_bands(F.col("window"), bands)).alias("b"))
    met = sent.select("doc_id", "k", "span", "at", "begin", "around", "b.band", "b.least").join(F.broadcast(least), ["span", "band", "least"]).dropDuplicates(["doc_id", "k", "template", "at"])
    share = F.size(F.array_intersect("shingles", "around")) / F.size("shingles")
    found = met.withColumn("contained", share).where(F.col("contained") >= contained)
    there = F.filter(F.sequence(F.lit(0), F.size("around") - 1), lambda i: F.array_contains(F.col("shingles"), F.get("around", i)))
    placed = found.withColumn("there", there).select("doc_id", "k", "template", "license", F.struct("contained", (-F.col("at")).alias("back"), (F.col("begin") + F.array_min("there")).alias("lo"), (F.col("begin") + F.array_max("there") + SHINGLE).alias("hi")).alias("m"))
    best = placed.groupBy("doc_id", "k", "template", "license").agg(F.max("m").alias("m"))
    return best.select("doc_id", "license", "template", F.col("m.contained").alias("contained"), F.col("m.lo").cast("long").alias("from_word"), F.col("m.hi").cast("long").alias("to_word"))
