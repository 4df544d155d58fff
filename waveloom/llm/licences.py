"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates.

DataFrame operations only.  A multinomial logistic regression over sparse word n-grams (1 to 3 words,
vocabulary: the n-grams of the templates) is fitted here on templates, crops of them, and paragraphs of
the corpus that no template confirms, as the class 'unknown'.  A second regression calibrates the margin
over 'unknown' into a probability.  A prediction counts only if the paragraph also shares enough of its
word triples with a template of that family; so paragraphs without any such triple need no prediction,
and that alone decides which are looked at.

A paragraph is a line, or several where a triple of a template runs across the line breaks, so that a
wrapped notice is judged as one and two notices on neighbouring lines as two.

Defined results: a null or empty text has no paragraph and the family 'none'; repeated rows each get
their result, and rows with one id and different texts each get that of their own text; columns of the
input other than id and text are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, sampled_texts, store

# What notices of each licence family say.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license. See LICENSE in the project root for license information.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability.",
        "SPDX-License-Identifier: MIT",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Released under the GNU GPL version 2 or later.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "Released under the GNU LGPL version 2.1 or later.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "SPDX-License-Identifier: LGPL-3.0-only",
    ],
    "AGPL": [
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU AGPL version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under the BSD 3-Clause License.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "Boost": [
        "Distributed under the Boost Software License, Version 1.0.",
        "See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License Version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC": [
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 3.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This text is available under the Creative Commons Attribution-ShareAlike License.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0.",
    ],
    "reserved": [
        "All rights reserved.",
        "Copyright 2020 the authors. All rights reserved.",
        "No part of this publication may be reproduced or transmitted in any form without the prior written permission of the copyright holder.",
    ],
}
FAMILIES = [*sorted(TEMPLATES), "unknown"]
#: Bounds of the fit: texts and paragraphs of the corpus for the class 'unknown'.
FIT_TEXTS, FIT_PARAGRAPHS = 400, 3000
#: A paragraph counts from this probability on, and from this share of a template's triples or its own.
LEAST_SCORE, LEAST_SHARED = 0.5, 0.5


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def ngrams(tokens: str | Column, n: int) -> Column:
    """Runs of n words; fewer words give none."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    last = F.size(tokens) - n
    # get() looks at one place of the array, where slice() would walk all of it
    run = lambda i: F.concat_ws(" ", *[F.get(tokens, i + k) for k in range(n)])
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), run)).otherwise(F.array().cast("array<string>"))


def _features(tokens: str) -> Column:
    return F.concat(*[ngrams(tokens, n) for n in (1, 2, 3)])


def _triples_of(text: str) -> set[str]:
    found = re.findall(r"[^\W_]+", text.lower())
    return {" ".join(found[i : i + 3]) for i in range(len(found) - 2)}


#: All triples of the templates.
KNOWN = sorted({t for texts in TEMPLATES.values() for text in texts for t in _triples_of(text)})


def _alternatives(words: dict[str, str]) -> str:
    """A pattern for any of the words, each followed by its own pattern; equal beginnings are tried once."""
    by_first: dict[str, dict[str, str]] = {}
    for word, then in words.items():
        by_first.setdefault(word[:1], {})[word[1:]] = then
    parts = [c + _alternatives(rest) if c else rest[""] for c, rest in sorted(by_first.items(), reverse=True)]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def _pattern(triples: list[str]) -> str:
    """Matches a lower-case text that holds any of the triples."""
    letter, gap = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]++"
    tree: dict[str, dict[str, dict[str, str]]] = {}
    for a, b, c in map(str.split, triples):
        tree.setdefault(a, {}).setdefault(b, {})[c] = f"(?!{letter})"
    return f"(?<!{letter})" + _alternatives({a: gap + _alternatives({b: gap + _alternatives(cs) for b, cs in bs.items()}) for a, bs in tree.items()})


def _held(tokens: str | Column) -> Column:
    """Whether the words hold any triple of a template: without one, nothing can be confirmed."""
    return F.arrays_overlap(ngrams(tokens, 3), F.array(*map(F.lit, KNOWN)))


def templates(spark: SparkSession) -> DataFrame:
    """family, template, words of each template: a small table of fixed size."""
    rows = [(family, k, text) for family, texts in sorted(TEMPLATES.items()) for k, text in enumerate(texts)]
    return spark.createDataFrame(rows, "family string, template int, text string").withColumn("words", words(F.col("text")))


def _crops(known: DataFrame) -> DataFrame:
    """Each template whole, and its beginnings and ends of three quarters and a half (five words at least)."""
    n = F.size("words")
    sizes = F.array_distinct(F.array(n, *[F.greatest(F.least(n, F.lit(5)), F.ceil(n * s).cast("int")) for s in (0.75, 0.5)]))
    cut = known.withColumn("k", F.explode(sizes)).withColumn("at", F.explode(F.array_distinct(F.array(F.lit(1), n - F.col("k") + 1))))
    return cut.select("family", F.expr("slice(words, at, k)").alias("words"))


def fit(docs: DataFrame) -> dict:
    """Weights by n-gram and family, intercepts, and the calibration (slope, offset) of the margin."""
    spark = docs.sparkSession
    known = store(templates(spark), "licence-templates")
    vocabulary = sorted(r["f"] for r in known.select(F.explode(_features("words")).alias("f")).distinct().collect())  # bounded by TEMPLATES
    everyone = docs.select("doc_id").withColumn("any", F.lit(1))
    some = sampled_texts(docs, everyone, F.lit(True), FIT_TEXTS, "licences")
    prose = some.select(F.explode(F.transform(F.split("text", "\n"), words)).alias("words")).filter(F.size("words") > 0).distinct()
    prose = prose.orderBy(F.xxhash64(F.array_join("words", " ")), "words").limit(FIT_PARAGRAPHS).withColumn("row", F.monotonically_increasing_id())
    prose = prose_ = store(prose, "licence-prose")
    # what the templates confirm is no example of 'unknown'; all else is, however much it sounds like a notice
    sure = shared(prose, ["row"]).filter(F.col("shared") >= LEAST_SHARED)
    prose = prose.join(sure, "row", "left_anti").select(F.lit("unknown").alias("family"), "words")
    # single words of the templates in other company are unknown as well
    loose = _crops(known).select(F.lit("unknown").alias("family"), F.filter("words", lambda w, i: i % 4 == 0).alias("words"))
    rows = _crops(known).withColumn("weight", F.lit(10.0)).unionByName(prose.withColumn("weight", F.lit(1.0))).unionByName(loose.withColumn("weight", F.lit(2.0)))
    rows = rows.withColumn("label", F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("family")).cast("double") - 1)
    rows = store(rows.withColumn("features_", _features("words")).coalesce(2), "licence-training")  # small: bounded above
    counted = CountVectorizerModel.from_vocabulary(vocabulary, "features_", "features", minTF=1.0)
    ready = counted.transform(rows)
    half = F.pmod(F.xxhash64(F.array_join("words", " ")), F.lit(2)) == 0
    settings = dict(regParam=1e-3, maxIter=25, weightCol="weight")

    def linear(data: DataFrame) -> tuple[dict, list]:
        model = LogisticRegression(family="multinomial", **settings).fit(data)
        matrix, names = model.coefficientMatrix.toArray(), range(model.numClasses)
        weights = {g: [float(matrix[c, j]) if c in names else 0.0 for c in range(len(FAMILIES))] for j, g in enumerate(vocabulary)}
        return weights, [float(x) for x in model.interceptVector] + [-30.0] * (len(FAMILIES) - model.numClasses)

    # the margin is calibrated on rows that its model has not seen; the final weights come from all rows
    weights, intercepts = linear(ready.filter(half))
    margin = scored(rows.filter(~half).withColumn("id", F.monotonically_increasing_id()), weights, intercepts, ["id", "label", "weight"])
    margins = margin.select("margin", "weight", (F.col("label") < len(FAMILIES) - 1).cast("double").alias("y")).collect()  # bounded as the training rows are
    slope, offset = _platt([(r["margin"], r["y"], r["weight"]) for r in margins])
    weights, intercepts = linear(ready)
    for table in (known, prose_, rows):
        discard(table)
    return {"weights": weights, "intercepts": intercepts, "slope": slope, "offset": offset}


def _platt(rows: list[tuple[float, float, float]]) -> tuple[float, float]:
    """Logistic fit of one number by gradient steps; smoothed targets keep the slope finite."""
    if not rows or len({y for _, y, _ in rows}) < 2:
        return 1.0, 0.0
    slope, offset, total = 1.0, 0.0, sum(w for *_, w in rows)
    for _ in range(400):
        gs = go = 0.0
        for x, y, w in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, slope * x + offset))))
            err = w * (p - (0.98 * y + 0.01)) / total
            gs, go = gs + err * x, go + err
        slope, offset = slope - 0.05 * gs, offset - 0.5 * go
    return max(slope, 0.05), offset


def scored(rows: DataFrame, weights: dict, intercepts: list, keep: list[str]) -> DataFrame:
    """keep.., family, margin (best family over unknown) of rows with an array `words`; keep[0] identifies a row."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(g, w) for g, w in weights.items()], "gram string, w array<double>")
    # the table has a row for each n-gram of the templates
    hits = rows.select(*keep, F.explode_outer(_features("words")).alias("gram")).join(F.broadcast(table), "gram", "left")
    sums = [F.coalesce(F.sum(F.col("w")[c]), F.lit(0.0)) + F.lit(intercepts[c]) for c in range(len(FAMILIES))]
    each = hits.groupBy(*keep).agg(F.array(*sums).alias("logits"))
    named = F.slice("logits", 1, len(FAMILIES) - 1)
    best = F.array_max(named)
    family = F.element_at(F.array(*map(F.lit, FAMILIES)), F.array_position(named, best).cast("int"))
    return each.select(*keep, family.alias("family"), (best - F.element_at("logits", len(FAMILIES))).alias("margin"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), row (a number of the input row), paragraph (its first line), words: paragraphs
    that hold a triple of a template."""
    # words come out of a generator, so that no later step computes them again
    # one pattern finds the texts that hold a triple, as splitting all texts into triples takes ten times as long
    some = docs.filter(F.lower("text").rlike(_pattern(KNOWN)))
    whole = some.select("doc_id", "text", F.xxhash64("text").alias("digest"), F.explode(F.array(words(F.col("text")))).alias("words")).filter(_held("words"))
    lines = F.explode(F.array(F.transform(F.split("text", "\n"), words))).alias("lines")
    whole = whole.select("doc_id", "digest", F.monotonically_increasing_id().alias("row"), lines)
    # the words on both sides of a line break, for the lines that have words
    before = lambda i: F.slice(F.get("lines", i - 1), -2, 2)
    tail = lambda i: F.when(F.size(F.get("lines", i - 1)) > 1, before(i)).otherwise(F.get("lines", i - 1))
    across = lambda i: F.concat(tail(i), F.slice(F.get("lines", i), 1, 2))
    joins = lambda i: (i > 0) & (F.size(F.get("lines", i - 1)) > 0) & (F.size(F.get("lines", i)) > 0) & _held(across(i))
    lines = F.transform("lines", lambda w, i: F.struct(i.alias("line"), w.alias("words"), F.coalesce(joins(i), F.lit(False)).alias("goes_on")))
    each = whole.select("doc_id", "digest", "row", F.inline(lines))
    # a paragraph is named by its first line
    in_order = W.partitionBy("row").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    each = each.withColumn("paragraph", F.max(F.when(~F.col("goes_on"), F.col("line"))).over(in_order))
    joined = each.groupBy("doc_id", "digest", "row", "paragraph").agg(F.sort_array(F.collect_list(F.struct("line", "words"))).alias("parts"))
    joined = joined.withColumn("words", F.flatten(F.transform("parts", lambda p: p["words"]))).drop("parts")
    return joined.filter(_held("words"))


def shared(rows: DataFrame, keep: list[str]) -> DataFrame:
    """keep.., family, shared: the largest part of a template's triples, or of the row's, found in the other."""
    triples = lambda c: F.array_distinct(ngrams(c, 3))
    known = templates(rows.sparkSession).select("family", "template", triples("words").alias("all"))
    known = known.select("family", "template", F.size("all").alias("most"), F.explode("all").alias("triple"))
    mine = rows.select(*keep, triples("words").alias("all")).select(*keep, F.size("all").alias("own"), F.explode("all").alias("triple"))
    # the table has a row for each triple of the templates
    met = mine.join(F.broadcast(known), "triple").groupBy(*keep, "family", "template", "most", "own").agg(F.count("*").alias("n"))
    part = F.greatest(F.col("n") / F.col("most"), F.col("n") / F.col("own"))
    return met.groupBy(*keep, "family").agg(F.max(part).alias("shared"))


def scan(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """doc_id, digest, row, paragraph, family, score, shared, confirmed for each paragraph that can name a licence."""
    model = fit(docs) if model is None else model
    found = store(paragraphs(docs), "licence-paragraphs")
    keys = ["doc_id", "digest", "row", "paragraph"]
    predicted = scored(found, model["weights"], model["intercepts"], keys)
    margin = F.lit(model["slope"]) * F.col("margin") + F.lit(model["offset"])
    predicted = predicted.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), margin)))))
    both = predicted.join(shared(found, ["row", "paragraph"]), ["row", "paragraph", "family"], "left").withColumn("shared", F.coalesce("shared", F.lit(0.0)))
    confirmed = (F.col("score") >= LEAST_SCORE) & (F.col("shared") >= LEAST_SHARED)
    return both.select(*keys, "family", "score", "shared", confirmed.alias("confirmed"))


def contract(docs: DataFrame) -> DataFrame:
    """doc_id, family (of the surest confirmed paragraph; 'none' without one), score, n_paragraphs, families of every document."""
    named = scan(docs).filter("confirmed")
    each = named.groupBy("doc_id", "digest").agg(
        F.max_by("family", F.struct("score", "family")).alias("family"),
        F.max("score").alias("score"),
        F.countDistinct("paragraph").alias("n_paragraphs"),
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"),
    )
    each = each.withColumnsRenamed({"doc_id": "__id", "digest": "__digest"})
    texts = docs.select("doc_id", F.xxhash64("text").alias("digest"))
    rows = texts.join(each, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")), "left")
    return rows.select(
        "doc_id",
        F.coalesce("family", F.lit("none")).alias("family"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("n_paragraphs", F.lit(0)).cast("long").alias("n_paragraphs"),
        F.coalesce("families", F.lit("")).alias("families"),
    )
