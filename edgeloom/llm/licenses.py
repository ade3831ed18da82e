"""Licence scans: a sparse n-gram logistic regression names each paragraph's licence family, templates confirm it."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.cluster import written

# Wording of public licences and of the notices that name them.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0.",
        "This project is released under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU GPL v2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, Version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under the Creative Commons Attribution-ShareAlike License.",
    ],
    "CC-BY-NC": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-ND 4.0.",
    ],
    "Public-Domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "Proprietary": [
        "Copyright. All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ],
}
#: What licence notices say whatever the family.
UNKNOWN_NOTICES = [
    "Licensed under the terms of a license.", "This work is licensed under the license in the accompanying file.", "Released under a license of its own.",
    "See the LICENSE file for the license terms.", "The license of this work is given below.", "This project is licensed under the Example License, version 1.",
    "Licensed under the Sample License.", "Use is subject to the license agreement.", "Released under the Example Community License.",
]
# and such notices with names that no family has, each another, so that the model can't go by them
UNKNOWN_NOTICES += [
    f"{how} under the N{i}{k}X License{version}{'' if k % 2 else ' N' + str(i * k) + 'Y'}."
    for i, (how, version) in enumerate((h, v) for h in ("Licensed", "Released", "Distributed", "This work is licensed", "This file is distributed") for v in ("", ", version 2", ", version 5", " 4.0"))
    for k in range(1, 9)
]
NONE, UNKNOWN = "none", "unknown"
CLASSES = [*TEMPLATES, UNKNOWN, NONE]
#: A word is a run of these; punctuation parts words.
WORD = r"[\p{L}\p{N}]+"
ORDER = 3
#: Characters of a line up to which its end may be a wrap.
WRAP = 100
#: Paragraphs of the corpus, without any of these stems, that stand for class none; rows of the smallest hashes.
NEGATIVES = 2000
STEMS = "licen[cs]|copyright|copyleft|redistribut|spdx|all rights reserved|public domain|warrant"
#: Orders in which the templates' words stand for class none too, so that it is wording that tells and not its words.
SCRAMBLED = 8
#: Weight of class none beside any other class in the fit.
NONE_WEIGHT = 3.0
#: n-grams of the model at most, and the share of the negatives beyond which an n-gram is too common to tell anything.
GRAMS = 20_000
COMMON = 0.05
PENALTY = 1e-3
#: Share of the shorter one's n-grams that paragraph and template must have in common.
OVERLAP = 0.5
#: The same, from which a family that isn't sure is worth telling as UNKNOWN.
TRACE = 0.25
#: Precision that the threshold for a named family is set for, on rows kept from the fit.
PRECISION = 0.98


def _rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table from literals, without Python on the executors."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("x")).select("x.*")


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text: its lines, with those joined that were wrapped. A line of up to WRAP characters is wrapped if
    it ends no sentence and the next one's first word, comment marks aside, would have made it longer than both are.
    Null and empty texts have one empty paragraph."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")

    def ended(x: Column, after: Column) -> Column:
        first = F.regexp_extract(after, r"^[\s/#*;>-]*(\S+)", 1)
        wraps = F.length(x).between(1, WRAP) & (first != "") & (F.trim(x) != "") & (F.length(x) + 1 + F.length(first) > F.greatest(F.length(x), F.length(after))) & ~x.rlike(r"[.!?][\"')]*\s*$")
        return F.concat(x, F.when(after.isNull(), "").when(wraps, " ").otherwise("\n"))

    # each line beside the next one, which the last doesn't have; a lambda that looked the next one up would split the text anew for every line
    return F.split(F.array_join(F.zip_with(lines, F.slice(lines, 2, F.size(lines)), ended), ""), "\n")


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def grams(w: str, order: int = ORDER) -> Column:
    """The distinct n-grams of an array of words, 1 to order words, joined by blanks."""
    each = [f"transform(sequence(1, size({w}) - {n - 1}), i -> array_join(slice({w}, i, {n}), ' '))" for n in range(1, order + 1)]
    return F.array_distinct(F.concat(*[F.when(F.size(w) >= n, F.expr(x)).otherwise(F.expr("cast(array() as array<string>)")) for n, x in enumerate(each, 1)]))


@dataclass
class Model:
    """intercepts and weights by n-gram, for CLASSES in order; temperature and threshold as calibrated."""

    intercepts: list[float]
    weights: dict[str, list[float]]
    temperature: float
    threshold: float


def training_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(label, corpus boolean, w array<string>): stretches of the templates and notices by class; for class none their words in
    SCRAMBLED other orders, and NEGATIVES paragraphs of docs."""
    spark = docs.sparkSession
    said = [{"f": f, "t": t} for f, texts in TEMPLATES.items() for t in texts] + [{"f": UNKNOWN, "t": t} for t in dict.fromkeys(UNKNOWN_NOTICES)]
    base = _rows(spark, said, "f string, t string").select("f", words(F.col("t")).alias("w"))
    # the whole text, and stretches of it long enough to tell
    spans = base.select("f", "w", F.explode(F.expr("concat(array(size(w)), filter(array(6, 10, 16, 24), n -> n < size(w) and size(w) > 8))")).alias("n"))
    spans = spans.select("f", "w", "n", F.explode(F.expr("sequence(1, size(w) - n + 1, greatest(1, n div 4))")).alias("i")).select("f", F.expr("slice(w, i, n)").alias("w"))
    named = _rows(spark, [{"f": f, "label": float(i)} for i, f in enumerate(CLASSES)], "f string, label double")
    positive = spans.join(F.broadcast(named), "f").select("label", F.lit(False).alias("corpus"), "w")
    mixed = base.select("w", F.explode(F.sequence(F.lit(1), F.lit(SCRAMBLED))).alias("s")).select(
        F.lit(float(len(CLASSES) - 1)).alias("label"), F.lit(False).alias("corpus"), F.expr("slice(transform(array_sort(transform(w, x -> struct(xxhash64(x, s) as h, x as x))), y -> y.x), 1, 14)").alias("w")
    )
    lines = docs.select(F.explode(paragraphs(F.col(text_col))).alias("t")).where(F.length("t") > 20).where(~F.lower("t").rlike(STEMS))
    negative = lines.orderBy(F.xxhash64("t"), "t").limit(NEGATIVES).select(F.lit(float(len(CLASSES) - 1)).alias("label"), F.lit(True).alias("corpus"), words(F.col("t")).alias("w"))
    return positive.unionByName(mixed).unionByName(negative).where("size(w) > 0")


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """The model from templates and a bounded sample of docs. A fifth of the rows is kept from the fit, and sets the
    temperature of the probabilities and the threshold below which a family counts as UNKNOWN."""
    rows = written(training_rows(docs, text_col).select("label", "corpus", "w", grams("w").alias("g"), (F.pmod(F.xxhash64("w"), F.lit(5)) == 0).alias("out")), "training")
    none = float(len(CLASSES) - 1)
    negatives = max(1, rows.where("corpus").count())
    each = rows.select("label", "corpus", F.explode("g").alias("g")).groupBy("g").agg(F.count_if("corpus").alias("no"), F.count_if(F.col("label") != none).alias("yes"))
    telling = F.broadcast(each.where((F.col("yes") > 0) & (F.col("no") <= COMMON * negatives)).orderBy(F.desc("yes"), "g").limit(GRAMS).select("g"))
    used = rows.withColumn("row", F.monotonically_increasing_id())
    sparse = used.select("row", F.explode("g").alias("g")).join(telling, "g").groupBy("row").agg(F.collect_list("g").alias("items"))
    used = written(used.join(sparse, "row", "left").select("label", "out", F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items")), "features")
    count = CountVectorizer(inputCol="items", outputCol="features", binary=True, vocabSize=GRAMS, minDF=1.0).fit(used)
    per_class = F.broadcast(used.where("not out").groupBy("label").agg((1 / F.count("*")).alias("weight")))
    x = count.transform(used).join(per_class, "label", "left").withColumn("weight", 500 * F.coalesce("weight", F.lit(0.0)) * F.when(F.col("label") == none, NONE_WEIGHT).otherwise(1.0))
    x = x.coalesce(1)  # a bounded sample, which many short rounds go over
    lr = LogisticRegression(weightCol="weight", regParam=PENALTY, elasticNetParam=0.9, maxIter=50, family="multinomial").fit(x.where(~F.col("out")))
    kept = lr.transform(x.where("out")).select("label", vector_to_array("rawPrediction").alias("m")).collect()  # a fifth of a bounded sample
    k = lr.coefficientMatrix.toArray()
    temperature, threshold = calibrate(np.array([r["label"] for r in kept], int), np.array([[*r["m"], *[-50.0] * (len(CLASSES) - len(r["m"]))] for r in kept]).reshape(-1, len(CLASSES)))
    pad = [0.0] * (len(CLASSES) - len(k))
    weights = {g: [*map(float, k[:, i]), *pad] for i, g in enumerate(count.vocabulary) if np.abs(k[:, i]).max() > 0}
    return Model([*map(float, lr.interceptVector.toArray()), *[-50.0] * len(pad)], weights, temperature, threshold)


def calibrate(label: np.ndarray, margins: np.ndarray) -> tuple[float, float]:
    """The temperature of least log loss, and the least threshold from which named families are right in PRECISION."""
    if not len(label):
        return 1.0, 0.5

    def chances(t: float) -> np.ndarray:
        e = np.exp((margins - margins.max(axis=1, keepdims=True)) / t)
        return e / e.sum(axis=1, keepdims=True)

    grid = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0]
    t = min(grid, key=lambda t: -np.log(np.maximum(chances(t)[np.arange(len(label)), label], 1e-12)).mean())
    p = chances(t)
    best, top = p.argmax(axis=1), p.max(axis=1)
    for threshold in np.arange(0.3, 0.96, 0.05):
        named = (best < len(TEMPLATES)) & (top >= threshold)
        if not named.any() or (best == label)[named].mean() >= PRECISION:
            break
    return t, float(threshold)


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, n_paragraphs, found array<struct<paragraph, family, probability, overlap>>): for every row of docs the
    paragraphs (from 0) that carry a licence: the family named with the threshold's confidence and confirmed by
    one of its templates, or UNKNOWN where a licence shows but no family is sure (the model says so, or templates of the
    family it names have a trace in common with the paragraph).

    Every word of every text is looked up: n-grams meet the model's in a broadcast join whose size has a bound
    (GRAMS), and only those that the model knows are shuffled, with one row for each document. Null and empty texts
    find nothing; repeated rows stay repeated; other columns are ignored.
    """
    spark = docs.sparkSession
    k = len(CLASSES)
    sketches = [(f, t) for f, texts in TEMPLATES.items() for t in texts]
    owner = [CLASSES.index(f) for f, _ in sketches]
    base = written(_rows(spark, [{"t": i, "s": t} for i, (_, t) in enumerate(sketches)], "t int, s string").select("t", words(F.col("s")).alias("w")).select("t", grams("w").alias("g")), "templates")
    in_template = base.select("t", F.explode("g").alias("g")).where("size(split(g, ' ')) > 1").groupBy("g").agg(F.collect_set("t").alias("ts"))
    n_grams = {r["t"]: r["n"] for r in base.select("t", F.size(F.filter("g", lambda x: F.contains(x, F.lit(" ")))).alias("n")).collect()}
    known = _rows(spark, [{"g": g, "w": w} for g, w in model.weights.items()] or [{"g": "", "w": [0.0] * k}], "g string, w array<double>")
    table = known.join(in_template, "g", "full").select(F.xxhash64("g").alias("key"), "g", F.coalesce("w", F.array(*[F.lit(0.0)] * k)).alias("w"), F.coalesce("ts", F.expr("cast(array() as array<int>)")).alias("ts"))
    itself = spark.range(1).select(F.lit(0).cast("long").alias("key"), F.lit("").alias("g"), F.array(*[F.lit(0.0)] * k).alias("w"), F.expr("cast(array() as array<int>)").alias("ts"))
    table = F.broadcast(written(table.where("g <> ''").unionByName(itself), "grams"))  # GRAMS and the templates' n-grams at most

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), paragraphs(F.col(text_col)).alias("lines"))
    lines = rows.select("row", "id", F.size("lines").alias("n_paragraphs"), F.posexplode_outer("lines").alias("at", "line")).select("row", "id", "n_paragraphs", "at", words(F.col("line")).alias("w"))
    spots = lines.select("row", "id", "n_paragraphs", "at", "w", F.size("w").alias("n"), F.explode_outer(F.sequence(F.when(F.col("at") == 0, 0).otherwise(1), F.greatest(F.size("w"), F.when(F.col("at") == 0, 0).otherwise(1)))).alias("i"))
    spots = spots.where("i <= n").select("row", "id", "n_paragraphs", "at", "w", "n", "i", F.explode_outer(F.when(F.col("i") == 0, F.array(F.lit(0))).otherwise(F.array(*map(F.lit, range(1, ORDER + 1))))).alias("len")).where("i + len - 1 <= n or i = 0")
    gram = F.when(F.col("i") == 0, F.lit("")).otherwise(F.array_join(F.slice("w", F.greatest("i", F.lit(1)), F.col("len")), " "))
    spots = spots.select("row", "id", "n_paragraphs", "at", "n", gram.alias("said"))
    met = spots.withColumn("key", F.when(F.col("said") == "", F.lit(0).cast("long")).otherwise(F.xxhash64("said"))).join(table, "key").where("said = g")
    once = met.select("row", "id", "n_paragraphs", F.when(F.col("said") == "", -1).otherwise(F.col("at")).alias("at"), "n", "key", "w", "ts").dropDuplicates(["row", "at", "key"])
    sums = [F.sum(F.col("w")[c]).alias(f"m{c}") for c in range(k)]
    hits = [F.sum(F.array_contains("ts", t).cast("int")).alias(f"t{t}") for t in range(len(sketches))]
    found = once.groupBy("row", "id", "n_paragraphs", "at").agg(F.max("n").alias("n"), *sums, *hits)

    margin = F.array(*[(F.col(f"m{c}") + F.lit(model.intercepts[c])) / model.temperature for c in range(k)])
    found = found.withColumn("m", margin).withColumn("top", F.array_max("m"))
    found = found.withColumn("p", 1 / F.aggregate("m", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))).withColumn("best", F.array_position("m", F.col("top")) - 1)
    share = F.array(*[F.when(F.col("best") == owner[t], F.least(F.lit(1.0), F.col(f"t{t}") / F.greatest(F.lit(1), F.least(F.lit(n_grams[t]), 2 * F.col("n") - 3)))).otherwise(0.0) for t in range(len(sketches))])
    found = found.withColumn("overlap", F.array_max(share))
    sure = (F.col("best") < len(TEMPLATES)) & (F.col("p") >= model.threshold) & (F.col("overlap") >= OVERLAP)
    family = F.when(sure, F.element_at(F.array(*map(F.lit, CLASSES)), (F.col("best") + 1).cast("int"))).when(F.col("best") == k - 2, UNKNOWN).when((F.col("best") < k - 2) & (F.col("overlap") >= TRACE), UNKNOWN)
    one = F.when((F.col("at") >= 0) & family.isNotNull(), F.struct(F.col("at").alias("paragraph"), family.alias("family"), F.col("p").alias("probability"), "overlap"))
    return found.select("row", "id", "n_paragraphs", one.alias("one")).groupBy("row", "id", "n_paragraphs").agg(F.array_sort(F.collect_list("one")).alias("found"))


def licenses(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, licenses string, n_licensed long, n_paragraphs long, probability double) for every row: its families, sorted
    and joined by commas, the paragraphs that carry one, all paragraphs, and the surest one's probability or null."""
    s = scan(docs, model, id_col, text_col)
    return s.select(
        F.col("id").alias(id_col), F.array_join(F.array_sort(F.array_distinct(F.col("found.family"))), ",").alias("licenses"), F.size("found").cast("long").alias("n_licensed"),
        F.col("n_paragraphs").cast("long").alias("n_paragraphs"), F.array_max(F.col("found.probability")).alias("probability"),
    )
