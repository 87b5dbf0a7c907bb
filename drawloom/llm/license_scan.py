"""Licence notices in documents: a trained paragraph classifier, in DataFrame functions and Spark ML.

Paragraphs are runs of lines with words; what is classified are their lines and
windows of adjacent lines, as notices are often wrapped.  A multinomial logistic regression over the word bigrams
of licence notices, trained with Spark ML on the templates below (whole and
with words missing) against ordinary paragraphs of a bounded sample of the
corpus, gives each window a family or "unknown".  Its confidence is
calibrated by a temperature found on held-out variants.  A prediction counts only
if it is confident and a template of that family confirms it: enough of the
template's bigrams occur in the window.

No window covers more of a template than its paragraph, so only paragraphs that
cover some template enough are cut into windows; scoring those is a join with
the (bounded) weight table.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hash_sample, stage

#: Notices by which texts state their licence.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Released under the Apache License 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-3.0", "Released under the GPL version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "Released under the GPL version 2."),
    ("LGPL", "Licensed under the GNU Lesser General Public License."),
    ("AGPL", "Licensed under the GNU Affero General Public License."),
    ("BSD", "Released under the BSD 3-Clause License."),
    ("BSD", "Licensed under the BSD license."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0."),
    ("ISC", "Released under the ISC License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Names by which a grant calls a licence, and their identifiers.
NAMES = (
    ("MIT", "the MIT License", "MIT"),
    ("Apache-2.0", "the Apache License, Version 2.0", "Apache-2.0"),
    ("GPL-3.0", "the GNU General Public License, version 3", "GPL-3.0"),
    ("GPL-2.0", "the GNU General Public License, version 2", "GPL-2.0"),
    ("LGPL", "the GNU Lesser General Public License", "LGPL-3.0"),
    ("AGPL", "the GNU Affero General Public License", "AGPL-3.0"),
    ("BSD", "the BSD 3-Clause License", "BSD-3-Clause"),
    ("MPL-2.0", "the Mozilla Public License, version 2.0", "MPL-2.0"),
    ("ISC", "the ISC License", "ISC"),
)
#: How grants put it; the first few words of each vary, so only what follows ``under`` must be there.
GRANTS = ("under {}.", "The license is {}.", "The licence is {}.")
LEADS = ("Distributed", "Available", "Published", "Released", "Licensed", "This file is made available", "The code is distributed")
TEMPLATES += tuple((family, g.format(name)) for family, name, _ in NAMES for g in GRANTS) + tuple((family, f"SPDX-License-Identifier: {spdx}") for family, _, spdx in NAMES)
#: Paragraphs that speak of licences without granting one.
OTHERS = (
    "All rights reserved.",
    "He renewed the license of his car under the new law.",
    "The general public was released from work under the terms of this contract.",
    "You need a license to drive in this version of the game.",
    "The driver license office is open to the general public.",
    "This work is the property of the author.",
    "See the license for details.",
    "The free software was published in version 3 of the book.",
)
UNKNOWN = "unknown"
CONFIDENCE = 0.5
#: Share of a template's bigrams that must occur in the paragraph.
CONFIRM = 0.8
SAMPLE = 2000


def word_list(text: Column) -> Column:
    """ASCII words in lower case, without punctuation, between marks for the ends of the paragraph."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    return F.concat(F.array(F.lit("^")), words, F.array(F.lit("$")))


def bigrams(words: str) -> Column:
    """Distinct bigrams of a column of words, which must be a column of its own: it is read once per word."""
    return F.array_distinct(F.transform(F.slice(words, F.lit(1), F.size(words) - 1), lambda x, i: F.concat(x, F.lit(" "), F.get(words, i + 1))))


def _grams(text: str) -> list[str]:
    import re

    w = ["^", *re.findall("[a-z0-9]+", text.lower()), "$"]
    return [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def train(spark: SparkSession, docs: DataFrame, sample: int = SAMPLE, text_col: str = "text", id_col: str = "doc_id") -> dict:
    """The model: classes, bigram weights, biases and temperature (a few thousand numbers).

    Ordinary paragraphs come from the first lines of at most ``sample``
    documents, taken in hash order of their ids.
    """
    known = sorted({g for _, t in TEMPLATES for g in _grams(t)})
    classes = [UNKNOWN, *dict.fromkeys(f for f, _ in TEMPLATES)]
    rows, held = [], []
    for family, text in TEMPLATES:
        words = text.split()
        rows += [(family, text)] * 4
        for i in range(len(words)):  # one word missing; every third variant is held out
            (held if i % 3 == 2 else rows).append((family, " ".join(words[:i] + words[i + 1 :])))
        rows.append((family, "Lorem ipsum. " + text))
        rows.append((family, text + " Lorem ipsum."))
    for i, lead in enumerate(LEADS):
        for family, name, _ in NAMES:
            (held if i % 3 == 2 else rows).append((family, f"{lead} under {name}."))
    for i, text in enumerate(OTHERS):
        rows += [(UNKNOWN, text)] * 6
        held.append((UNKNOWN, text)) if i % 2 else None
    for _, text in TEMPLATES:  # scraps of notices name no licence
        words = text.split()
        rows += [(UNKNOWN, " ".join(words[:2])), (UNKNOWN, " ".join(words[-1:]))]
    # of a line only the bigrams that templates have, which are few, are ordered and collected
    fewer = lambda d: _known(F.col("kept"), known, d, "hash", "id").withColumnRenamed("grams", "kept")
    picked = [set(r.kept) for r in hash_sample(docs, id_col, sample, F.substring_index(text_col, "\n", 1), fewer).collect()]
    # a sampled paragraph that covers a template may be a notice itself
    inner = [set(_inner(t)) for _, t in TEMPLATES]
    plain = lambda grams: all(len(grams & x) < CONFIRM * len(x) for x in inner)
    examples = [(f, set(_grams(t)) & set(known)) for f, t in rows] + [(UNKNOWN, grams) for grams in picked if plain(grams)]
    frame = spark.createDataFrame([(float(classes.index(f)), sorted(grams)) for f, grams in examples], "label double, grams array<string>").coalesce(1)
    vectors = CountVectorizerModel.from_vocabulary(known, inputCol="grams", outputCol="features")
    vectors = vectors.setBinary(True)
    fitted = LogisticRegression(family="multinomial", regParam=2e-3, maxIter=60, standardization=False).fit(vectors.transform(frame))
    matrix, bias = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    index = {g: i for i, g in enumerate(known)}

    def loss(temperature: float) -> float:
        total = 0.0
        for f, t in held:
            z = (bias + matrix[:, [index[g] for g in set(_grams(t)) if g in index]].sum(1)) / temperature
            total += float(math.log(sum(math.exp(x - z.max()) for x in z)) + z.max() - z[classes.index(f)])
        return total

    temperature = min((x / 20 for x in range(6, 61)), key=loss)
    return {"classes": classes, "grams": known, "weights": (matrix.T / temperature).tolist(), "bias": (bias / temperature).tolist(), "temperature": temperature}


def _inner(text: str) -> list[str]:
    """Distinct bigrams without the marks for the ends."""
    return sorted(g for g in set(_grams(text)) if "^" not in g and "$" not in g)


#: A notice has a word in each of its lines, so it spans no more lines than its template has words.
MAX_LINES = max(len(_grams(t)) - 1 for _, t in TEMPLATES)


#: Bigrams that the shortest template asks for.
LEAST = min(math.ceil(CONFIRM * len(_inner(t))) for _, t in TEMPLATES)


def _literals(values) -> Column:
    return F.array(*map(F.lit, values))


def _coverage(grams: str, family: Column | None = None) -> Column:
    """Largest share of a template's inner bigrams among ``grams``, over the templates of ``family`` or all."""
    out = F.lit(0.0)
    for name, text in TEMPLATES:
        share = F.size(F.array_intersect(grams, _literals(_inner(text)))) / len(_inner(text))
        out = F.greatest(out, share if family is None else F.when(family == name, share).otherwise(0.0))
    return out


def _alone(column: Column, name: str) -> Column:
    """``column`` by way of a generator, so that later expressions read it instead of repeating it."""
    return F.explode(F.array(column)).alias(name)


def _known(text: Column, known: list[str], df: DataFrame, *kept: str) -> DataFrame:
    """``kept`` and the known bigrams (``grams``) of ``text``."""
    df = df.select(*kept, _alone(word_list(text), "words"))
    return df.select(*kept, _alone(F.array_intersect(bigrams("words"), _literals(known)), "grams"))


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, document, paragraph, text): runs of lines with a word, without comment words, numbered from 0.

    Lines without a word (blank or only marks such as ``*`` or ``#``) end a
    paragraph; other comment marks are no words.
    """
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"(?m)^[ \t]*(?:REM|rem|dnl)(?=[ \t\r]|$)", "")
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("document"), text.alias("text"))
    return rows.select("id", "document", F.posexplode(F.split("text", r"\n[^a-zA-Z0-9]*\n")).alias("paragraph", "text"))


def _lines(df: DataFrame, *kept: str) -> DataFrame:
    """``kept`` and the ``lines`` with a word of a paragraph's text."""
    return df.select(*kept, _alone(F.filter(F.split("text", "\n"), lambda x: x.rlike("[a-zA-Z0-9]")), "lines")).where(F.size("lines") > 0)


KEY = ["id", "document", "row", "paragraph", "first", "last"]


def _join(first: Column, last: Column) -> Column:
    return F.array_join(F.slice("lines", first + 1, last - first + 1), "\n").alias("text")


def _likely(found: DataFrame, known: list[str]) -> DataFrame:
    """Rows (KEY, text) as (KEY, grams), where they cover a template."""
    return _known(F.col("text"), known, found, *KEY).where(F.size("grams") >= LEAST).where(_coverage("grams") >= CONFIRM)


def _judged(likely: DataFrame, model: dict) -> DataFrame:
    """(KEY, family, confidence, coverage) of the rows (KEY, grams) that are notices."""
    weights = likely.sparkSession.createDataFrame(list(zip(model["grams"], model["weights"], strict=True)), "gram string, w array<double>")  # bounded by the templates
    k = len(model["classes"])
    hits = likely.select(*KEY, F.explode("grams").alias("gram")).join(F.broadcast(weights), "gram").groupBy(*KEY).agg(*(F.sum(F.col("w")[i]).alias(f"z{i}") for i in range(k)), F.collect_set("gram").alias("grams"))
    logits = F.array(*(F.col(f"z{i}") + F.lit(model["bias"][i]) for i in range(k)))
    df = hits.select(*KEY, "grams", logits.alias("z")).withColumn("top", F.array_max("z"))
    df = df.withColumn("confidence", 1 / F.aggregate("z", F.lit(0.0), lambda a, z: a + F.exp(z - F.col("top")))).withColumn("class", F.array_position("z", F.col("top")) - 1)
    df = df.withColumn("family", F.get(_literals(model["classes"]), F.col("class").cast("int"))).where((F.col("family") != UNKNOWN) & (F.col("confidence") >= CONFIDENCE))
    df = df.withColumn("coverage", _coverage("grams", F.col("family"))).where(F.col("coverage") >= CONFIRM)
    return df.select(*KEY, "family", "confidence", "coverage")


def scan(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, document, paragraph, first, last, family, confidence, coverage) of every notice, with its lines in the paragraph.

    A line may be a notice by itself.  Windows of several lines count in the runs
    of lines between such lines; of overlapping windows of one family those count
    that end first and are shortest.  Only runs that cover a template enough are
    cut into windows.  Null, empty and blank texts state no licence.
    ``document`` numbers the rows of ``docs``, so rows with the same id are told
    apart.
    """
    known = model["grams"]
    runs = _known(F.col("text"), known, paragraphs(docs, id_col, text_col), "id", "document", "paragraph", "text").where(F.size("grams") >= LEAST).where(_coverage("grams") >= CONFIRM)
    runs = stage(runs.select("id", "document", "paragraph", "text", F.monotonically_increasing_id().alias("row")))
    own = ["id", "document", "row", "paragraph"]
    lines = _lines(runs, *own)
    single = lines.select(*own, F.posexplode("lines").alias("first", "text")).withColumn("last", F.col("first"))
    alone = stage(_judged(_likely(single, known), model))

    taken = alone.groupBy("row").agg(F.array_sort(F.collect_list("first")).alias("cuts"))  # a paragraph's lines
    cuts = F.concat(F.array(F.lit(-1)), F.coalesce("cuts", F.array().cast("array<int>")), F.array(F.size("lines")))
    between = F.filter(F.transform(F.sequence(F.lit(0), F.size(cuts) - 2), lambda i: F.struct((F.get(cuts, i) + 1).alias("first"), (F.get(cuts, i + 1) - 1).alias("last"))), lambda x: x["last"] > x["first"])
    parts = lines.join(taken, "row", "left").select(*own, "lines", F.explode(between).alias("x")).select(*own, "x.first", "x.last", _join(F.col("x.first"), F.col("x.last")))
    parts = _known(F.col("text"), known, parts, *KEY, "text").where(F.size("grams") >= LEAST).where(_coverage("grams") >= CONFIRM)
    parts = parts.select(*own, F.col("first").alias("from"), F.split("text", "\n").alias("lines"))
    starts = parts.select(*own, "from", "lines", F.explode(F.sequence(F.lit(0), F.size("lines") - 2)).alias("first"))
    windows = starts.select(*own, "from", "lines", "first", F.explode(F.sequence(F.col("first") + 1, F.least(F.col("first") + MAX_LINES, F.size("lines")) - 1)).alias("last"))
    windows = windows.select(*own, (F.col("from") + F.col("first")).alias("first"), (F.col("from") + F.col("last")).alias("last"), _join(F.col("first"), F.col("last")))
    df = _judged(_likely(windows, known), model)

    one = F.struct("last", (-F.col("first")).alias("back"), "first", "confidence", "coverage")
    fits = df.groupBy("id", "document", "row", "paragraph", "family").agg(F.array_sort(F.collect_list(one)).alias("fits"))
    none = F.filter("fits", lambda x: F.lit(False))
    chosen = F.aggregate("fits", none, lambda a, x: F.when((F.size(a) == 0) | (F.element_at(a, -1)["last"] < x["first"]), F.concat(a, F.array(x))).otherwise(a))
    several = fits.select("id", "document", "paragraph", "family", F.explode(chosen).alias("x")).select("id", "document", "paragraph", "x.first", "x.last", "family", "x.confidence", "x.coverage")
    return alone.select("id", "document", "paragraph", "first", "last", "family", "confidence", "coverage").unionByName(several).withColumnRenamed("id", id_col)


def license_of(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, families (comma-separated, in order; "unknown" if none) and n_notices.

    Rows are told apart by id and text (its length and two hashes), so rows that
    share an id each get what their own text states, and repeated rows the same.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), F.struct(F.xxhash64(text).alias("a"), F.crc32(text.cast("binary")).alias("b"), F.length(text).alias("n")).alias("text_key"), F.col(text_col).alias("text"))
    keyed = keyed.select(F.col("id"), F.struct("id", "text_key").alias("key"), "text")
    found = scan(keyed, model, "key", "text").groupBy("key", "document").agg(F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.count(F.lit(1)).alias("n_notices"))
    found = stage(found.groupBy("key").agg(F.max("families").alias("families"), F.max("n_notices").alias("n_notices"))).withColumnRenamed("key", "found_key")
    out = keyed.select("id", "key").join(found, F.col("key").eqNullSafe(F.col("found_key")), "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("families", F.lit(UNKNOWN)).alias("families"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"))
