"""License scans: sparse word n-gram logistic regression names each paragraph's licence family; templates confirm it.

A paragraph is a line, with the lines that it is wrapped into: a line of any length that doesn't end a sentence goes on in the next one, if
that isn't blank. Every paragraph of every document is scored, and where a paragraph has several lines each of them too, as short lines need not be
wrapped ones. Words and word pairs of the templates below and of OTHER_LINES are the vocabulary of a sparse vector; MLlib's multinomial logistic
regression is trained on the templates, whole, in part and amid other words, and on what is no notice: OTHER_LINES, and paragraphs
without a cue word of at most UNKNOWN_DOCS documents (at most UNKNOWN_LINES paragraphs, picked by hash). A third of each is held back from the fit. On
these the probabilities are calibrated (one temperature, by likelihood), and the threshold is set: the lowest of 0.5, 0.55, ... 0.95 at
which no family is named for what is no notice; if there is none, nothing is named. A family is named if its probability reaches the threshold; the class is
`unknown` if it does not, but a notice is likelier than none. A notice is confirmed if it holds at least SIMILAR of the words of one of its family's templates.

Everything runs in the JVM as DataFrame and MLlib operations; only found notices are shuffled, by document.

Defined results: null and empty texts, and paragraphs that are likelier no notice, give no row; a notice that comes again gives a row each time,
and so does a document that comes again; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm._common import bounded_sample, materialise, read

SIMILAR = 0.7
UNKNOWN_DOCS, UNKNOWN_LINES = 1000, 4000
#: Stand for a line break within a paragraph, and for the first of these characters where a text has it.
BREAK, ESCAPED = "\ue000b", "\ue000a"
#: Words by which training paragraphs of documents are taken for possible notices, and left out.
CUES = ("licen", "copyright", "warrant", "redistribut", "permission", "public domain", "creative commons", "spdx", "all rights reserved", "cc by", "cc-by", "gpl", "lizenz")
TEMPERATURES = (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)
THRESHOLDS = tuple(x / 20 for x in range(10, 20))

# Notices by which the licences are known.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Distributed under the terms of the GNU GPL version 3 (GPLv3).",
    ),
    "GPL-2.0": (
        "Licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License; either version 2 of the License.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "Distributed under the terms of the GNU GPL version 2 (GPLv2).",
    ),
    "LGPL": ("Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software under the terms of the GNU Lesser General Public License."),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"),
    "BSD": (
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0": ("Released under CC0 1.0 Universal license.", "To the extent possible under law, the author has waived all copyright and dedicated this work to the public domain."),
    "ISC": ("Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "all-rights-reserved": ("All rights reserved.", "Copyright. All rights reserved.", "All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher."),
}
# Lines with cue words that are no notice.
OTHER_LINES = (
    "He lost his driving licence last year and had to take the bus.",
    "The council granted a licence to the new restaurant on the corner.",
    "Ask for permission before you enter the building.",
    "The warranty of the washing machine ran out after two years.",
    "Copyright law is taught in the third year of the course.",
    "The police issued a warrant for the search of the house.",
    "She wrote about licensing in the music industry.",
    "The redistribution of wealth was debated in parliament.",
    "Permission to land was given to the pilot at noon.",
    "A license plate was found near the river.",
    "The public domain is a topic of this book.",
    "Software licences cost the company a lot of money.",
    "Version 2 of the plan was released under pressure.",
    "The general public was invited to the work.",
)


def words_of(line: Column) -> Column:
    """Lower-case words; versions and hyphenated names stay whole."""
    return F.filter(F.split(F.lower(line), r"[^\p{L}\p{N}.+-]+|\.(?!\p{N})"), lambda w: F.length(w) > 0)


def grams(lines: DataFrame) -> DataFrame:
    """The lines (column line) with `_words`, and `_grams`: these and their pairs."""
    return NGram(n=2, inputCol="_words", outputCol="_pairs").transform(lines.withColumn("_words", words_of(F.col("line")))).withColumn("_grams", F.concat("_words", "_pairs")).drop("_pairs")


def variants(template: str) -> list[str]:
    """The template whole, amid other words, and with words left out."""
    w = template.split()
    around = (("", ""), ("this file is", ""), ("", "see the file for details"), ("the text of this page", "and so on"), ("copyright 2021 the authors", ""))
    out = [f"{a} {template} {b}" for a, b in around]
    return out + ([" ".join(x for i, x in enumerate(w) if i % 7 != k) for k in range(3)] if len(w) > 8 else [])


def has_cue(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for cue in CUES:
        out = out | F.contains(low, F.lit(cue))
    return out


def paragraphs(docs: DataFrame, text: str, key: str) -> DataFrame:
    """doc_id, row (a number of the document's row), paragraph (from 0), unit (0: the whole paragraph, else its line from 1), line (its text)."""
    wrapped = r"([^\s.!?:;][ \t\r]*)\n(?=[ \t\r]*[^\s])"
    escaped = F.replace(F.col(text), F.lit(BREAK[0]), F.lit(ESCAPED))
    rows = docs.select(F.col(key).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.regexp_replace(escaped, wrapped, f"$1{BREAK}").alias("text"))
    each = rows.select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("paragraph", "whole")).where("trim(whole) <> ''")
    lines = F.split("whole", BREAK)
    shown = lambda x: F.replace(x, F.lit(ESCAPED), F.lit(BREAK[0]))
    whole = F.array(F.struct(F.lit(0).alias("unit"), shown(F.replace("whole", F.lit(BREAK), F.lit("\n"))).alias("line")))
    parts = F.when(F.size(lines) > 1, F.transform(lines, lambda x, i: F.struct((i + 1).alias("unit"), shown(x).alias("line")))).otherwise(F.array())
    return each.select("doc_id", "row", "paragraph", F.explode(F.concat(whole, parts)).alias("u")).select("doc_id", "row", "paragraph", "u.*")


@dataclass
class Fitted:
    """Vocabulary, model, the families by class (0: none), temperature, and the probability from which a family is named."""

    vectors: CountVectorizerModel
    model: LogisticRegressionModel
    names: list[str]
    temperature: float
    threshold: float

    def notices(self, lines: DataFrame) -> DataFrame:
        """The lines that are likelier a notice than none, with `_words` and `p`, the calibrated probabilities."""
        raw = self.model.transform(self.vectors.transform(grams(lines))).withColumn("_p", vector_to_array("_probability"))
        n = len(self.names) - 1
        # of n families one must have at least this part of what none has, or they don't outweigh it at any rate; leaves little to calibrate
        some = raw.where(F.array_max(F.slice("_p", 2, n)) * float(n) ** self.temperature >= F.col("_p")[0])
        return some.withColumn("p", calibrated("_p", self.temperature)).where(F.col("p")[0] < 0.5).drop("_grams", "_vector", "_raw", "_probability", "_class", "_p")


def calibrated(p: str, temperature: float) -> Column:
    """Probabilities at a temperature: their powers, made to sum to 1."""
    e = F.transform(p, lambda v: F.pow(v, F.lit(1 / temperature)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda t, w: t + w))


def train(docs: DataFrame, text: str, key: str) -> Fitted:
    names = ["none", *TEMPLATES]
    rows = [(names.index(f), v, i % 3 == 2) for f, ts in TEMPLATES.items() for t in ts for i, v in enumerate(variants(t))]
    rows += [(0, f"{v}{tail}", i % 3 == 2) for i, v in enumerate(OTHER_LINES) for tail in ("", " It was so in every year.")]
    fixed = docs.sparkSession.range(1).select(F.explode(F.array(*(F.struct(F.lit(c).alias("label"), F.lit(v).alias("line"), F.lit(b).alias("back")) for c, v, b in rows))).alias("r")).select("r.*")
    chosen = F.broadcast(bounded_sample(docs.select(F.col(key).alias("of")), "of", UNKNOWN_DOCS))
    some = docs.select(F.col(key).alias("of"), F.col(text).alias("text")).join(chosen, "of")
    some = bounded_sample(paragraphs(some, "text", "of").where(~has_cue(F.col("line"))).select("line"), "line", UNKNOWN_LINES)
    some = some.select(F.lit(0).alias("label"), "line", (F.pmod(F.xxhash64("line"), F.lit(3)) == 0).alias("back"))
    vocabulary = sorted(r.g for r in grams(fixed.where("not back")).select(F.explode("_grams").alias("g")).distinct().collect())
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="_grams", outputCol="_vector").setBinary(True)
    known = vectors.transform(grams(materialise(fixed.union(some).coalesce(1), "license-train").coalesce(1))).select("label", "back", "_vector").cache()
    fit = LogisticRegression(featuresCol="_vector", probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_class", family="multinomial", regParam=1e-3, maxIter=60)
    model = fit.fit(known.where("not back"))
    held = model.transform(known.where("back")).select("label", vector_to_array("_probability").alias("_p"))
    power = lambda t: F.aggregate("_p", F.lit(0.0), lambda s, v: s + F.pow(v, F.lit(1 / t)))
    loss = lambda t: F.avg(F.log(power(t)) - F.log(F.greatest(F.element_at("_p", F.col("label") + 1), F.lit(1e-300))) / t)
    losses = held.agg(*(loss(t).alias(f"t{i}") for i, t in enumerate(TEMPERATURES))).first()
    temperature = min(zip(losses, TEMPERATURES, strict=True))[1]
    worst = held.where("label = 0").agg(F.max(F.array_max(F.slice(calibrated("_p", temperature), 2, len(names))))).first()[0] or 0.0
    known.unpersist()
    return Fitted(vectors, model, names, temperature, min((t for t in THRESHOLDS if t > worst), default=2.0))


def scan(docs: DataFrame, *, text: str = "text", key: str = "doc_id", similar: float = SIMILAR) -> DataFrame:
    """doc_id, paragraph (from 0), line (in the paragraph from 1; 0: all of it), family, probability, similarity, confirmed: one row per notice.

    Of a paragraph and its lines, confirmed lines are returned if there are any, else the paragraph if it is a notice, else its lines.
    """
    fitted = train(docs, text, key)
    names = fitted.names
    family = F.slice("p", 2, len(names) - 1)
    found = fitted.notices(paragraphs(docs, text, key)).withColumn("best", F.array_max(family))
    found = found.withColumn("class", F.when(F.col("best") >= fitted.threshold, F.array_position(family, F.col("best")).cast("int")).otherwise(0))
    lists = {i: [sorted(set(_plain_words(t))) for t in TEMPLATES[n]] for i, n in enumerate(names) if i}
    templates = F.create_map(*(x for i, ts in lists.items() for x in (F.lit(i), F.array(*(F.array(*map(F.lit, t)) for t in ts)))))
    share = F.coalesce(F.array_max(F.transform(templates[F.col("class")], lambda t: F.size(F.array_intersect("_words", t)) / F.size(t))), F.lit(0.0))
    named = F.element_at(F.array(*map(F.lit, ["unknown", *names[1:]])), F.col("class") + 1)
    found = found.select(
        "doc_id",
        "row",
        F.col("paragraph").cast("long").alias("paragraph"),
        F.col("unit").cast("long").alias("line"),
        named.alias("family"),
        F.when(F.col("class") > 0, F.col("best")).otherwise(1 - F.col("p")[0]).alias("probability"),
        share.alias("similarity"),
        (share >= similar).alias("confirmed"),
    )
    here = W.partitionBy("row", "paragraph")
    some = lambda x: F.coalesce(F.bool_or(x).over(here), F.lit(False))
    marked = found.withColumn("_sure", some((F.col("line") > 0) & F.col("confirmed"))).withColumn("_whole", some(F.col("line") == 0))
    kept = F.when(F.col("_sure"), (F.col("line") > 0) & F.col("confirmed")).otherwise((F.col("line") == 0) | ~F.col("_whole"))
    return marked.where(kept).drop("row", "_sure", "_whole")


def _plain_words(template: str) -> list[str]:
    import re

    return [w for w in re.split(r"[^\w.+-]+|\.(?!\d)", template.lower()) if w]


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


QUERIES = {"op10_license_scan": op10_license_scan}
ORACLE: dict[str, str] = {}
