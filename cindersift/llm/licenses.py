"""Licence scan with a trained paragraph classifier.

A sparse logistic regression over word uni- and bigrams tells licence families, a class for licences it does
not know, and paragraphs that are no licence apart. It is trained here, on the notices and ordinary sentences
below and on a bounded sample of ordinary lines. A family's verdict stands only above a probability calibrated on
held-out notices of the families and on notices of licences that training never met, else it is ``unknown``; the
family's templates are then compared word by word to confirm it, or to give it up where the notice of another
licence fits as well.

Only terms with a weight matter, so lines without any of them are never taken apart.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Wordings of licence notices by family.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "proprietary": ["All rights reserved.", "Copyright by the authors. All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."],
}
UNKNOWN, NONE = "unknown", "none"
#: Notices of no family.
OTHER = [
    "Licensed under the terms of the agreement.",
    "See the license for details.",
    "Released under a license of its own.",
    "This work is licensed under the Example License, version 1.",
    "Use is subject to license terms.",
    "Licensed under CC BY-SA 4.0.",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "You should have received a copy of the GNU Lesser General Public License along with this library.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
    "Permission to use, copy, modify and distribute this software and its documentation for any purpose and without fee is hereby granted, provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License which accompanies this distribution.",
    "The contents of this file are subject to the terms of the Common Development and Distribution License. You may not use this file except in compliance with the License.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "You can redistribute it and/or modify it under the terms of the Artistic License.",
    "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability and fitness for a particular purpose.",
    "In no event shall the authors or copyright holders be liable for any claim, damages or other liability arising from the use of this software.",
]
#: Notices of no family that are not trained on and calibrate the unknown class.
UNSEEN = [
    "Distributed under the Boost Software License, Version 1.0.",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software.",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "Licensed under the Academic Free License version 3.0.",
    "This file is licensed under the Python Software Foundation License.",
]
#: Ordinary sentences with words of notices.
ORDINARY_WORDS = [
    "A table was reserved for the guests and all seats were free of charge.",
    "The children had permission to leave without a word.",
    "Nobody may use the road in winter except with a permit.",
    "The software runs on a public server and keeps a copy of each file.",
    "Version 2.0 of the program was published last week, with a list of the changes.",
    "She was granted leave provided that the work was done.",
    "The general conditions of the contract are subject to change.",
    "He holds a driving license and a fishing license.",
    "All rights of way across the field remain open to the public.",
    "The foundation gave free meals to any person in need.",
    "Human rights and the rights of women were the topic of the day.",
    "The library reserves books for members and is free for everyone.",
    "A source close to the company said that the terms of the deal were confidential.",
    "Copying from a neighbour is strictly prohibited in this school.",
    "The author wrote the book under another name and the work was a success.",
    "The following conditions are met by every prime number.",
    "The notice on the door said that the shop was closed without a reason.",
    "International law does not permit it, but there is no warranty of peace.",
    "The binary forms of the numbers are listed in the source, with or without leading zeros.",
    "The copy of the letter was modified and distributed to all members.",
    "The above list is provided for any purpose you may have.",
    "Commercial use of the land by the commons was limited to particular days.",
    "Permission was given free of charge, and a room was reserved for the use of the public.",
    "Documentation of the building and associated drawings is kept in the archive.",
]
#: Ordinary lines to train on are those of about so many documents, drawn by hash of their text.
MAX_DOCS = 1_000
#: What all ordinary lines weigh together in training, and what a wording weighs with its variants.
ORDINARY, EACH = 200.0, 8.0
#: Words of a fragment of a long wording, as wrapping makes them, and the step between two.
FRAGMENT, STEP = 12, 6
#: Marks of comments at the beginning of a line, and a line that is wrapped: short and followed by one that is not blank.
MARKS = r"(?m)^[ \t]*(?:/\*+|\*+/?|//+|#+|;+|--+|%+|<!--)[ \t]*"
WRAPPED = r"(?m)^([^\n]{1,120})\n(?=[ \t\r]*[^\s])"
#: Part of a template's words that a paragraph must have to confirm a family, and not to be ordinary.
CONFIRM, FLOOR = 0.8, 0.34
#: Part of the held-out notices of families that the calibrated probability lets pass and part of those of unseen
#: licences that it stops; its least and its greatest value.
PASS, STOP, LEAST, MOST = 0.95, 0.95, 0.5, 0.95


def terms_of(line: Column) -> Column:
    """Words, lower-cased runs of letters, digits, dots and hyphens without these at the ends, and pairs of neighbours."""
    tokens = F.regexp_extract_all(F.lower(line), F.lit(r"[a-z0-9]+(?:[.-][a-z0-9]+)*"), F.lit(0))
    pairs = F.zip_with(tokens, F.slice(tokens, F.lit(2), F.lit(1 << 30)), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(tokens) > 0, F.concat(tokens, F.slice(pairs, F.lit(1), F.size(tokens) - 1))).otherwise(F.array().cast("array<string>"))


def lines_of(text: Column) -> Column:
    """Paragraphs with a letter: each line without comment marks, and each block of wrapped lines as one."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), MARKS, "")
    joined = F.regexp_replace(body, WRAPPED, "$1 ")
    return F.filter(F.array_distinct(F.concat(F.split(body, "\n"), F.split(joined, "\n"))), lambda line: line.rlike(r"\p{L}"))


def variants(text: str) -> list[str]:
    """A wording whole, with one word left out in turn, and fragments of it."""
    split = text.split()
    out = [text]
    if len(split) > 3:
        out += [" ".join(split[:i] + split[i + 1 :]) for i in range(len(split))]
    if len(split) > FRAGMENT + STEP:
        out += [" ".join(split[i : i + FRAGMENT]) for i in range(0, len(split) - STEP, STEP)]
    return out


def notices() -> list[tuple[str, str, bool, float]]:
    """Training rows: class, wording, whether it is held out, weight. Of a family every fifth variant is held out, of ``UNSEEN`` all."""
    rows = []
    for family, wordings in [*TEMPLATES.items(), (UNKNOWN, OTHER), (NONE, ORDINARY_WORDS)]:
        for text in wordings:
            made = variants(text)
            rows += [(family, t, i % 5 == 4, EACH / len(made)) for i, t in enumerate(made)]
    return rows + [(UNKNOWN, text, True, 1.0) for text in UNSEEN]


class Model:
    """Classes, bias of each, weights ``{term: weights}``, the probability from which a family stands, and terms of
    which a paragraph must have one not to be ``none``."""

    def __init__(self, classes: list[str], bias: list[float], weights: dict[str, list[float]], bar: float, seen: dict[str, int]):
        self.classes, self.bias, self.weights, self.bar = classes, bias, weights, bar
        self.cues = _cues(bias, weights, seen)


def _cues(bias: list[float], weights: dict[str, list[float]], seen: dict[str, int]) -> list[str]:
    """Terms of which each paragraph that is not ``none``, the last class, has one.

    What speaks for a class is the lead of its weight over that of ``none``. Terms are left out as long as all of
    them together, for each class, lead by less than its bias is behind: those first that ordinary lines have
    often (``seen``) for the little they lead.
    """
    gap = [bias[-1] - b for b in bias[:-1]]
    if min(gap) <= 0:
        return sorted(weights)
    lead = {t: [max(0.0, v - w[-1]) for v in w[:-1]] for t, w in weights.items() if max(w[:-1]) > w[-1]}
    spent, kept = [0.0] * len(gap), []
    for t in sorted(lead, key=lambda t: (-seen.get(t, 0) / max(lead[t]), t)):
        more = [x + y for x, y in zip(spent, lead[t], strict=True)]
        if all(x < g - 1e-6 for x, g in zip(more, gap, strict=True)):
            spent = more
        else:
            kept.append(t)
    return kept


def _pattern(cues: list[str]) -> str:
    """A pattern of the cues as whole words, by first letter, so that a word is held against few of them."""
    by_letter: dict[str, list[str]] = {}
    for t in sorted(cues):
        by_letter.setdefault(t[0], []).append(r"[^a-z0-9]+".join(map(re.escape, t.split()))[len(re.escape(t[0])) :])
    return r"(?<![a-z0-9])(?:" + "|".join(f"{k}(?:{'|'.join(v)})" for k, v in by_letter.items()) + r")(?![a-z0-9])" if cues else "(?!)"


def train(spark: SparkSession, docs: DataFrame, text: str = "text", most: int = MAX_DOCS) -> Model:
    """Fit on the notices and the lines of about ``most`` documents that name no licence."""
    n = docs.count()
    drawn = docs.where(F.xxhash64(text) < -(1 << 63) + (most << 64) // n) if n > most else docs
    lines = drawn.select(F.explode(lines_of(F.col(text))).alias("line")).where(~F.lower("line").rlike("licen[cs]e|copyright|spdx"))
    wordings = [t for own in [*TEMPLATES.values(), OTHER] for t in own]
    plain = lines.where(_fit(F.col("line"), wordings) < F.lit(0.5)).cache()
    each = min(1.0, ORDINARY / max(plain.count(), 1))
    given = spark.createDataFrame([*notices(), (NONE, "", False, 1.0)], "family string, line string, held boolean, weight double")
    rows = given.unionByName(plain.select(F.lit(NONE).alias("family"), "line", F.lit(False).alias("held"), F.lit(each).alias("weight")))
    classes = [*TEMPLATES, UNKNOWN, NONE]
    number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("family")).cast("double") - 1
    rows = rows.select(number.alias("label"), terms_of(F.col("line")).alias("terms"), "held", "weight").cache()
    counter = CountVectorizer(inputCol="terms", outputCol="x", binary=True, vocabSize=4096, minDF=2.0).fit(rows.where("NOT held AND label < %d" % (len(classes) - 1)))
    table = counter.transform(rows)
    fitted = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", family="multinomial", regParam=0.002, elasticNetParam=0.9, maxIter=60).fit(table.where("NOT held"))
    matrix = fitted.coefficientMatrix.toArray()
    weights = {t: [round(float(v), 6) for v in matrix[:, i]] for i, t in enumerate(counter.vocabulary) if abs(matrix[:, i]).max() > 1e-6}
    told = fitted.transform(table.where("held AND label <= %d" % len(TEMPLATES))).where("prediction < %d" % len(TEMPLATES))
    sure = [(r[0], r[1]) for r in told.select(F.col("label") == F.col("prediction"), F.array_max(vector_to_array("probability"))).collect()]
    right, wrong = (sorted(p for good, p in sure if good == want) for want in (True, False))
    ordinary = rows.where("label = %d" % (len(classes) - 1)).select(F.explode("terms").alias("term")).where(F.col("term").isin(list(weights)))
    seen = {r["term"]: r["count"] for r in ordinary.groupBy("term").count().collect()}
    rows.unpersist()
    plain.unpersist()
    bars = [LEAST]
    if right:
        bars.append(right[int((1 - PASS) * len(right))])
    if wrong:
        bars.append(wrong[min(len(wrong) - 1, int(STOP * len(wrong)))] + 1e-6)
    return Model(classes, [round(float(b), 6) for b in fitted.interceptVector.toArray()], weights, round(min(max(bars), MOST), 6), seen)


def paragraphs(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Licence paragraphs of ``docs(row, text)``: row, at (line number), line, family, probability, confirmed."""
    spark = docs.sparkSession
    weights = spark.createDataFrame([(t, *w) for t, w in model.weights.items()] or [("", *[0.0] * len(model.classes))], "term string, " + ", ".join(f"w{i} double" for i in range(len(model.classes))))
    cue = _pattern(model.cues)
    lines = docs.where(F.lower(text).rlike(cue)).select("row", F.posexplode(lines_of(F.col(text))).alias("at", "line")).where(F.lower("line").rlike(cue))
    grams = lines.select("row", "at", "line", F.explode(F.array_distinct(terms_of(F.col("line")))).alias("term"))
    sums = grams.join(F.broadcast(weights), "term").groupBy("row", "at", "line").agg(*[(F.sum(f"w{i}") + F.lit(b)).alias(f"z{i}") for i, b in enumerate(model.bias)])
    z = F.array(*[f"z{i}" for i in range(len(model.classes))])
    top = F.array_max(z)
    total = F.aggregate(F.transform(z, lambda v: F.exp(v - top)), F.lit(0.0), lambda a, b: a + b)
    best = F.element_at(F.array(*[F.lit(c) for c in model.classes]), F.array_position(z, top).cast("int"))
    scored = sums.select("row", "at", "line", best.alias("best"), F.round(1 / total, 6).alias("probability")).where(F.col("best") != NONE)
    own, other = _family_fit(F.col("line"), F.col("best")), _fit(F.col("line"), OTHER)
    fits = scored.withColumn("own", own).withColumn("other", other).where((F.col("best") == UNKNOWN) | (F.col("own") >= FLOOR))
    rival = (F.col("other") >= CONFIRM) & (F.col("other") >= F.col("own"))
    named = fits.withColumn("family", F.when((F.col("probability") >= model.bar) & ~rival, F.col("best")).otherwise(F.lit(UNKNOWN)))
    return named.withColumn("confirmed", (F.col("family") != UNKNOWN) & (F.col("own") >= CONFIRM)).select("row", "at", "line", "family", "probability", "confirmed")


def _fit(line: Column, wordings: list[str]) -> Column:
    """The largest part of the words of one of ``wordings`` that the line has."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(line), F.lit("[a-z0-9]+"), F.lit(0)))
    parts = [F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in sorted(own)]))) / F.lit(float(len(own))) for t in wordings if (own := set(re.findall("[a-z0-9]+", t.lower())))]
    return F.array_max(F.array(*parts))


def _family_fit(line: Column, family: Column) -> Column:
    """``_fit`` of the templates of the line's family, 0 if it has none."""
    fit = F.lit(0.0)
    for name, wordings in TEMPLATES.items():
        fit = F.when(family == name, _fit(line, wordings)).otherwise(fit)
    return fit


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, family, probability, confirmed, n_paragraphs.

    The family is that of the most probable licence paragraph, confirmed ones first, then the earliest;
    ``none`` with probability 0 where there is none, as for null and empty texts. Repeated rows are scanned
    one by one; rows keep a null id. An empty table gives an empty result. Texts are read whole.
    """
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    model = model or train(docs.sparkSession, given)
    rows = given.withColumn("row", F.sha2(F.concat_ws("\0", F.col("doc_id").cast("string"), "text"), 256))
    found = paragraphs(rows, model)
    order = Window.partitionBy("row").orderBy(F.desc("confirmed"), F.desc("probability"), "at")
    best = found.distinct().withColumn("r", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("row"))).where("r = 1")
    held = best.select("row", "family", "probability", "confirmed", F.col("n").alias("n_paragraphs"))
    return rows.select("doc_id", "row").join(held, "row", "left").select("doc_id", F.coalesce("family", F.lit(NONE)).alias("family"), F.coalesce("probability", F.lit(0.0)).alias("probability"), F.coalesce("confirmed", F.lit(False)).alias("confirmed"), F.coalesce("n_paragraphs", F.lit(0)).cast("long").alias("n_paragraphs"))
