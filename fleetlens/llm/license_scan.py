"""Licence scan: a trained paragraph classifier, DataFrame functions and spark.ml (JVM) only.

Paragraphs are the lines of a text, and blocks of lines between blank ones that
carry a licence word, for notices that are wrapped; a block counts only where it
is sure. Each is a sparse vector of the word 1- and
2-grams of a vocabulary learnt in training; multinomial logistic regression
says which licence family it belongs to, or ``none``, or ``unknown``: a licence of
none of the families. Training texts are the
notices below with prefixes, endings and halves, against a bounded, hash-chosen
sample of corpus lines that carry no licence word and a list of near misses.

Calibration: a temperature for the probabilities, on training rows held back, and
the threshold under which a licence-like paragraph is ``unknown``, on those and on
notices of licences that no training row comes from. A
prediction stands only if the paragraph also holds enough of the word pairs of
one of that family's notices; otherwise it is ``unknown`` too.

Null and empty texts have no paragraphs and the family ``none``. Rows never
move but for paragraphs that look like licences, which are few, and ids. Equal rows get
equal answers, of equal confidences the family that comes last by name counts; texts of any
length are read whole, an empty table gives an empty table. Only ``doc_id`` and
``text`` are read, so other columns may have any name; ids may be null, large or repeat,
and rows of one id share their licences.
"""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

TOKEN = r"\p{L}+|[0-9]+(?:\.[0-9]+)*"
VOCABULARY = 8192
SAMPLE_LINES = 2000
CUE = r"(?i)licen[sc]|copyright|all rights|public domain|creative commons|warrant|redistribut|permission|©|\(c\)"
SIMILARITY = 0.6
FALSE_ALARMS = 0.001

#: Notices by family.
NOTICES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "Released under the GNU GPL version 2 or later.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Released under the BSD 3-Clause License.",
        "Licensed under the 2-clause BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "This work is in the public domain.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
        "Copyright 2021 Example Corporation. All rights reserved.",
    ),
}
#: Notices of licences that have no family of their own.
OTHERS = (
    "This software is provided as-is, without any express or implied warranty; in no event will the authors be held liable for any damages.",
    "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "Licensed under the European Union Public Licence, version 1.2.", "Distributed under the Boost Software License, Version 1.0.",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.", "You may use and modify it under the terms of the Artistic License 2.0.",
    "Use of this source code is governed by the terms of the Example Community License.", "Hiermit wird unentgeltlich jeder Person, die eine Kopie der Software erhält, die Erlaubnis erteilt, sie uneingeschränkt zu nutzen.",
    "Diese Datei steht unter einer freien Lizenz.", "Ce logiciel est régi par la licence CeCILL soumise au droit français.", "Este programa es software libre con licencia propia.",
)
#: Notices of licences that the model never sees, for the threshold.
UNSEEN = (
    "Released under the PostgreSQL License.", "Licensed under the Academic Free License version 3.0.", "This database is made available under the Open Database License.",
    "Distributed under the terms of the Python Software Foundation License Version 2.", "Licensed under the Microsoft Reciprocal License.", "This file is covered by the Zope Public License, version 2.1.",
    "SPDX-License-Identifier: Zlib", "SPDX-License-Identifier: BSL-1.0", "Released under the Do What The Fuck You Want To Public License.", "Licensed under the Common Development and Distribution License.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications.", "The licensee may copy this software for teaching and research only.",
)
#: Share of unseen notices that stay below the threshold.
UNSEEN_BELOW = 0.9
#: Sentences that use the same words and are no licence.
NEAR_MISSES = (
    "He was given permission to leave early.", "Her driving licence was renewed in May.", "The licence plate was covered in mud.",
    "The restaurant lost its liquor license last year.", "Poetic license is granted to every writer.", "All passengers reserved their seats.",
    "The rights of the people were reserved by law.", "A general public meeting was held in version of the old hall.",
    "The Apache people lived in the south west.", "She studied at MIT before moving to Paris.", "The work is under way, and free of charge.",
    "Released in 2004, the film was a success.", "The program is free and open to the public.", "The warranty covers parts and labour for two years.",
    "Source and binary stars were observed.", "The Mozilla offices are in the city.", "The file was subject to review.", "Dedicated to my parents.",
)
PREFIXES = ("", "# ", "Note: ", "This file is part of Example. ", "Copyright (c) 2020 Example Authors. ", "© 2019 Jane Roe. ")
ENDINGS = ("", " See LICENSE for details.", " See the file COPYING.")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def notices(spark: SparkSession) -> DataFrame:
    """(family, template_id, notice)."""
    rows = [(f, f"{f}/{i}", t) for f, ts in NOTICES.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "family string, template_id string, notice string")


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, line), a row per line."""
    line = F.explode(F.split(F.coalesce("text", F.lit("")), "\n"))
    return docs.select("doc_id", line.alias("line"))


def paragraphs_of(docs: DataFrame) -> DataFrame:
    """(doc_id, line, block): every line, and blocks of several lines that carry a licence word as one line each."""
    blocks = docs.filter(F.col("text").rlike(CUE)).select("doc_id", F.explode(F.split("text", r"\n[ \t\r]*\n")).alias("line"))
    blocks = blocks.filter(F.trim("line", F.lit(" \t\r\n")).contains("\n") & F.col("line").rlike(CUE))
    blocks = blocks.select("doc_id", F.regexp_replace("line", r"\s+", " ").alias("line"), F.lit(True).alias("block"))
    return lines_of(docs).withColumn("block", F.lit(False)).unionByName(blocks)


def _training_rows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    own = []
    for family, texts in NOTICES.items():
        for t in texts:
            words = t.split()
            bodies = [t, t.rstrip("."), t.lower()] + ([" ".join(words[: 2 * len(words) // 3])] if len(words) > 11 else [])
            own += [(p + b + e, family) for b in bodies for p in PREFIXES for e in ENDINGS]
    own += [(p + b + e, "unknown") for t in OTHERS for b in (t, t.lower()) for p in PREFIXES for e in ENDINGS]
    own += [(p + t + e, "none") for t in NEAR_MISSES for p in PREFIXES[:4] for e in ("", " It was late.", " The end.")]
    made = spark.createDataFrame(own, "line string, family string")
    # Lines are drawn by a hash of their content: about SAMPLE_LINES of them, whatever the size of the corpus.
    n = docs.count()
    few = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) <= 1_000_003 * min(1.0, SAMPLE_LINES / 4 / max(1, n)))
    plain = lines_of(few).filter(~F.col("line").rlike(CUE)).select("line").distinct()
    plain = plain.orderBy(F.xxhash64("line"), "line").limit(SAMPLE_LINES)
    return materialize(made.union(plain.select("line", F.lit("none"))))


def _grams(lines: DataFrame) -> DataFrame:
    words = lines.withColumn("words", tokens(F.col("line")))
    return NGram(n=2, inputCol="words", outputCol="word_pairs").transform(words).withColumn("grams", F.concat("words", "word_pairs"))


class LicenceModel:
    """Vectoriser, classifier, temperature and threshold."""

    def __init__(self, pipeline: PipelineModel, families: list[str], temperature: float, threshold: float):
        self.pipeline, self.families, self.temperature, self.threshold = pipeline, families, temperature, threshold

    def scored(self, lines: DataFrame) -> DataFrame:
        """``lines`` with words, word_pairs, best family and its tempered probability."""
        raw = vector_to_array("rawPrediction")
        out = self.pipeline.transform(_grams(lines)).withColumn("_z", raw)
        top = F.array_max("_z")
        total = F.aggregate("_z", F.lit(0.0), lambda s, z: s + F.exp((z - F.array_max("_z")) / self.temperature))
        place = F.array_position("_z", top).cast("int")
        names = F.array(*[F.lit(f) for f in self.families])
        return out.withColumn("best", F.element_at(names, place)).withColumn("p", 1 / total)


def train(docs: DataFrame) -> LicenceModel:
    spark = docs.sparkSession
    rows = _training_rows(spark, docs)
    families = ["none", "unknown", *sorted(NOTICES)]
    label = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")) - 1
    data = _grams(rows).withColumn("label", label.cast("double")).withColumn("_back", F.pmod(F.xxhash64("line"), F.lit(5)) == 0)
    vectors = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=VOCABULARY, minDF=2.0, binary=True)
    classifier = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=40, standardization=False)
    pipeline = Pipeline(stages=[vectors, classifier]).fit(data.filter("not _back"))
    held = pipeline.transform(data.filter("_back")).select("label", vector_to_array("rawPrediction").alias("z")).collect()  # hundreds of rows
    pairs = [(int(r["label"]), list(r["z"])) for r in held]

    def loss(t: float) -> float:
        return sum(math.log(sum(math.exp((x - z[y]) / t) for x in z)) for y, z in pairs)

    temperature = min((0.25 * 1.25**k for k in range(16)), key=loss) if pairs else 1.0
    alarms = sorted((1 / sum(math.exp((x - max(z[1:])) / temperature) for x in z) for y, z in pairs if y == 0), reverse=True)
    unseen = spark.createDataFrame([(p + t + e,) for t in UNSEEN for p in PREFIXES for e in ENDINGS], "line string")
    shown = pipeline.transform(_grams(unseen)).select(vector_to_array("rawPrediction").alias("z")).collect()  # hundreds of rows
    wrong = sorted(1 / sum(math.exp((x - max(z[2:])) / temperature) for x in z) for z in (list(r["z"]) for r in shown))
    alarm = alarms[int(FALSE_ALARMS * len(alarms))] if alarms else 0.5
    threshold = min(0.95, max(0.5, alarm, wrong[int(UNSEEN_BELOW * len(wrong))]))
    return LicenceModel(pipeline, families, temperature, threshold)


def licence_lines(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """(doc_id, line, family, p, similarity) of the lines that look like a licence."""
    spark = docs.sparkSession
    known = NGram(n=2, inputCol="words", outputCol="pairs").transform(notices(spark).withColumn("words", tokens(F.col("notice"))))
    known = known.groupBy("family").agg(F.collect_list(F.array_distinct("pairs")).alias("notices"))  # one row per family
    found = model.scored(paragraphs_of(docs)).filter(F.col("best") != "none").select("doc_id", "line", "block", "best", "p", "word_pairs")
    met = found.join(F.broadcast(known), found.best == known.family, "left")
    share = F.coalesce(F.array_max(F.transform("notices", lambda t: F.size(F.array_intersect(t, "word_pairs")) / F.size(t))), F.lit(0.0))
    sure = (F.col("p") >= model.threshold) & (share >= SIMILARITY)
    judged = met.select("doc_id", "line", "block", F.when(sure, F.col("best")).otherwise("unknown").alias("family"), "p", share.alias("similarity"))
    return judged.filter(~F.col("block") | (F.col("family") != "unknown")).drop("block")


def scan(docs: DataFrame, model: LicenceModel | None = None) -> DataFrame:
    """One row per document: its surest family (``unknown`` only if no other, else ``none``), all families, counts."""
    model = model or train(docs)
    lines = licence_lines(docs, model)
    by_doc = lines.groupBy("doc_id").agg(
        F.max_by("family", F.struct(F.col("family") != "unknown", "p", "family")).alias("family"),
        F.max(F.struct(F.col("family") != "unknown", "p", "family"))["p"].alias("confidence"),
        F.max("similarity").alias("similarity"),
        F.array_sort(F.collect_set("family")).alias("families"),
        F.count("*").alias("n_licence_lines"),
    )
    ids = docs.select("doc_id")
    return ids.join(by_doc, ids.doc_id.eqNullSafe(by_doc.doc_id), "left").select(
        ids.doc_id, F.coalesce("family", F.lit("none")).alias("family"),
        F.round(F.coalesce("confidence", F.lit(0.0)), 6).alias("confidence"), F.round(F.coalesce("similarity", F.lit(0.0)), 6).alias("similarity"),
        F.coalesce("families", F.array().cast("array<string>")).alias("families"), F.coalesce("n_licence_lines", F.lit(0)).cast("long").alias("n_licence_lines"),
    )
