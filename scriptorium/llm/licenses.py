"""Licence scan with a trained paragraph classifier.

A multinomial logistic regression over binary word 1- and 2-grams with an L1 penalty (so most weights are zero) tells the
licence family of a paragraph, or that it is none. It is trained on the notices below and on names of licences in common forms, each varied by dropping words, and on
at most about `negatives` paragraphs of the corpus without a licence cue or name. The unknown class is calibrated on notices that a first
model has not seen in any form, and on corpus paragraphs it has not seen: the least probability from which `precision` of the
predictions that the seen notices confirm are right. A prediction is confirmed by comparison with
the notices of its family: the share of the smaller bigram set that both have must reach `overlap`.

A paragraph is a line, and so is every run of two lines or more that may belong to one notice: hard-wrapped notices are judged
as a whole. The run is reported, at its first line, in place of its lines where it is confirmed and at least three more word
pairs of a notice meet than in any of its lines; a line that is more like another family's notices is still reported by itself.

Scale. Every line is cut into grams, and its weights are added up in place. Lines that are predicted other than none, hold a
cue or share three word pairs (a short line: all) with the notices (to complete wrapped ones) go on; each different paragraph of them is scored once: its grams meet the weights (at most `vocabulary` rows, sent to all executors)
and their sums are aggregated by paragraph. No Python runs on the executors; fitting is Spark's own, on a bounded sample.

Edge cases. Null or empty text has no paragraphs; a blank line ends a run. Of equally probable families the first by name is predicted.
A very long text is one array of lines. Paragraphs predicted other than none but not
confirmed, and cues without a known family, are reported with family null (unknown). Repeated rows are reported as often as they occur. Empty table: no rows. Further columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable

#: Notices of licence families.
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "SPDX-License-Identifier: MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, express or implied", "MIT licensed.", "Distributed under MIT."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the Apache License, Version 2.0. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0", "Released under Apache-2.0.", "Available under the terms of Apache 2.0.", "Released under Apache.", "Licensed under Apache."],
    "MIT OR Apache-2.0": ["Dual MIT/Apache-2.0.", "Dual licensed under MIT and Apache-2.0.", "Licensed under either of Apache-2.0 or MIT at your option.", "SPDX-License-Identifier: MIT OR Apache-2.0"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version", "SPDX-License-Identifier: GPL-3.0-or-later", "Released under the GNU GPL version 2 license", "Distributed under GPLv3 or later.", "Released under GPLv2.", "Available under the terms of the GPL 3.0.", "Released under GPL-3.0."],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: LGPL-2.1-or-later", "Distributed under LGPLv3 or later.", "Available under the terms of the LGPL 2.1.", "Released under LGPL-2.1."],
    "BSD": ["Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-3-Clause", "Released under the two-clause BSD license", "Released under BSD-3-Clause.", "Released under BSD-2-Clause.", "Distributed under BSD."],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.", "Licensed under the Mozilla Public License 2.0", "SPDX-License-Identifier: MPL-2.0", "Available under the terms of the MPL 2.0.", "Released under MPL-2.0."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0", "CC-BY 4.0", "Available under CC-BY-4.0."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0", "CC-BY-NC 4.0", "Available under CC-BY-NC-4.0."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0", "CC-BY-SA 4.0", "Available under CC-BY-SA-4.0."],
    "public-domain": ["This is free and unencumbered software released into the public domain.", "Released under CC0 1.0 Universal: no copyright, dedicated to the public domain.", "SPDX-License-Identifier: CC0-1.0"],
    "proprietary": ["All rights reserved.", "All rights reserved", "All rights are reserved.", "Alle Rechte vorbehalten. All rights reserved.", "All rights reserved by the copyright holder.", "Proprietary and confidential. All rights reserved.", "Copyright. All rights reserved.", "Copyright (c) 2020 by the authors. All rights reserved.", "(c) 2019 Example Ltd. All rights reserved.", "Copyright 2021 The Company, all rights reserved.", "All rights reserved worldwide.", "All content is copyright of its owners. All rights reserved.", "No part of this publication may be reproduced without the prior written permission of the publisher. All rights reserved."],
}
#: Names of licences by family.
NAMES = {
    "MIT": ["MIT License", "MIT licence", "Expat License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License Version 2.0, January 2004", "Apache License 2.0", "Apache 2.0", "Apache-2.0"],
    "GPL": ["GNU General Public License v2", "GNU General Public License version 3", "GNU General Public License", "GNU GPL", "GNU GPL v3", "GPL", "GPL v2", "GPLv2", "GPLv3", "GPL-2.0", "GPL-3.0"],
    "LGPL": ["GNU Lesser General Public License", "GNU Lesser General Public License v2.1", "GNU LGPL", "LGPL", "LGPL v3", "LGPLv2.1", "LGPLv3", "LGPL-2.1", "LGPL-3.0"],
    "AGPL": ["GNU Affero General Public License", "GNU Affero General Public License v3", "Affero GPL", "GNU AGPL", "AGPL", "AGPL v3", "AGPLv3", "AGPL-3.0"],
    "BSD": ["BSD 3-Clause License", "BSD 2-Clause License", "BSD License", "BSD licence", "3-clause BSD license", "BSD-3-Clause", "BSD-2-Clause"],
    "MPL": ["Mozilla Public License 2.0", "Mozilla Public License", "MPL 2.0", "MPL-2.0", "MPLv2"],
    "ISC": ["ISC License", "ISC licence"],
    "EPL": ["Eclipse Public License 2.0", "Eclipse Public License", "EPL 2.0", "EPL-2.0"],
    "EUPL": ["European Union Public Licence", "European Union Public Licence v1.2", "EUPL", "EUPL 1.2", "EUPL-1.2"],
    "CC-BY": ["Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "CC BY 4.0", "CC-BY 4.0", "CC-BY-4.0"],
    "CC-BY-NC": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC-BY-NC 4.0", "CC-BY-NC-4.0"],
    "CC-BY-SA": ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC-BY-SA 4.0", "CC-BY-SA-4.0"],
    "public-domain": ["CC0 1.0 Universal", "CC0", "CC0-1.0", "Unlicense"],
}
#: What stands around a name in a notice.
FORMS = ["{}", "{}.", "Released under {}", "Released under the {}.", "Licensed under the {}.", "License: {}", "Licence: {}", "Distributed under the terms of the {}.", "This program is released under the terms of the {}.", "This software is available under {}."]


def notices() -> dict[str, list[str]]:
    """The notices of each family: those above, and every name in every form."""
    made = {family: [form.format(name) for name in names for form in FORMS] for family, names in NAMES.items()}
    return {family: list(dict.fromkeys([*NOTICES.get(family, []), *made.get(family, [])])) for family in sorted({*NOTICES, *NAMES})}


#: Sentences with a cue or a word of a short form (in German, mit) that are no licence notices.
OTHERS = [
    "Their driving license was renewed last week at the office.", "She asked for permission to leave the room early.", "The warranty of the washing machine ended in spring.",
    "A licensed guide led the group over the pass.", "The story is in the public library of the town.", "The copyright lawyer gave a talk about music.", "He got a fishing licence for the lake.",
    "Er kam mit dem Zug und ging mit ihr in die Stadt.", "Mit der Zeit ist das nicht mehr so.", "Wir sind mit dem Wagen auf dem Weg.", "Das ist mit und ohne ihn gut.", "Mit ist.", "Was du mit von auch für.",
    "He kept all rights reserved for the king.", "The crown had all rights reserved to itself in those lands.", "All rights reserved to the elders were given up.", "With all rights reserved by the guild, no trader came.", "The town kept all rights reserved for its own people.", "She kept all rights reserved until the autumn.", "He had kept all rights reserved for a year.", "The Apache people lived in the hills.", "The eclipse was seen by the public.",
    "The public was under the terms of the treaty.", "Under the terms of the general peace they left.", "The European Union met in public.", "Universal terms of trade were released in May.", "The program is available at the door.", "Version 2.0 of the program was released in January 2004.",
    "It was written by hand at the end of this year.", "This is one or the other of them.", "They were under the bridge by the river.",
]
CUE = r"(?i)licen[cs]|copyright|public domain|all rights reserved|permission is hereby|redistribut|\bspdx\b|creative commons|\bcc0\b|\bcc by\b|\bgnu\b"
NONE = "none"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"), F.lit(0))


def _words(text: str) -> list[str]:
    """words() of a notice."""
    return re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", text.lower())


def _pairs(text: str) -> set[str]:
    """compared() of a text."""
    w = _words(text)
    return {" ".join(p) for p in zip(w, w[1:])} | {x for x in w if x in SINGLE}


def bigrams(w: Column) -> Column:
    follow = F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0)))
    return F.slice(F.zip_with(w, follow, lambda a, b: F.concat_ws(" ", a, b)), F.lit(1), F.greatest(F.size(w) - 1, F.lit(0)))


def grams(w: Column) -> Column:
    return F.array_distinct(F.concat(w, bigrams(w)))


#: Names of one word: they are compared as they stand, all else by its word pairs.
SINGLE = sorted({w[0] for names in NAMES.values() for name in names for w in [_words(name)] if len(w) == 1})


def compared(w: Column) -> Column:
    """What paragraphs and notices are compared by: word pairs, and names of one word."""
    return F.concat(bigrams(w), F.filter(w, lambda x: x.isin(SINGLE)))


@dataclass
class LicenseModel:
    families: list[str]
    intercepts: list[float]
    weights: list[tuple[str, list[float]]]
    least: float

    def other_than_none(self, w: Column, pairs: Column) -> Column:
        """Whether the sums of a paragraph's weights put a family above none, from its words and bigrams; as scored() has it, without a join."""
        if NONE not in self.families:
            return F.lit(True)
        none, known = self.families.index(NONE), [gram for gram, _ in self.weights]
        starts = F.array(*[F.lit(b) for b in self.intercepts])
        weights = F.map_from_arrays(F.array(*[F.lit(g) for g in known]), F.array(*[F.array(*[F.lit(x) for x in ws]) for _, ws in self.weights])) if known else None
        if not known:
            return F.lit(max(self.intercepts) > self.intercepts[none])
        # A hash lookup drops grams without a weight; the map is met by the few that are left.
        hits = F.array_distinct(F.concat(F.filter(w, lambda g: g.isin(known)), F.filter(pairs, lambda g: g.isin(known))))
        sums = F.aggregate(hits, starts, lambda acc, g: F.zip_with(acc, F.element_at(weights, g), lambda a, b: a + b))
        return F.transform(F.array(sums), lambda m: F.array_max(m) > m[none])[0]

    def scored(self, paragraphs: DataFrame) -> DataFrame:
        """paragraph, predicted and probability of distinct paragraphs."""
        spark = paragraphs.sparkSession
        table = spark.createDataFrame(self.weights or [("", [0.0] * len(self.families))], "gram string, w array<double>")
        rows = paragraphs.select("paragraph", F.explode_outer(grams(words(F.col("paragraph")))).alias("gram")).join(F.broadcast(table), "gram", "left")
        sums = rows.groupBy("paragraph").agg(*[F.sum(F.coalesce(F.col("w")[i], F.lit(0.0))).alias(f"s{i}") for i in range(len(self.families))])
        margins = F.array(*[F.col(f"s{i}") + F.lit(b) for i, b in enumerate(self.intercepts)])
        rows = sums.select("paragraph", margins.alias("m")).withColumn("top", F.array_max("m"))
        total = F.aggregate(F.transform("m", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, b: a + b)
        names = F.array(*[F.lit(f) for f in self.families])
        return rows.select("paragraph", F.element_at(names, F.array_position("m", F.col("top")).cast("int")).alias("predicted"), (1 / total).alias("probability"))


def _variants(spark: SparkSession, copies: int) -> DataFrame:
    """text and family of the notices, each with `copies` variants from which words are dropped."""
    rows = [(t, f) for f, ts in notices().items() for t in ts] + [(t, NONE) for t in OTHERS]
    base = spark.createDataFrame(rows, "paragraph string, family string").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies))))
    kept = F.filter(F.split("paragraph", " "), lambda w, i: (F.col("copy") == 0) | (F.pmod(F.xxhash64(w, i, F.col("copy")), F.lit(100)) >= 12))
    return base.select(F.array_join(kept, " ").alias("paragraph"), "family", F.pmod(F.xxhash64("paragraph"), F.lit(4)).alias("fold"))  # all forms of a notice are in one fold


def train(docs: DataFrame, text_col: str = "text", negatives: int = 4000, vocabulary: int = 4096, copies: int = 8, precision: float = 0.99, overlap: float = 0.5) -> LicenseModel:
    """Fit on the notices and on about `negatives` paragraphs of the corpus without a cue or a licence's one-word name (one line of a sampled document)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer

    n = max(1, docs.count())
    some = docs.select(F.col(text_col).cast("string").alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < min(1.0, negatives / n) * (1 << 20))
    line = F.split("text", "\n")[0]
    plain = some.select(line.alias("paragraph"), F.lit(NONE).alias("family"), F.pmod(F.xxhash64("text", F.lit(3)), F.lit(4)).alias("fold")).where(F.col("paragraph").isNotNull() & ~F.col("paragraph").rlike(CUE) & ~F.exists(words(F.col("paragraph")), lambda w: w.isin(SINGLE)))
    rows = durable(_variants(docs.sparkSession, copies).union(plain).withColumn("grams", grams(words(F.col("paragraph")))).coalesce(4))
    # Grams of every day (in more than a hundredth of the corpus paragraphs) tell nothing, and would be looked up in every line. There are at most a hundred times a paragraph's grams.
    usual = plain.select(F.explode(grams(words(F.col("paragraph")))).alias("gram")).groupBy("gram").count().where(F.col("count") > max(5.0, plain.count() / 100)).select("gram")
    rows = durable(rows.withColumn("grams", F.filter("grams", lambda g: ~g.isin([r["gram"] for r in usual.collect()]))))
    families = sorted([*notices(), NONE])
    number = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")).cast("double") - 1
    vector = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=vocabulary, minDF=3, binary=True).fit(rows)
    ready = durable(vector.transform(rows.withColumn("label", number)).select("fold", "label", "features"))

    def fitted(on: DataFrame) -> LicenseModel:
        found = LogisticRegression(maxIter=40, regParam=0.001, elasticNetParam=1.0, family="multinomial", standardization=False).fit(on)
        matrix = found.coefficientMatrix.toArray()
        place = {int(label): i for i, label in enumerate(range(matrix.shape[0]))}
        weights = [(gram, [float(matrix[place[n], i]) if n in place else 0.0 for n in range(len(families))]) for i, gram in enumerate(vector.vocabulary) if matrix[:, i].any()]
        return LicenseModel(families, [float(found.interceptVector[n]) if n in place else -1e9 for n in range(len(families))], weights, 0.5)

    model = fitted(ready)
    # Calibration: at most some thousand paragraphs that the first model was not trained on, as far as the notices it has seen confirm them.
    check = rows.where("fold = 0").select("paragraph", "family").distinct()
    told = fitted(ready.where("fold > 0")).scored(check.select("paragraph").distinct())
    seen = check.join(told, "paragraph").where(F.col("predicted") != NONE).collect()
    known: dict[str, list[set]] = {}
    for r in _variants(docs.sparkSession, 0).where("fold > 0").collect():
        known.setdefault(r["family"], []).append(_pairs(r["paragraph"]))
    like = lambda mine, of: max((len(mine & t) / max(1, min(len(mine), len(t))) for t in known.get(of, [])), default=0.0)
    right = total = 0
    for r in sorted((r for r in seen if like(_pairs(r["paragraph"]), r["predicted"]) >= overlap), key=lambda r: -r["probability"]):
        right, total = right + (r["predicted"] == r["family"]), total + 1
        if right >= precision * total:
            model.least = min(0.95, r["probability"])
    return model


def scan(docs: DataFrame, model: LicenseModel, id_col: str = "doc_id", text_col: str = "text", overlap: float = 0.5) -> DataFrame:
    """doc_id, line (number from 0), paragraph, family (null: unknown), probability and likeness of every paragraph with a cue or predicted other than none."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    lines = rows.select("row", "doc_id", F.posexplode(F.split("text", "\n")).alias("line", "paragraph"))
    cue = F.col("paragraph").rlike(CUE)
    # Lines that share some word pairs with a notice only complete a wrapped notice; names in short forms are not wrapped.
    pairs = sorted({" ".join(p) for ts in NOTICES.values() for t in ts for w in [_words(t)] for p in zip(w, w[1:])})
    near = lambda b: F.size(F.filter(b, lambda g: g.isin(pairs))) >= F.greatest(F.least(F.size(b), F.lit(3)), F.lit(1))
    # Names bound by lambdas are evaluated once a line, wherever the optimizer puts the filter.
    judged = F.transform(F.array(words(F.col("paragraph"))), lambda w: F.transform(F.array(bigrams(w)), lambda b: model.other_than_none(w, b) | near(b))[0])[0]
    some = lines.where(cue | judged).select("row", "doc_id", "line", "paragraph", cue.alias("cue"))
    # Candidates only, so a document's window holds few lines.
    some = durable(some.withColumn("run", F.col("line") - F.row_number().over(Window.partitionBy("row").orderBy("line"))))
    joined = some.groupBy("row", "doc_id", "run").agg(F.array_sort(F.collect_list(F.struct("line", "paragraph"))).alias("of")).where(F.size("of") > 1)
    joined = durable(joined.select("row", "run", F.array_join(F.transform("of", lambda x: x["paragraph"]), "\n").alias("paragraph")))

    told = spark.createDataFrame([(f, t) for f, ts in notices().items() for t in ts], "predicted string, notice string")
    known = told.groupBy("predicted").agg(F.collect_set(F.array_sort(F.array_distinct(compared(words(F.col("notice")))))).alias("notices"))
    mine = lambda p: F.array_distinct(compared(words(F.col(p))))
    share = lambda t: F.size(F.array_intersect("mine", t)) / F.greatest(F.least(F.size("mine"), F.size(t)), F.lit(1))
    scored = model.scored(some.select("paragraph").union(joined.select("paragraph")).distinct())
    likened = scored.join(F.broadcast(known), "predicted", "left").withColumn("mine", mine("paragraph"))
    likened = likened.withColumns({"likeness": F.coalesce(F.array_max(F.transform("notices", share)), F.lit(0.0)), "shared": F.coalesce(F.array_max(F.transform("notices", lambda t: F.size(F.array_intersect("mine", t)))), F.lit(0))})
    sure = (F.col("predicted") != NONE) & (F.col("probability") >= model.least) & (F.col("likeness") >= overlap)
    decided = durable(likened.select("paragraph", "predicted", F.when(sure, F.col("predicted")).alias("family"), "probability", "likeness", "shared"))

    single = some.join(decided, "paragraph")
    runs = joined.join(decided.where("family IS NOT NULL"), "paragraph").select("row", "run", *[F.col(c).alias(f"run_{c}") for c in ("family", "probability", "likeness", "shared")])
    best = single.groupBy("row", "run").agg(F.max("shared").alias("best"))
    runs = runs.join(best, ["row", "run"]).where(F.col("run_shared") > F.col("best") + 2).drop("best")
    both = single.join(runs, ["row", "run"], "left").join(F.broadcast(known.select(F.col("predicted").alias("run_family"), F.col("notices").alias("run_notices"))), "run_family", "left")
    like_run = F.coalesce(F.array_max(F.transform("run_notices", share)), F.lit(0.0))
    both = both.withColumn("mine", F.when(F.col("run_family").isNotNull(), mine("paragraph"))).withColumn("covered", F.col("run_family").isNotNull() & (F.col("family").isNull() | (like_run >= F.col("likeness")))).drop("mine", "run_notices")
    alone = both.where(~F.col("covered") & (F.col("cue") | (F.col("predicted") != NONE))).select("doc_id", "line", "paragraph", "family", "probability", "likeness")
    whole = both.where("covered").groupBy("row", "run", "doc_id", "run_family", "run_probability", "run_likeness").agg(F.array_sort(F.collect_list(F.struct("line", "paragraph"))).alias("of"))
    whole = whole.select("doc_id", F.col("of")[0]["line"].alias("line"), F.array_join(F.transform("of", lambda x: x["paragraph"]), "\n").alias("paragraph"), F.col("run_family").alias("family"), F.col("run_probability").alias("probability"), F.col("run_likeness").alias("likeness"))
    return alone.union(whole)
