"""Licence notices without a cue word, in short forms and hard-wrapped; scores against plain sums of weights."""

import math
import random

from scriptorium.llm import licenses

SHORT = [
    ("Distributed under GPLv3 or later.", "GPL"), ("Available under the terms of the MPL 2.0.", "MPL"), ("Dual MIT/Apache-2.0.", "MIT OR Apache-2.0"), ("CC-BY-SA 4.0", "CC-BY-SA"),
    ("Released under BSD-3-Clause.", "BSD"), ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.', "MIT"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
]
WRAPPED = "You can redistribute it and/or modify it\nunder the terms of the GNU Lesser General\nPublic License as published by the Free\nSoftware Foundation"


def test_notices_without_cue_and_wrapped_ones(spark):
    rng = random.Random(5)
    prose = lambda: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(20))
    rows = [(i, f"{prose()}\n{prose()}") for i in range(60)]
    rows += [(100 + i, f"{prose()}\n{notice}\n{prose()}") for i, (notice, _) in enumerate(SHORT)]
    rows += [(200, f"{prose()}\n{WRAPPED}\n{prose()}"), (201, "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = licenses.scan(docs, licenses.train(docs)).collect()
    got = {(r["doc_id"], r["line"], r["family"]) for r in found}
    assert got >= {(100 + i, 1, family) for i, (_, family) in enumerate(SHORT)}
    assert [(r["line"], r["paragraph"], r["family"]) for r in found if r["doc_id"] == 200] == [(1, WRAPPED, "LGPL")]
    assert {x for x in got if x[0] == 201} == {(201, 0, "MIT"), (201, 1, "Apache-2.0")}
    assert not [x for x in got if x[0] < 100]


def test_scores_are_plain_sums_of_weights(spark):
    rng = random.Random(6)
    prose = lambda: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(20))
    model = licenses.train(spark.createDataFrame([(i, prose()) for i in range(80)], "doc_id long, text string"))
    weights = dict(model.weights)
    texts = [notice for notice, _ in SHORT] + [WRAPPED, prose(), "licensed", "", "MIT MIT MIT", "under the terms of the Public License"]
    rows = spark.createDataFrame([(t,) for t in texts], "paragraph string")
    found = {r["paragraph"]: r for r in model.scored(rows).collect()}
    direct = {r["paragraph"]: r["other"] for r in rows.select("paragraph", model.other_than_none(licenses.words(rows.paragraph), licenses.bigrams(licenses.words(rows.paragraph))).alias("other")).collect()}
    assert len(found) == len(texts)
    for text in texts:
        words = licenses._words(text)
        grams = set(words) | {" ".join(p) for p in zip(words, words[1:])}
        margins = [b + sum(weights[g][i] for g in grams if g in weights) for i, b in enumerate(model.intercepts)]
        top = max(margins)
        assert abs(found[text]["probability"] - 1 / sum(math.exp(m - top) for m in margins)) < 1e-9
        assert margins[model.families.index(found[text]["predicted"])] >= top - 1e-9
        assert direct[text] == (top > margins[model.families.index(licenses.NONE)])
    assert 0 < model.least <= 0.95 and licenses.scan(spark.createDataFrame([], "doc_id long, text string, `row` string, line string, `run` string"), model).count() == 0
    clash = spark.createDataFrame([(1, "Released under the MIT License.", "a", "b", "c"), (2, None, "a", "b", "c")], "doc_id long, text string, `row` string, line string, `run` string")
    assert [(r["doc_id"], r["family"]) for r in licenses.scan(clash, model).collect()] == [(1, "MIT")]


#: Wordings that no notice of the module has.
HELD_OUT = ["The code is published under the {}", "Use of this package is governed by the {}", "Source files are covered by {}, see below", "{} applies to all of it", "Unless noted, everything here is under {}"]


def test_wordings_that_are_not_among_the_notices(spark):
    rng = random.Random(8)
    prose = lambda: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(20))
    rows = [(i, f"{prose()}\n{prose()}", None) for i in range(80)]
    model = licenses.train(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"))
    wanted = []
    for family, names in licenses.NAMES.items():
        for name in names:
            for form in HELD_OUT:
                wanted.append((1000 + len(wanted), form.format(name), family))
    wanted += [(5000, "This program is released under the terms of the GNU General Public License v2", "GPL"), (5001, "released under Apache", "Apache-2.0"), (5002, "Apache License\nVersion 2.0, January 2004", "Apache-2.0"), (5003, "Licence: LGPL v3", "LGPL"), (5004, "AGPL-3.0", "AGPL"), (5005, "GPL", "GPL")]
    plain = ["he kept all rights reserved for the king", "The guide kept all rights reserved until noon", "mit", "Mit dem Zug", "An Apache helicopter flew over the town", "The general public was not told", "They moved to the public domain of the town hall", "a lesser general of the union", "Version 2.0 came in January 2004", "isc", "The terms of the contract were clear"]
    rows += wanted + [(9000 + i, t, None) for i, t in enumerate(plain)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, family string")
    found = {}
    for r in licenses.scan(docs.drop("family"), model).collect():
        found.setdefault(r["doc_id"], set()).add(r["family"])
    right = sum(family in found.get(i, set()) for i, _, family in wanted)
    wrong = [(i, t, found[i]) for i, t, family in wanted if found.get(i, {None}) - {None, family}]
    assert all(w[2] in found.get(w[0], set()) for w in wanted if w[0] >= 5000), [(w[1], found.get(w[0])) for w in wanted if w[0] >= 5000]
    assert right / len(wanted) >= 0.9, (right, len(wanted), [(t, f, found.get(i)) for i, t, f in wanted if f not in found.get(i, set())][:40])
    assert len(wrong) <= 0.02 * len(wanted), wrong[:20]
    assert not [(t, found[9000 + i]) for i, t in enumerate(plain) if found.get(9000 + i, set()) - {None}]
    assert not any(found.get(i, set()) - {None} for i in range(80))
