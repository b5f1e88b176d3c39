"""Searches that read each item once: words of whole texts, and both branches of the case search."""

import random

from pyspark.sql import functions as F

from scriptorium.functions import tokens as T
from scriptorium.operators import cases, retrieval
from scriptorium.plans import workflow

WORDS = ["a", "de", "la", "das", "étés", "ñandú", "über", "x_1", "wort", "fact", "rare", "zz"]


def _rows(seed, n, most):
    r = random.Random(seed)
    return [" ".join(r.choice(WORDS) + r.choice(["", "", ",", ".", " -\n"]) for _ in range(r.randrange(most))) for _ in range(n)]


def _plain(queries, corpus, texts, limit, kind=None, **more):
    out = None
    for name, c in texts.items():
        asked = queries if kind is None else queries.where(F.col(kind) == name)
        got = retrieval.ranked(retrieval.lexical_scores(asked, corpus.withColumn("tokens", T.tokens(F.col(c))), **more), "query_id", "item_id", "score", limit)
        out = got if out is None else out.unionByName(got)
    return sorted(map(tuple, out.select("query_id", "item_id", "overlap", "score", "rank").collect()))


def _asked(spark):
    queries = spark.createDataFrame([(i, t, ("one", "two", "none")[i % 3]) for i, t in enumerate(_rows(1, 12, 9))], "query_id long, text string, part string")
    return queries.withColumn("tokens", T.tokens(F.col("text")))


def test_texts_rank_as_their_tokens_do(spark):
    one, two = _rows(2, 700, 14), _rows(3, 700, 4)
    corpus = spark.createDataFrame([(i, a if i % 50 else None, b) for i, (a, b) in enumerate(zip(one, two))], "item_id long, one string, two string").repartition(3).withColumn("priority", F.col("item_id") % 3 / 10)
    texts = {"one": "one", "two": "two"}
    for more in ({}, {"noise": ("de", "wort")}):
        got = retrieval.text_ranked(_asked(spark), corpus, texts, 5, kind="part", **more).select("query_id", "item_id", "overlap", "score", "rank")
        assert sorted(map(tuple, got.collect())) == _plain(_asked(spark), corpus, texts, 5, "part", **more)
    names = corpus.withColumn("item_id", F.concat(F.lit("n"), "item_id"))
    got = retrieval.text_ranked(_asked(spark), names, {"": "one"}, 5).select("query_id", "item_id", "overlap", "score", "rank")
    assert sorted(map(tuple, got.collect())) == _plain(_asked(spark), names, {"": "one"}, 5)
    assert retrieval.text_ranked(_asked(spark).limit(0), corpus, texts, 5, kind="part").count() == 0


def test_items_that_share_an_id_count_as_one(spark):
    corpus = spark.createDataFrame([(i % 40 if i % 4 == 0 else i, a) for i, a in enumerate(_rows(4, 160, 6))], "item_id long, one string").withColumn("priority", F.lit(0.5))
    queries = _asked(spark)
    got = retrieval.text_ranked(queries, corpus, {"": "one"}, 6).select("query_id", "item_id", "overlap", "score", "rank")
    assert sorted(map(tuple, got.collect())) == _plain(queries, corpus, {"": "one"}, 6)


def test_tags_that_a_question_names(spark):
    corpus = spark.createDataFrame([(i, a, [WORDS[i % 12], "", WORDS[(i + 5) % 12]] if i % 7 else []) for i, a in enumerate(_rows(5, 200, 8))], "item_id long, one string, tags array<string>").withColumn("priority", F.lit(0.9))
    got = retrieval.text_ranked(_asked(spark), corpus, {"": "one"}, 4).select("query_id", "item_id", "overlap", "score", "rank")
    assert sorted(map(tuple, got.collect())) == _plain(_asked(spark), corpus, {"": "one"}, 4)


def _counted(spark, rows):
    """rows, and how many of them have been made in all."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    return rows.mapInArrow(run, rows.schema), made


def test_a_document_is_read_once_for_both_look_ups(spark):
    docs, made = _counted(spark, spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(_rows(6, 90, 9), _rows(7, 90, 9)))], "item_id long, one string, two string"))
    ids = docs.select("item_id")
    asked = _asked(spark).where("part <> 'none'").withColumnRenamed("part", "intent")
    hits = spark.createDataFrame([], "query_id long, case_id long, score double, rank int")
    members = spark.createDataFrame([], "item_id long, members array<string>")
    search = lambda some, k: retrieval.text_ranked(some, docs.withColumn("priority", F.lit(0.5)), {"one": "one", "two": "two"}, k, kind="intent")
    got = workflow.routed(asked, ["one", "two"], hits, members, attempts=1, searched=search)
    before = made.value
    shown = {r["query_id"]: r["items"] for r in got.collect()}
    assert made.value == before == 2 * ids.count()  # once for the ids alone, once for the texts
    corpora = {c: docs.select("item_id", T.tokens(F.col(c)).alias("tokens"), F.lit(0.5).alias("priority")) for c in ("one", "two")}
    assert shown == {r["query_id"]: r["items"] for r in workflow.routed(asked, corpora, hits, members, attempts=1).collect()}


def test_a_case_is_read_once_for_both_branches(spark):
    given = [(i, a, b, "user" if i % 2 else "über", [a.split(" ")[0]], ["user", "das"], [b, a]) for i, (a, b) in enumerate(zip(_rows(8, 300, 12), _rows(9, 300, 12)))]
    rows, made = _counted(spark, spark.createDataFrame(given, "case_id long, title string, summary string, kind string, tags array<string>, roles array<string>, views array<string>").withColumns({"pattern": F.upper("summary"), "conflict": F.lit(""), "actor": F.lit(""), "priority": F.col("case_id") % 3 / 10}))
    index, again = cases.indexed(rows), cases.indexed(spark.createDataFrame(rows.collect(), rows.schema))
    questions = cases.asked(spark.createDataFrame([(i, t + " user") for i, t in enumerate(_rows(10, 9, 12))], "query_id long, text string"))
    before = made.value
    both = cases.branches(questions, index, 4, only=lambda ids: again.join(ids, "case_id", "left_semi"))
    got = {b: sorted(map(str, hits.collect())) for b, hits in both.items()}
    assert made.value - before == len(given)
    assert got == {"sparse": sorted(map(str, cases.sparse_hits(questions, again, 4).collect())), "dense": sorted(map(str, cases.dense_text_hits(questions, again, 4).collect()))}
    assert len(got["sparse"]) == len(got["dense"]) == 36


def test_what_a_hit_shows(spark):
    """One long case that every question finds: terms in the question's order, as its text without blanks holds them."""
    rows = spark.createDataFrame([(1, "wo rt über", "fact " * 3000, "kind", ["über"], ["user"], ["das Rare"]), (2, "", "", "", [], [], [])], "case_id long, title string, summary string, kind string, tags array<string>, roles array<string>, views array<string>")
    index = cases.indexed(rows.withColumns({"pattern": F.lit("Fact"), "conflict": F.lit(""), "actor": F.lit(""), "priority": F.lit(0.5)}))
    asked = cases.asked(spark.createDataFrame([(q, "über wort zz rare fact") for q in range(40)], "query_id long, text string"))
    names = {n: n for n in ("detail", "tag", "role", "view", "kind", "sparse", "pattern", "title", "dense")}
    both = cases.branches(asked, index, 2, names, "{{terms}}")
    sparse, dense = ([r for r in both[b].collect() if r["rank"] == 1] for b in ("sparse", "dense"))
    assert {(r["case_id"], *r["terms"]) for r in sparse} == {(1, "fact", "rare", "wort", "über")} and {tuple(r["fields"]) for r in sparse} == {("detail", "tag")}
    assert {(r["case_id"], *r["terms"]) for r in dense} == {(1, "fact", "wort", "über")} and {tuple(r["fields"]) for r in dense} == {("pattern", "title")}
    assert len(sparse) == len(dense) == 40 and {r["reason"] for r in dense} == {"fact、wort、über"}
