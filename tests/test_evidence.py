"""Spans, fading chapters, bundles, second ranking and perspectives against plain versions."""

import random

from pyspark.sql import functions as F

from scriptorium.operators import evidence


def test_spans_and_fading_chapters(spark):
    rng = random.Random(2)
    rows = [(q, rng.choice(["a", "b", None]), rng.choice([*range(30), None]), round(rng.random(), 3)) for q in (1, 2) for _ in range(25)]
    hits = spark.createDataFrame(rows, "query_id long, chapter string, place long, score double")
    got = sorted((r["query_id"], str(r["chapter"]), r["first"] is not None, r["first"] or 0, r["last"] or 0, r["hits"], r["best"]) for r in evidence.spans(hits, "chapter", "place", gap=2).collect())
    want = []
    for q in (1, 2):
        for chapter in ("a", "b", None):
            own = sorted((p, s) for query, c, p, s in rows if query == q and c == chapter and p is not None)
            for p, s in own:
                if want and want[-1][:2] == [q, str(chapter)] and want[-1][2] and p - want[-1][4] <= 2:
                    want[-1][4:] = [p, want[-1][5] + 1, max(want[-1][6], s)]
                else:
                    want.append([q, str(chapter), True, p, p, 1, s])
            want += [[q, str(chapter), False, 0, 0, 1, s] for query, c, p, s in rows if query == q and c == chapter and p is None]
    assert got == sorted(map(tuple, want))
    # A greedy choice that fades chapters step by step.
    some = spark.createDataFrame([(1, c, i, s) for i, (c, s) in enumerate([("a", 0.9), ("a", 0.89), ("a", 0.5), ("b", 0.7), ("c", 0.6), ("b", 0.69)])], "query_id long, chapter string, id long, score double")
    taken = [(r["id"], r["faded"]) for r in evidence.diverse(some, "chapter", "score", "id", 5, fade=0.5).orderBy("rank").collect()]
    left, times, greedy = {r["id"]: (r["chapter"], r["score"]) for r in some.collect()}, {}, []
    while len(greedy) < 5:
        best = min(left, key=lambda i: (-round(left[i][1] * 0.5 ** times.get(left[i][0], 0), 4), i))
        chapter, score = left.pop(best)
        greedy.append((best, round(score * 0.5 ** times.get(chapter, 0), 4)))
        times[chapter] = times.get(chapter, 0) + 1
    assert taken == greedy
    assert evidence.spans(hits.limit(0), "chapter", "place").count() == 0


def test_bundles_stop_at_hubs_and_hops(spark):
    sections = [("c1", "s1"), ("c2", "s1"), ("c2", "s2"), ("c3", "s2"), ("c3", "s3"), ("c4", "s3"), ("c9", None), *[(f"h{i}", "hub") for i in range(9)], ("c1", "hub")]
    frame = spark.createDataFrame(sections, "chunk_id string, section string")
    seeds = spark.createDataFrame([(1, "c1"), (1, "c1"), (2, "c4"), (3, "none"), (4, "h1")], "query_id long, chunk_id string")
    reached = evidence.bundled(seeds, frame, hops=2, hub=5)
    assert sorted(tuple(r) for r in reached.collect()) == [(1, "c1", 0), (1, "c2", 1), (1, "c3", 2), (2, "c2", 2), (2, "c3", 1), (2, "c4", 0), (3, "none", 0), (4, "h1", 0)]
    found = {r["query_id"]: (r["seeds"], r["expanded"], r["sections"]) for r in evidence.bundles(reached, frame).collect()}
    assert found[1] == (["c1"], ["c2", "c3"], ["hub", "s1", "s2", "s3"]) and found[3] == (["none"], [], []) and found[4] == (["h1"], [], ["hub"])
    assert len(evidence.bundled(seeds, frame, hops=2, hub=50).where("query_id = 4").collect()) == 11  # through the hub, then on from c1 to c2


def test_second_ranking_breaks_ties_by_rank(spark):
    hits = spark.createDataFrame([(1, 7, 0.8, 1), (1, 8, 0.4, 2), (1, 9, None, 3), (1, 10, None, 3)], "query_id long, item_id long, score double, rank int")
    got = evidence.reordered(hits, {"likeness": (evidence.share_of_best(), 0.5), "flat": (F.when(F.col("rank") >= 2, 1.0), 0.25)}, 4).orderBy("place").collect()
    assert [(r["item_id"], r["second"]) for r in got] == [(7, 0.5), (8, 0.5), (9, 0.25), (10, 0.25)]


def test_perspectives_vote_and_fall_back(spark):
    pools = spark.createDataFrame([("manager", "boss"), ("manager", "team"), ("peer", "friend"), ("peer", "ally"), ("observer", "see"), ("peer", "ally")], "perspective string, term string")
    texts = spark.createDataFrame([(1, "my boss and team"), (2, "a friend, the boss"), (3, "nothing"), (4, None), (5, "boss team friend see"), (6, "boss friend see")], "id long, text string")
    got = {r["id"]: (r["perspective"], r["confidence"], r["reason"]) for r in evidence.perspectives(texts, "id", "text", pools).collect()}
    assert got == {1: ("manager", 1.0, "boss,team"), 2: ("manager", 0.5, "boss"), 3: ("unknown", 0.0, ""), 4: ("unknown", 0.0, ""), 5: ("manager", 0.5, "boss,team"), 6: ("unknown", 0.3333, "boss")}
    hits = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (3, 11)], "query_id long, item_id long")
    asked = spark.createDataFrame([(1, "manager"), (2, "peer"), (3, "unknown")], "query_id long, perspective string")
    items = spark.createDataFrame([(10, "manager"), (11, "observer")], "item_id long, perspective string")
    assert sorted(tuple(r) for r in evidence.of_perspective(hits, asked, items).select("query_id", "item_id", "matched").collect()) == [(1, 10, True), (2, 10, False), (3, 11, False)]


def test_evaluation_rows_and_misses(spark):
    from scriptorium.operators import retrieval

    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 1), (2, 10, 2), (2, 13, 5)], "query_id long, item_id long, rank int")
    truth = spark.createDataFrame([(1, 11), (2, 99), (3, 5)], "query_id long, item_id long")
    rows = retrieval.evaluation_rows(hits, truth)
    got = {r["query_id"]: (r["expected"], r["hit"], r["rank"], r["reciprocal_rank"], r["top"]) for r in rows.collect()}
    assert got == {1: (11, True, 2, 0.5, [10, 11]), 2: (99, False, -1, 0.0, [12, 10]), 3: (5, False, -1, 0.0, [])}
    assert [(r["query_id"], r["place"]) for r in retrieval.misses(rows.withColumn("g", F.lit("x")), "g", first=1).collect()] == [(2, 1)]
