"""Patterns, retries and session windows: brute force, streams that end and go on, edge cases."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import patterns
from scriptorium.plans import workflow
from scriptorium.streaming import append


@pytest.mark.parametrize("part", [200_000, 3])
def test_contained_matches_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(patterns, "PART", part)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abé \n") for _ in range(rng.randrange(60))) for _ in range(80)] + [None, "", "x" * 20_000]
    wanted = ["a", "ab", "aba", " a", "é\n", "zz", "", None, "a", "x" * 15_000]
    rows = spark.createDataFrame([(i % 70, t, "p") for i, t in enumerate(texts)], "id long, text string, pattern string").repartition(3)
    terms = spark.createDataFrame([(w,) for w in wanted], "w string")
    found = sorted(tuple(r) for r in patterns.contained(rows, "id", "text", terms, "w").collect())
    assert found == sorted((i % 70, w) for i, t in enumerate(texts) if t is not None for w in {w for w in wanted if w is not None and w in t})
    assert patterns.contained(rows, "id", "text", terms.limit(0), "w").count() == 0
    assert patterns.contained(rows.limit(0), "id", "text", terms, "w").count() == 0


def test_questions_that_fail_are_put_anew_and_asked_again(spark):
    asked = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "worse"), (4, "good")], "query_id long, text string")
    seen = []

    def attempt(rows, turn):
        seen.append((turn, sorted(r["query_id"] for r in rows.collect())))
        return rows.select("query_id", "text", (F.col("text") == "good").alias("passed"))

    better = {"bad": "good", "worse": "bad"}
    anew = lambda rows, turn: rows.replace(better, subset=["text"])
    got = {r["query_id"]: (r["text"], r["passed"], r["attempts"]) for r in workflow.retried(asked, attempt, anew, turns=2).collect()}
    assert got == {1: ("good", True, 1), 4: ("good", True, 1), 2: ("good", True, 2), 3: ("bad", False, 2)}
    assert seen == [(1, [1, 2, 3, 4]), (2, [2, 3])]
    seen.clear()
    third = {r["query_id"]: r["attempts"] for r in workflow.retried(asked, attempt, anew, turns=5).collect()}
    assert third == {1: 1, 4: 1, 2: 2, 3: 3} and len(seen) == 3  # ends when nothing is open
    assert workflow.retried(asked.limit(0), attempt, anew).count() == 0


def _sessions(rows, gap):
    found = []
    for key in {k for k, _ in rows}:
        times = sorted(t for k, t in rows if k == key and t is not None)
        for t in times:
            if found and found[-1][0] == key and t <= found[-1][2]:
                found[-1][2], found[-1][3] = t + gap, found[-1][3] + 1
            else:
                found.append([key, t, t + gap, 1])
    return sorted((k is not None, k or 0, a, b, n) for k, a, b, n in found)


@pytest.mark.parametrize("cells", [256, 3])
def test_sessions_match_plain_ones(spark, monkeypatch, cells):
    from scriptorium.operators import ordering

    monkeypatch.setattr(append, "with_cell", lambda rows, order: ordering.with_cell(rows, order, cells=cells))
    rng, start, gap = random.Random(3), datetime.datetime(2024, 1, 1), datetime.timedelta(minutes=30)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), start + datetime.timedelta(minutes=rng.randrange(4000))) for _ in range(400)] + [(1, None), (9, start), (9, start + gap), (8, start), (8, start + gap + datetime.timedelta(seconds=1))] + [(7, start)] * 3
    events = spark.createDataFrame([(k, t, 1.0, 5) for k, t in rows], "k long, ts timestamp, v double, n int")
    found = append.sessions(events, "ts", ["k"], "30 minutes", sums={"v": F.col("v")})
    assert sorted((r["k"] is not None, r["k"] or 0, r["start"], r["end"], r["n"]) for r in found.collect()) == _sessions(rows, gap)
    assert append.sessions(events.limit(0), "ts", ["k"]).count() == 0


def test_session_stream_drops_late_rows_and_goes_on_after_a_restart(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    at = lambda minute: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)
    schema = "k string, ts timestamp"

    def add(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)
        query = append.append_new(spark, source, schema, lambda events: append.sessions(events, "ts", ["k"], "30 minutes", late="10 minutes"), target, state, files_per_batch=1)
        query.awaitTermination(120)
        assert query.exception() is None
        return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])

    done = lambda: sorted((r["k"], r["start"], r["n"]) for r in spark.read.schema("k string, start timestamp, end timestamp, n long").parquet(target).collect())
    add(("a", at(0)), ("a", at(20)), ("b", at(5)))
    assert done() == []  # open: state alone
    add(("a", at(45)), ("c", at(300)))  # a new query goes on with a's open session
    add(("d", at(320)))  # the watermark is now behind the sessions of a and b
    assert done() == [("a", at(0), 3), ("b", at(5), 1)]
    dropped = add(("a", at(10)), ("c", at(310)))  # the first is too late; the second still joins its session
    assert dropped == 1
    add(("e", at(900)))
    add(("e", at(901)))
    assert [x for x in done() if x[0] in "ac"] == [("a", at(0), 3), ("c", at(300), 2)]


def test_first_seen(spark):
    rows = spark.createDataFrame([("a", datetime.datetime(2024, 1, 1)), ("a", datetime.datetime(2024, 1, 2)), ("b", datetime.datetime(2024, 1, 1))], "k string, ts timestamp")
    assert sorted(r["k"] for r in append.first_seen(rows, ["k"], "ts").collect()) == ["a", "b"]
