"""The stored index against plain scores, and the store itself."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import postings
from scriptorium.sources import store


def _corpus(n=300, seed=4):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", *(f"w{i}" for i in range(60))]
    rows = [(i, [rng.choice(vocabulary[: rng.choice([3, 10, 63])]) for _ in range(rng.randrange(25))]) for i in range(n)]
    return [*rows, (n, None), (n + 1, []), (5, ["w1", "w2"])]  # a repeated id


QUESTIONS = [(1, ["the", "w1", "w2", "w40"]), (2, ["of"]), (3, ["absent"]), (4, []), (5, ["w7", "w8", "w9", "the", "of", "and"])]


def _plain(rows, k, score):
    """(question, item, score, rank) by a function of (question's term, tf, length, df, n, mean) summed, items apart by place."""
    lengths = [len(t or []) for _, t in rows]
    n, mean = len(rows), sum(lengths) / len(rows)
    df = Counter(t for _, terms in rows for t in set(terms or []))
    found = []
    for query, asked in QUESTIONS:
        scored = []
        for (item, terms), length in zip(rows, lengths):
            tf = Counter(terms or [])
            shared = [t for t in asked if tf[t]]
            if shared:
                scored.append((-round(sum(score(t, tf[t], length, df[t], n, mean) for t in shared) + 1e-12, 4), item))
        found += [(query, item, -s, place) for place, (s, item) in enumerate(sorted(scored)[:k], 1)]
    return found


def _bm25(term, tf, length, df, n, mean):
    return math.log1p((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))


@pytest.mark.parametrize("block", [1024, 7])
def test_rankings_match_plain_scores(spark, monkeypatch, tmp_path, block):
    monkeypatch.setattr(postings, "BLOCK", block)
    rows = _corpus()
    corpus = spark.createDataFrame(rows, "id long, tokens array<string>").repartition(3)
    of = postings.index(corpus, "id", F.col("tokens"), "test")
    asked = spark.createDataFrame(QUESTIONS, "query_id long, terms array<string>")
    got = sorted((r["query_id"], r["item_id"], r["score"], r["rank"]) for r in postings.bm25(asked, of, 4).collect())
    assert [(q, i, pytest.approx(s, abs=2e-4), r) for q, i, s, r in sorted(_plain(rows, 4, _bm25))] == got
    both = postings.overlaps(asked, of, 6, priority=0.0)
    by_count = sorted((r["query_id"], r["item_id"], r["score"], r["rank"]) for r in both["overlap"].collect())
    assert by_count == sorted(_plain(rows, 6, lambda *_: 1))
    scored = both["scored"].collect()
    assert all(r["score"] == pytest.approx(round(math.log1p(r["overlap"]) + min(4.5, 0), 4), abs=4.6) for r in scored) and len(scored) == len(by_count)
    labels = postings.by_label(asked, of, 4, {"w": 2.0})
    want = _plain(rows, 4, lambda t, tf, length, df, n, mean: math.log1p((n - df + 0.5) / (df + 0.5)) * (2 if t[0] == "w" else 1))
    assert sorted((r["query_id"], r["item_id"], r["rank"]) for r in labels.collect()) == sorted((q, i, r) for q, i, _, r in want)


def test_empty_corpus(spark):
    of = postings.index(spark.createDataFrame([], "id long, tokens array<string>"), "id", F.col("tokens"), "none")
    assert of.n == 0 and not postings.bm25(spark.createDataFrame(QUESTIONS, "query_id long, terms array<string>"), of, 4).collect()


def test_tables_are_made_once_and_again_after_a_change(spark, tmp_path):
    path, made = str(tmp_path / "rows"), []

    def tables():
        made.append(1)
        return {"a": spark.read.parquet(path), "b": spark.range(len(made))}

    spark.range(5).write.parquet(path)
    first = store.fingerprint(spark.read.parquet(path))
    for _ in range(2):
        found = store.stored(spark, "kept", f"{path}|{first}", tables)
        assert found["a"].count() == 5 and found["b"].count() == 1
    assert len(made) == 1
    spark.range(7).write.mode("append").parquet(path)
    second = store.fingerprint(spark.read.parquet(path))
    assert second != first and second == store.fingerprint(spark.read.parquet(path))
    assert store.stored(spark, "kept", f"{path}|{second}", tables)["a"].count() == 12 and len(made) == 2
    assert store.fingerprint(spark.range(3)) != store.fingerprint(spark.range(3))
    derived = spark.read.parquet(path).selectExpr("id + 1 as id").groupBy("id").count()
    assert store.fingerprint(derived) != store.fingerprint(derived)


def test_texts_split_in_the_tasks_give_the_index_of_word_lists(spark):
    from scriptorium.functions import tokens as T

    texts = [(1, "Été, the_river -- и 3 men"), (2, None), (3, ""), (4, " .,"), (5, "the the　the\n北方 men!"), (6, "ǅ x²  'twas")] + [(i, f"the w{i} w{i % 7}.") for i in range(7, 2600)]
    corpus = spark.createDataFrame(texts, "id long, text string").repartition(1)
    low = F.lower(F.coalesce("text", F.lit("")))
    shown = lambda rows: sorted(map(str, rows.select("block", "term", "items", "tfs", "lengths", "n", "tokens").collect()))
    lists = postings.made(corpus, "id", F.regexp_extract_all(low, F.lit(T.LATIN_TOKEN), F.lit(0)))
    assert shown(postings.made(corpus, "id", low, T.LATIN_GAP)) == shown(lists)


def test_a_ranking_is_worked_out_once_however_often_it_is_read(spark):
    of = postings.index(spark.createDataFrame(_corpus(), "id long, tokens array<string>"), "id", F.col("tokens"), "once")
    hits = postings.bm25(spark.createDataFrame(QUESTIONS, "query_id long, terms array<string>"), of, 4)
    assert "MapInArrow" not in hits._jdf.queryExecution().toString()
