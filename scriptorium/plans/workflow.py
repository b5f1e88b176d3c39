"""From questions to reports: understanding, retrieval by intent, evidence, checks. All questions of a table at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import lexicon
from scriptorium.functions import tokens as T
from scriptorium.operators import intent, report, retrieval
from scriptorium.sources.store import durable


def answered(questions: DataFrame, cases: DataFrame, members: DataFrame, limit: int = 4, per_item: int = 2, in_all: int = 6, pattern: str = T.LATIN_TOKEN, vocabulary=intent.VOCABULARY, rerank: DataFrame | None = None, searched: Callable[[DataFrame, int], dict[str, DataFrame]] | None = None) -> DataFrame:
    """query_id, intent, scene, queries, cases, evidence, confidence, diagram, notes and passed.

    questions: query_id, text. cases: item_id, sparse and dense (texts), priority. members: item_id, members (chunk ids in order).
    Questions that are out of scope retrieve nothing. searched: a search of one's own, from questions (query_id, tokens) and a number of hits to branches (query_id, item_id, rank) by
    name, in place of scoring the texts of cases.
    """
    asked = intent.analyzed(questions, "text", vocabulary)
    search = asked.where("intent <> 'out_of_scope'").select("query_id", T.tokens(F.concat_ws(" ", "queries"), pattern).alias("tokens"))
    branches = searched(search, retrieval.branch_limit(50)) if searched else {}
    for name, text, worth in () if searched else (("sparse", "sparse", (1.15, 0.75, 4.8, 0.3)), ("dense", "dense", (1.35, 0.9, 5.0, 0.25))):
        corpus = cases.select("item_id", T.tokens(F.col(text), pattern).alias("tokens"), "priority")
        scores = retrieval.lexical_scores(search, corpus, long_bonus=worth[0], short_bonus=worth[1], cap=worth[2], priority_weight=worth[3])
        branches[name] = retrieval.ranked(scores, "query_id", "item_id", "score", retrieval.branch_limit(50))
    hits = retrieval.reranked(retrieval.fused(branches, limit=50), rerank, keep=limit)
    evidence = retrieval.expanded(hits, members, per_item=per_item, in_all=in_all)
    found = report.mirrors(hits).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("item_id").cast("string").alias("item"), "score", "confidence"))).alias("cases"))
    shown = evidence.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "member"))), lambda x: x["member"]).alias("evidence"))
    out = asked.join(found, "query_id", "left").join(shown, "query_id", "left")
    empty = F.array().cast("array<string>")
    out = out.withColumn("evidence", F.coalesce("evidence", empty))
    names = F.transform("cases", lambda c: c["item"])
    edges = F.transform("cases", lambda c, i: F.struct(F.lit(0).alias("a"), (i + 1).alias("b"), F.lit("like").alias("label")))
    out = out.withColumn("diagram", report.diagram(F.concat(F.array(F.col("scene")), F.coalesce(names, empty)), F.coalesce(edges, F.array().cast("array<struct<a:int,b:int,label:string>>"))))
    notes = report.checks(F.col("evidence"), F.coalesce(names, empty), F.col("diagram"))
    out = out.withColumn("notes", F.when(F.col("intent") == "out_of_scope", empty).otherwise(notes)).withColumn("passed", F.size("notes") == 0)
    return out.select("query_id", "intent", "scene", "queries", "conflicts", "constraints", "cases", "evidence", "diagram", "notes", "passed")


def retried(questions: DataFrame, attempt: Callable[[DataFrame, int], DataFrame], rewrite: Callable[[DataFrame, int], DataFrame], turns: int = 2, query: str = "query_id") -> DataFrame:
    """The answers of attempt(questions, turn) with the turn they are from (`attempts`). Those that did not pass are asked again, as rewrite(questions, turn) puts
    them, `turns` times in all; the last answer stays, passed or not.

    attempt gives one row a question with `passed`. A turn works on the open questions alone; its answers and the next questions are written to the
    shared folder, so a turn is done once. Ends early when nothing is open. Questions have an id of their own that is not null.
    """
    asked, out = questions, None
    for turn in range(1, turns + 1):
        got = durable(attempt(asked, turn).withColumn("attempts", F.lit(turn)))
        done = got if turn == turns else got.where("passed")
        out = done if out is None else out.unionByName(done)
        if turn < turns:
            asked = durable(rewrite(asked.join(got.where("not passed").select(query), query, "left_semi"), turn))
            if asked.isEmpty():
                break
    return out


def rewritten(questions: DataFrame, table=lexicon.EXPANSIONS, pattern: str = T.LATIN_TOKEN, most: int = 3) -> DataFrame:
    """questions with `text` and `tokens` of the words that its expansion groups stand for; those that no group meets stay as they are."""
    other = intent.expansions(F.col("text"), table, most)
    text = F.when(F.size(other) > 0, F.array_join(other, " ")).otherwise(F.col("text"))
    return questions.withColumn("text", text).withColumn("tokens", T.tokens(F.lower("text"), pattern))


def routed(questions: DataFrame, look_ups: dict[str, DataFrame] | list[str], case_hits: DataFrame, members: DataFrame, limit: int = 4, per_item: int = 2, in_all: int = 6, attempts: int = 2, expansions=lexicon.EXPANSIONS, searched: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """query_id, intent, items, evidence, passed and attempts: each question answered by the branch that its intent names.

    questions: query_id, text, tokens, intent. look_ups: corpora (item_id, tokens, priority) by the intent of the questions that look something
    up in them; their hits are the evidence themselves. Questions of intent `analysis` take case_hits (query_id, case_id, score, rank) and
    expand them to members (item_id, members). Others, out of scope, retrieve nothing and pass. An answer without evidence does not
    pass; a look-up without one is asked again in the words of its expansions, `attempts` times in all. searched: a search of one's own, from questions (query_id, tokens, intent) that look
    something up and a number of hits to query_id, item_id and rank, in place of scoring corpora; look_ups then only names the intents.
    """
    case_hits = durable(case_hits.where(F.col("rank") <= limit))  # a few a question; every turn needs them
    ask = lambda asked, _: _routed(asked, look_ups, case_hits, members, limit, per_item, in_all, searched)
    return retried(questions, ask, lambda asked, _: rewritten(asked, expansions), attempts)


def _routed(questions: DataFrame, look_ups: dict[str, DataFrame] | list[str], case_hits: DataFrame, members: DataFrame, limit: int, per_item: int, in_all: int, searched=None) -> DataFrame:
    """One turn of routed()."""
    found, bests = [], []
    if searched:
        bests.append(searched(questions.where(F.col("intent").isin(list(look_ups))).select("query_id", "tokens", "intent"), limit))
    for of, corpus in () if searched else look_ups.items():
        asked = questions.where(F.col("intent") == of).select("query_id", "tokens")
        bests.append(retrieval.ranked(retrieval.lexical_scores(asked, corpus), "query_id", "item_id", "score", limit))
    for best in bests:
        found.append(best.select("query_id", F.col("item_id").cast("string").alias("item"), "rank", F.col("item_id").cast("string").alias("member"), F.col("rank").alias("place")))
    cases_of = case_hits.join(questions.where("intent = 'analysis'").select("query_id"), "query_id").where(F.col("rank") <= limit).select("query_id", F.col("case_id").alias("item_id"), "score", "rank")
    shown = retrieval.expanded(cases_of, members, per_item=per_item, in_all=in_all)
    found.append(cases_of.select("query_id", F.col("item_id").cast("string").alias("item"), "rank", F.lit(None).cast("string").alias("member"), F.lit(None).cast("int").alias("place")))
    found.append(shown.select("query_id", F.lit(None).cast("string").alias("item"), F.lit(None).cast("int").alias("rank"), "member", F.col("place").cast("int").alias("place")))
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    listed = lambda order, value: F.transform(F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(order, value)))), lambda x: x[value])  # noqa: E731  a few rows a question
    lists = every.groupBy("query_id").agg(listed("rank", "item").alias("items"), listed("place", "member").alias("evidence"))
    none = F.array().cast("array<string>")
    out = questions.select("query_id", "intent").join(lists, "query_id", "left").withColumns({"items": F.coalesce("items", none), "evidence": F.coalesce("evidence", none)})
    return out.withColumn("passed", ~F.col("intent").isin("analysis", *look_ups) | (F.size("evidence") > 0))
