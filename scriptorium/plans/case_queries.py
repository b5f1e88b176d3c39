"""Registered queries of the case search and of routed answers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.functions import tokens as T
from scriptorium.operators import case_merging, cases, intent, patterns, postings, retrieval, sections

from . import workflow
from .catalogue import INTENT, MARKERS, _VECTORS, _any, document_index, query, table, word_array

NAMES = {"detail": "detail", "tag": "tag", "role": "role", "view": "view", "kind": "kind", "sparse": "words", "pattern": "pattern", "title": "title", "dense": "meaning"}
TERM_NOISE = ["that", "with", "the", "and"]


def conversation_cases(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """Every conversation (only: those with these case_id) as a case: first turn (title), last turn (summary), first answer (pattern), first words (tags), roles, answers (views)."""
    turns = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    if only is not None:
        turns = turns.join(only.select(F.col("case_id").alias("conv_id")), "conv_id", "left_semi")
    else:
        turns = retrieval.spread(turns, "conv_id")  # once, as cases are dealt for their search
    answer = F.col("role") == "assistant"
    views = F.transform(F.array_sort(F.collect_list(F.when(answer, F.struct("turn", "text")))), lambda x: x["text"])  # the turns of one conversation
    rows = turns.groupBy(F.col("conv_id").alias("case_id")).agg(
        F.min_by("text", "turn").alias("title"), F.max_by("text", "turn").alias("summary"), F.min_by(F.when(answer, F.col("text")), F.when(answer, F.col("turn"))).alias("pattern"), F.max_by("role", "turn").alias("kind"),
        F.sort_array(F.collect_set(F.split("text", " ")[0])).alias("tags"), F.sort_array(F.collect_set("role")).alias("roles"), views.alias("views"), (F.count("*") / 10).alias("priority"),
    )
    return cases.indexed(rows.withColumns({"conflict": F.lit(""), "actor": F.lit("")}))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return cases.asked(items, noise=TERM_NOISE)


def _words(c: str) -> str:
    return rf"list_distinct(regexp_extract_all({c}, '[\p{{L}}\p{{N}}_]+'))"


def _compact(c: str) -> str:
    return rf"lower(regexp_replace({c}, '\s+', '', 'g'))"


def _lines(parts: list[str]) -> str:
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda p: p <> ''), chr(10))"


def _bonus(text: str, long: float, short: float, cap: float) -> str:
    return f"least({cap}::DOUBLE, coalesce(list_sum(list_transform(list_filter(terms, lambda t: contains({text}, t)), lambda t: CASE WHEN length(t) >= 3 THEN {long}::DOUBLE ELSE {short}::DOUBLE END)), 0))"


_FILLED = "list_filter(list_transform({0}, lambda x: trim(x, ' ')), lambda x: x <> '')"
_INDEX = rf"""
  turns AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
  raw AS (SELECT conv_id AS case_id, trim(arg_min(text, turn), ' ') AS title, trim(arg_max(text, turn), ' ') AS summary, trim(coalesce(arg_min(text, turn) FILTER (role = 'assistant'), ''), ' ') AS pattern, trim(arg_max(role, turn), ' ') AS kind,
    {_FILLED.format("list_sort(list_distinct(list(string_split(text, ' ')[1])))")} AS tags, {_FILLED.format("list_sort(list_distinct(list(role)))")} AS roles,
    {_FILLED.format("coalesce(list(text ORDER BY turn) FILTER (role = 'assistant'), [])")} AS views, count(*) / 10.0::DOUBLE AS priority FROM turns GROUP BY conv_id),
  texts AS (SELECT *, {_lines(["title", "title", "pattern", "pattern", "summary"])} AS dense_text, {_lines(["title", "summary", "kind", "array_to_string(tags, ' ')", "array_to_string(roles, ' ')", "array_to_string(views, ' ')"])} AS sparse_text FROM raw),
  cases AS (SELECT *, {_compact("dense_text")} AS dense_compact, {_compact("sparse_text")} AS sparse_compact, {_words("dense_text")} AS dense_tokens, {_words("sparse_text")} AS sparse_tokens FROM texts),
  questions AS (SELECT item_id AS query_id, text AS question, {_words("text")} AS tokens,
    list_transform(list_sort(list_transform(list_distinct(list_transform(list_filter(regexp_extract_all(replace(replace(replace(replace(text, 'that', ' '), 'with', ' '), 'the', ' '), 'and', ' '), '[\p{{L}}\p{{N}}_]+'), lambda t: length(t) >= 2), lambda t: lower(t))),
      lambda t: lpad((1000 - length(t))::VARCHAR, 4, '0') || t)), lambda t: t[5:]) AS terms FROM benchmark),
  pairs AS (SELECT *, list_filter(views, lambda v: len(list_filter(terms, lambda t: contains(v, t))) > 0) AS viewed, kind <> '' AND contains(question, kind) AS of_kind,
    list_filter(tags, lambda x: contains(question, x)) AS tagged, list_filter(roles, lambda x: contains(question, x)) AS acted FROM cases CROSS JOIN questions)"""


def _or(fields: dict[str, str], otherwise: str) -> str:
    found = ", ".join(f"CASE WHEN {condition} THEN '{name}' END" for name, condition in fields.items())
    return f"CASE WHEN len(list_filter([{found}], lambda x: x IS NOT NULL)) > 0 THEN list_filter([{found}], lambda x: x IS NOT NULL) ELSE ['{otherwise}'] END"


def _met(text: str) -> str:
    return f"len(list_filter(terms, lambda t: contains({text}, t))) > 0"


def _branch(name: str, score: str, text: str, fields: str, limit: int) -> str:
    return rf"""
  {name}_scores AS (SELECT *, round({score}, 4) AS score, list_filter(terms, lambda t: contains({text}, t))[1:6] AS shown, {fields} AS fields FROM pairs),
  {name} AS (SELECT query_id, case_id, score, shown AS terms, fields, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, case_id) AS rank,
    replace(replace(replace('{{{{fields}}}} / {{{{terms}}}} / {{{{pattern}}}}', '{{{{fields}}}}', array_to_string(fields[1:3], '、')), '{{{{terms}}}}', CASE WHEN len(shown) > 0 THEN array_to_string(shown[1:4], '、') ELSE kind END), '{{{{pattern}}}}',
      CASE WHEN length(told) > 88 THEN left(told, 88) || '...' ELSE told END) AS reason
    FROM (SELECT *, coalesce(nullif(pattern, ''), nullif(summary, ''), nullif(title, ''), '') AS told FROM {name}_scores WHERE score > 0) QUALIFY rank <= {limit})"""


_SPARSE = _branch("sparse", f"ln(1 + len(list_intersect(tokens, sparse_tokens))::DOUBLE) + {_bonus('sparse_compact', 1.15, 0.75, 4.8)} + len(tagged) * 0.45::DOUBLE + len(acted) * 0.4::DOUBLE + len(viewed) * 0.35::DOUBLE + CASE WHEN of_kind THEN 0.25::DOUBLE ELSE 0 END + priority * 0.3::DOUBLE",
    "sparse_compact", _or({"detail": _met("sparse_compact"), "tag": "len(tagged) > 0", "role": "len(acted) > 0", "view": "len(viewed) > 0", "kind": "of_kind"}, "words"), 16)
_DENSE_TEXT = _branch("dense", f"ln(1 + len(list_intersect(tokens, dense_tokens))::DOUBLE) + {_bonus('dense_compact', 1.35, 0.9, 5.0)} + CASE WHEN len(list_filter(terms, lambda t: length(t) >= 3 AND contains(dense_text, t))) > 0 THEN 0.8::DOUBLE ELSE 0 END + priority * 0.25::DOUBLE",
    "dense_compact", _or({"pattern": _met(_compact("pattern")), "title": _met(_compact("title"))}, "meaning"), 16)
_SHOWN = "query_id, case_id, score, array_to_string(terms, ' ') AS terms, array_to_string(fields, ',') AS fields, reason, rank::INTEGER AS rank"
_BY_LENGTH = "list_transform(list_sort(list_transform(list_distinct(flatten(list(terms))), lambda t: lpad((1000 - length(t))::VARCHAR, 4, '0') || t)), lambda t: t[5:])[1:8]"
_FUSED = f"""
  branches AS (SELECT *, 0 AS i FROM sparse UNION ALL SELECT *, 1 FROM dense),
  fused AS (SELECT query_id, case_id, round(sum(1.0::DOUBLE / (60 + rank) ORDER BY i), 6) AS score, {_BY_LENGTH} AS terms, list_sort(list_distinct(flatten(list(fields)))) AS fields, arg_min(reason, i) AS reason FROM branches GROUP BY query_id, case_id),
  found AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, case_id) AS rank FROM fused)"""
_TEMPLATE = "{{fields}} / {{terms}} / {{pattern}}"


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "case_id", "score", F.array_join("terms", " ").alias("terms"), F.array_join("fields", ",").alias("fields"), "reason", "rank")


def _branches(spark, sf_dir, *of: str) -> dict[str, DataFrame]:
    return cases.branches(_questions(spark, sf_dir), conversation_cases(spark, sf_dir), retrieval.branch_limit(4), NAMES, _TEMPLATE, of, lambda ids: conversation_cases(spark, sf_dir, ids))


@query(f"WITH {_INDEX}, {_SPARSE} SELECT {_SHOWN} FROM sparse")
def case_sparse_topk(spark, sf_dir):
    """The best conversations for each benchmark text, by tokens, terms, tags, roles, views, kind and priority."""
    return _shown(_branches(spark, sf_dir, "sparse")["sparse"])


@query(f"WITH {_INDEX}, {_DENSE_TEXT} SELECT {_SHOWN} FROM dense")
def case_dense_text_topk(spark, sf_dir):
    """The best conversations by the weighted dense text, where there is no vector search."""
    return _shown(_branches(spark, sf_dir, "dense")["dense"])


@query(f"WITH {_INDEX}, {_SPARSE}, {_DENSE_TEXT}, {_FUSED} SELECT {_SHOWN} FROM found WHERE rank <= 4")
def case_search(spark, sf_dir):
    """Both rankings fused, with the terms and fields of both."""
    return _shown(cases.fused(_branches(spark, sf_dir, "sparse", "dense"), limit=4))


@query(f"""WITH {_VECTORS},
  dense AS (SELECT q.label AS request, q.vec_id AS query_id, c.vec_id AS item_id, round(list_dot_product(q.v, c.v), 4) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, c.vec_id) <= 12),
  best AS (SELECT request, item_id, max(score) AS score FROM dense GROUP BY ALL)
SELECT request, item_id, score, row_number() OVER (PARTITION BY request ORDER BY score DESC, item_id)::INTEGER AS rank FROM best QUALIFY rank <= 12""")
def dense_best_per_item(spark, sf_dir):
    """Several vectors of one request (here those of one label) searched one by one, the best score of each item kept."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    best = retrieval.dense_ranked(asked, rows.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")), 12, digits=4, but_own=True)
    hits = best.join(rows.select(F.col("vec_id").alias("query_id"), F.col("label").alias("request")), "query_id")
    return retrieval.best_per_item(hits, "request")


@query(r"""WITH held AS (SELECT item_id AS query_id, doc_id AS item_id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text)) QUALIFY row_number() OVER (PARTITION BY b.item_id ORDER BY doc_id) <= 4),
  q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS token FROM benchmark),
  d AS (SELECT doc_id AS item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS token FROM documents),
  s AS (SELECT query_id, item_id, count(*) AS n FROM q ANTI JOIN held USING (query_id) JOIN d USING (token) GROUP BY query_id, item_id),
  t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, item_id) <= 4)
SELECT query_id, item_id, 0::INTEGER AS branch FROM held UNION ALL SELECT query_id, item_id, 1 FROM t""")
def search_with_fallback(spark, sf_dir):
    """Documents that hold the whole question; for questions without one, those that share most tokens."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lower("text").alias("pattern"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.lower("text").alias("hay"))
    whole = patterns.contained(docs, "item_id", "hay", items, "pattern").join(items, "pattern").select("query_id", "item_id", F.lit(1).alias("score"))
    words = items.select("query_id", F.array_distinct(word_array("pattern")).alias("terms"))
    shared = postings.overlaps(words, document_index(spark, sf_dir), 4)["overlap"]
    branches = [retrieval.ranked(whole, "query_id", "item_id", "score", 4), shared]
    return retrieval.first_with_hits([rows.select("query_id", "item_id") for rows in branches]).select("query_id", "item_id", "branch")


def _look_up(name: str, texts: str, of: str) -> str:
    return rf"""
  {name}_tokens AS (SELECT doc_id AS item_id, unnest(list_distinct(regexp_extract_all(lower({texts}), '[\p{{L}}\p{{N}}_]+'))) AS token FROM cut WHERE {texts} <> ''),
  {name}_sums AS (SELECT query_id, item_id, ln(1 + count(*)::DOUBLE) + least(4.5::DOUBLE, sum(CASE WHEN length(token) >= 3 THEN 1.35::DOUBLE WHEN length(token) = 2 THEN 0.9::DOUBLE ELSE 0 END)) + 0.5::DOUBLE * 0.35::DOUBLE AS score FROM asked JOIN {name}_tokens USING (token) WHERE intent = '{of}' GROUP BY query_id, item_id),
  {name} AS (SELECT query_id, item_id::VARCHAR AS item, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 4) DESC, item_id) AS rank FROM {name}_sums QUALIFY rank <= 4)"""


_ROUTES = rf"""WITH {_INDEX}, {_SPARSE}, {_DENSE_TEXT}, {_FUSED},
  route AS (SELECT item_id AS query_id, text, CASE WHEN {_any(INTENT['out_of_scope'])} AND NOT {_any(INTENT['domain'])} THEN 'out_of_scope' WHEN {_any(INTENT['commentary'])} THEN 'commentary_lookup'
    WHEN {_any(INTENT['analysis'])} OR {_any(INTENT['first_person'])} THEN 'analysis' WHEN {_any(INTENT['lookup'])} THEN 'factual_lookup' WHEN {_any(INTENT['factual'])} AND length(text) <= 36 THEN 'factual_lookup' ELSE 'analysis' END AS intent FROM benchmark),
  asked AS (SELECT query_id, intent, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'))) AS token FROM route),
  placed AS (SELECT doc_id, coalesce(text, '') AS text, least(nullif(strpos(text, 'Licensed'), 0), nullif(strpos(text, 'Released'), 0), nullif(strpos(text, 'All rights'), 0)) AS pos FROM documents),
  cut AS (SELECT doc_id, trim(CASE WHEN pos IS NULL THEN text ELSE left(text, pos - 1) END, ' ') AS fact, CASE WHEN pos IS NULL THEN '' ELSE trim(substring(text, pos), ' ') END AS comment FROM placed),
  {_look_up('facts', 'fact', 'factual_lookup')}, {_look_up('comments', 'comment', 'commentary_lookup')},
  hits AS (SELECT query_id, case_id::VARCHAR AS item, rank FROM found JOIN route USING (query_id) WHERE rank <= 4 AND intent = 'analysis'),
  answers AS (SELECT conv_id::VARCHAR AS item, conv_id || ':' || turn AS member, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'assistant'),
  shown AS (SELECT query_id, member, row_number() OVER (PARTITION BY query_id ORDER BY rank, n) AS place FROM hits JOIN answers USING (item) WHERE n <= 2 QUALIFY place <= 6),
  looked AS (SELECT * FROM facts UNION ALL SELECT * FROM comments),
  items AS (SELECT query_id, string_agg(item, ',' ORDER BY rank) AS items FROM (SELECT * FROM looked UNION ALL SELECT * FROM hits) GROUP BY query_id),
  evidence AS (SELECT query_id, string_agg(member, ',' ORDER BY place) AS evidence FROM (SELECT query_id, item AS member, rank AS place FROM looked UNION ALL SELECT * FROM shown) GROUP BY query_id)
SELECT r.query_id, r.intent, coalesce(i.items, '') AS items, coalesce(e.evidence, '') AS evidence, r.intent = 'out_of_scope' OR e.evidence IS NOT NULL AS passed, CASE WHEN r.intent = 'out_of_scope' OR e.evidence IS NOT NULL THEN 1 ELSE 2 END AS attempts
FROM route r LEFT JOIN items i USING (query_id) LEFT JOIN evidence e USING (query_id)"""


@query(_ROUTES)
def routed_answers(spark, sf_dir):
    """Questions by intent to facts, to commentaries, to cases and their turns, or to nothing."""
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text", T.tokens(F.lower("text")).alias("tokens"), intent.rule_intent(F.col("text"), INTENT).alias("intent"))
    cut = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), sections.fact_and_comment(X.text_or_empty(F.col("text")), MARKERS).alias("c"))
    corpus = cut.select("item_id", F.lower("c.fact").alias("fact"), F.lower("c.comment").alias("comment"), F.lit(0.5).alias("priority"))
    texts = {"factual_lookup": "fact", "commentary_lookup": "comment"}
    look_up = lambda asked, k: retrieval.text_ranked(asked, corpus, texts, k, kind="intent")  # noqa: E731  both parts of a document in one pass
    hits = retrieval.reranked(cases.fused(_branches(spark, sf_dir, "sparse", "dense"), limit=4), None)
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    listed = F.transform(F.array_sort(F.collect_list("turn")), lambda t: F.concat(F.col("item_id").cast("string"), F.lit(":"), t.cast("string")))
    members = turns.groupBy(F.col("conv_id").alias("item_id")).agg(listed.alias("members"))  # the answers of one conversation
    found = workflow.routed(questions, list(texts), hits, members, searched=look_up)
    return found.select("query_id", "intent", F.array_join("items", ",").alias("items"), F.array_join("evidence", ",").alias("evidence"), "passed", "attempts")


_PEOPLE = [("chief", ["der", "the"], "judge"), ("peer", ["con", "les"], "partner"), ("team", ["und"], "doer")]


@query("SELECT item_id, 'me:asker' || " + " || ".join(f"CASE WHEN {_any(words)} THEN ',{name}:{role}' ELSE '' END" for name, words, role in _PEOPLE) + " AS actors FROM benchmark")
def question_actors(spark, sf_dir):
    """Who a question may be about."""
    found = intent.actors(F.col("text"), _PEOPLE, ("me", "asker", "goal", "risk"), "goal", "risk")
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.transform(found, lambda a: F.concat(a["name"], F.lit(":"), a["role"])), ",").alias("actors"))


_RULES = [(["power", "trust"], ["the", "les"], "power text"), (["team"], ["und"], "team text")]


@query("""WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'power' WHEN 1 THEN 'team' ELSE 'exit' END AS scene, coalesce(text, '') AS text FROM documents)
SELECT doc_id, CASE WHEN scene = 'power' AND (contains(text, 'the') OR contains(text, 'les')) THEN 'power text' WHEN scene = 'team' AND contains(text, 'und') THEN 'team text' ELSE 'other' END AS reason,
  CASE WHEN text <> '' THEN CASE WHEN length(text) > 220 THEN left(text, 217) || '...' ELSE text END ELSE 'none' END AS answer FROM d""")
def mapping_reasons(spark, sf_dir):
    """Why a text bears on a scene, by rules on its topics, and the short answer of a look-up."""
    docs = table(spark, sf_dir, "documents").withColumn("text", X.text_or_empty(F.col("text")))
    scene = F.when(F.col("doc_id") % 3 == 0, "power").when(F.col("doc_id") % 3 == 1, "team").otherwise("exit")
    topics = X.words_in(F.col("text"), ["the", "les", "und"])
    return docs.select("doc_id", cases.mapping_reason(scene, topics, _RULES, "other").alias("reason"), cases.lookup_answer(F.filter(F.array("text"), lambda t: t != ""), "none").alias("answer"))


@query(r"""WITH q AS (SELECT item_id AS query_id, text, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS token FROM benchmark),
  d AS (SELECT doc_id AS item_id, lang, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS token FROM documents),
  s AS (SELECT query_id, item_id, count(*) AS overlap, sum(CASE WHEN length(token) >= 3 THEN 1.35::DOUBLE WHEN length(token) = 2 THEN 0.9::DOUBLE ELSE 0 END) AS bonus, any_value(q.text) AS text, any_value(lang) AS lang FROM q JOIN d USING (token) GROUP BY query_id, item_id),
  r AS (SELECT query_id, item_id, overlap, round(ln(1 + overlap::DOUBLE) + least(4.5::DOUBLE, bonus) + 0.9::DOUBLE * 0.35::DOUBLE + CASE WHEN lang <> '' AND contains(text, lang) THEN 0.25::DOUBLE ELSE 0 END, 4) AS score FROM s)
SELECT query_id, item_id, overlap, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INTEGER AS rank FROM r QUALIFY rank <= 4""")
def tagged_topk(spark, sf_dir):
    """The best documents by tokens, exact terms, priority and the tags (here the language) that a question names."""
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text", T.tokens(F.lower("text")).alias("tokens"))
    corpus = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.lower("text").alias("words"), F.lit(0.9).alias("priority"), F.array_compact(F.array("lang")).alias("tags"))
    return retrieval.text_ranked(questions, corpus, {"words": "words"}, 4)


@query()
def merged_cases(spark, sf_dir):
    """Documents as cases (title: first sentence; sections: groups of eight; books: languages), exact and near duplicates merged."""
    docs = table(spark, sf_dir, "documents").withColumn("text", X.text_or_empty(F.col("text")))
    name = lambda c: F.lpad(c.cast("string"), 12, "0")
    rows = docs.select(
        name(F.col("doc_id")).alias("case_id"), F.coalesce("lang", F.lit("")).alias("book"), F.lit("").alias("actor"), F.lit("").alias("kind"), F.coalesce(F.get(X.sentences(F.col("text")), F.lit(0)), F.lit("")).alias("title"), F.lit("").alias("conflict"),
        F.lit("").alias("pattern"), F.col("text").alias("summary"), F.array(name(F.floor(F.col("doc_id") / 8))).alias("sections"), F.array(name(F.col("doc_id"))).alias("chunks"), F.array_compact(F.array("source")).alias("tags"), (F.col("n_chars") % 7 / 10).alias("score"),
        F.lit(0.85).alias("priority"), F.col("doc_id").alias("ordinal"), F.lit(0).alias("position"),
    )
    found = case_merging.merged_cases(rows, ["book"])
    return found.select("book", "case_id", "merged", F.size("sections").alias("n_sections"), F.array_join("chunks", ",").alias("chunks"), F.array_join(F.array_sort("tags"), ",").alias("tags"), "score", F.md5("summary").alias("summary_md5"))
