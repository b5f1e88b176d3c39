"""Registered queries of the stored index and of what follows a first search, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.operators import evidence, patterns, postings, retrieval, tagging
from scriptorium.streaming import append

from . import workflow

from .catalogue import EVENTS, SCENES, TOPICS, document_index, query, table, word_array

def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(word_array("text")).alias("terms"))


_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"
_BM25 = rf"""
  held AS (SELECT doc_id, {_WORDS} AS w FROM documents),
  stats AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS mean FROM held),
  tf AS (SELECT doc_id, term, count(*)::DOUBLE AS tf, any_value(length) AS length FROM (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM held) GROUP BY doc_id, term),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  asked AS (SELECT item_id AS query_id, unnest(list_distinct({_WORDS})) AS term FROM benchmark),
  summed AS (SELECT query_id, doc_id AS item_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))) AS total
    FROM asked JOIN tf USING (term) JOIN df USING (term) CROSS JOIN stats GROUP BY ALL),
  bm25 AS (SELECT query_id, item_id, round(total, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(total, 4) DESC, item_id) AS rank FROM summed)"""


@query(f"WITH {_BM25} SELECT query_id, item_id, score, rank::INTEGER AS rank FROM bm25 WHERE rank <= 4")
def bm25_topk(spark, sf_dir):
    """Sparse recall: the 4 best documents of each benchmark text by BM25, from the stored index."""
    return postings.bm25(questions(spark, sf_dir), document_index(spark, sf_dir), 4)


def labels(text: str = "text"):
    """Topics and events of a text, as labels with their kind."""
    held = X.text_or_empty(F.col(text))
    return F.concat(F.transform(tagging.groups(held, TOPICS, len(TOPICS)), lambda t: F.concat(F.lit("topic:"), t)), F.transform(tagging.present(held, EVENTS, len(EVENTS)), lambda t: F.concat(F.lit("event:"), t)))


def _labels_sql(text: str) -> str:
    topic = ", ".join(f"CASE WHEN {' OR '.join(f'contains({text}, {chr(39)}{w}{chr(39)})' for w in ws)} THEN 'topic:{name}' END" for name, ws in TOPICS.items())
    event = ", ".join(f"CASE WHEN contains({text}, '{w}') THEN 'event:{w}' END" for w in EVENTS)
    return f"list_filter([{topic}, {event}], lambda x: x IS NOT NULL)"


@query(f"""WITH d AS (SELECT doc_id AS item_id, unnest({_labels_sql("coalesce(text, '')")}) AS term FROM documents), n AS (SELECT count(*)::DOUBLE AS n FROM documents), df AS (SELECT term, count(*) AS df FROM d GROUP BY term),
  q AS (SELECT item_id AS query_id, unnest({_labels_sql("coalesce(text, '')")}) AS term FROM benchmark),
  s AS (SELECT query_id, item_id, round(sum(CASE WHEN term LIKE 'event:%' THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))), 4) AS score FROM q JOIN d USING (term) JOIN df USING (term) CROSS JOIN n GROUP BY ALL)
SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INTEGER AS rank FROM s QUALIFY rank <= 8""")
def label_recall(spark, sf_dir):
    """Label recall: the 8 documents that share the rarest topics and events with each benchmark text, from a stored index of labels."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), labels().alias("terms"))
    of = postings.index(table(spark, sf_dir, "documents"), "doc_id", labels(), "labels")
    return postings.by_label(asked, of, 8, {"event:": 1.0, "topic:": 0.6})


#: Latin stand-ins for the groups of words in which a question may be put anew.
EXPANSIONS = [(["der", "die"], ["und", "der", "die", "von"]), (["les", "que"], ["les", "de", "que"]), (["the", "and"], ["the", "of", "and", "to"])]
#: Share of a question's words that an answer must hold.
ENOUGH = 0.7
_PUT_ANEW = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(text, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{' '.join(other)}'" for words, other in EXPANSIONS) + " ELSE text END"


def _attempt(name: str, asked: str) -> str:
    return rf"""
  {name}_words AS (SELECT query_id, unnest(list_distinct({_WORDS})) AS token, len(list_distinct({_WORDS})) AS n FROM {asked}),
  {name}_shared AS (SELECT query_id, item_id, count(*) AS overlap FROM {name}_words JOIN (SELECT DISTINCT doc_id AS item_id, unnest({_WORDS}) AS token FROM documents) USING (token) GROUP BY ALL),
  {name}_best AS (SELECT * FROM {name}_shared QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, item_id) = 1),
  {name} AS (SELECT a.query_id, b.item_id, coalesce(b.overlap, 0) AS overlap, coalesce(b.overlap, 0) >= {ENOUGH}::DOUBLE * len(list_distinct({_WORDS})) AND b.item_id IS NOT NULL AS passed FROM {asked} a LEFT JOIN {name}_best b USING (query_id))"""


@query(f"""WITH asked AS (SELECT item_id AS query_id, text FROM benchmark), {_attempt("one", "asked")},
  anew AS (SELECT query_id, {_PUT_ANEW} AS text FROM asked JOIN one USING (query_id) WHERE NOT passed), {_attempt("two", "anew")}
SELECT query_id, item_id, overlap, passed, 1::INTEGER AS attempts FROM one WHERE passed UNION ALL SELECT query_id, item_id, overlap, passed, 2 FROM two""")
def retried_answers(spark, sf_dir):
    """Benchmark texts answered by the document that holds most of their words; those without one that holds enough are put in other words and asked once more."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text", F.array_distinct(word_array("text")).alias("tokens"))
    of = document_index(spark, sf_dir)

    def attempt(rows: DataFrame, turn: int) -> DataFrame:
        best = postings.overlaps(rows.select("query_id", F.col("tokens").alias("terms")), of, 1)["overlap"].select("query_id", "item_id", "overlap")
        held = F.coalesce(F.col("overlap"), F.lit(0)).cast("long")
        return rows.join(best, "query_id", "left").select("query_id", "item_id", held.alias("overlap"), (F.col("item_id").isNotNull() & (held >= ENOUGH * F.size("tokens"))).alias("passed"))

    anew = lambda rows, turn: workflow.rewritten(rows.withColumn("text", F.coalesce("text", F.lit(""))), EXPANSIONS, most=1)
    return workflow.retried(asked, attempt, anew)


@query("""WITH e AS (SELECT user_id, ts, value, coalesce(ts > lag(ts) OVER w + INTERVAL 6 HOUR, TRUE)::INT AS new FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n, round(sum(value), 2) AS value FROM s GROUP BY user_id, s""")
def user_sessions(spark, sf_dir):
    """Session windows over the events of a user, six hours apart; the stream form is the same function."""
    found = append.sessions(table(spark, sf_dir, "events"), "ts", ["user_id"], "6 hours", sums={"value": F.col("value")})
    return found.withColumn("value", F.round("value", 2))


def _first(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return postings.bm25(questions(spark, sf_dir), document_index(spark, sf_dir), k)


@query(f"""WITH {_BM25}, hits AS (SELECT query_id, item_id, score, source AS chapter FROM bm25 JOIN documents ON doc_id = item_id WHERE rank <= 16),
  m AS (SELECT *, coalesce((item_id - lag(item_id) OVER w > 60)::INT, 1) AS new FROM hits WINDOW w AS (PARTITION BY query_id, chapter ORDER BY item_id)),
  n AS (SELECT *, sum(new) OVER (PARTITION BY query_id, chapter ORDER BY item_id ROWS UNBOUNDED PRECEDING) AS span FROM m),
  s AS (SELECT query_id, chapter, min(item_id) AS first, max(item_id) AS last, count(*) AS hits, max(score) AS best FROM n GROUP BY query_id, chapter, span),
  f AS (SELECT *, round(best * pow(0.8::DOUBLE, row_number() OVER (PARTITION BY query_id, chapter ORDER BY best DESC, first) - 1), 4) AS faded FROM s)
SELECT query_id, chapter, first, last, hits, faded, row_number() OVER (PARTITION BY query_id ORDER BY faded DESC, first)::INTEGER AS rank FROM f QUALIFY rank <= 4""")
def spanned_hits(spark, sf_dir):
    """Adjacent hits of a chapter (here a source; sixty ordinals apart at most) joined, and further spans of a chapter held back."""
    chapters = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("source").alias("chapter"))
    found = evidence.spans(_first(spark, sf_dir, 16).join(chapters, "item_id"), "chapter", "item_id", gap=60)
    return evidence.diverse(found, "chapter", "best", "first", 4).select("query_id", "chapter", "first", "last", "hits", "faded", "rank")


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("doc_id is not null")
    keys = F.array_compact(F.array(F.col("source"), F.concat(F.col("lang"), F.lit(":"), F.floor(F.col("doc_id") / 64).cast("string"))))
    return docs.select(F.col("doc_id").alias("chunk_id"), F.explode(keys).alias("section")).distinct()


@query(f"""WITH RECURSIVE {_BM25}, links AS (SELECT DISTINCT doc_id AS chunk_id, unnest(list_filter([source, lang || ':' || (doc_id // 64)], lambda x: x IS NOT NULL)) AS section FROM documents),
  doors AS (SELECT * FROM links WHERE section IN (SELECT section FROM links GROUP BY section HAVING count(*) <= 40)),
  walk AS (SELECT query_id, item_id AS chunk_id, 0 AS hop FROM bm25 WHERE rank <= 2 UNION SELECT w.query_id, b.chunk_id, w.hop + 1 FROM walk w JOIN doors a ON a.chunk_id = w.chunk_id JOIN doors b ON b.section = a.section WHERE w.hop < 2),
  reached AS (SELECT query_id, chunk_id, min(hop) AS hop FROM walk GROUP BY ALL),
  keys AS (SELECT query_id, count(DISTINCT section) AS sections, md5(string_agg(DISTINCT section, ',' ORDER BY section)) AS sections_md5 FROM reached JOIN links USING (chunk_id) GROUP BY query_id)
SELECT query_id, string_agg(chunk_id::VARCHAR, ',' ORDER BY chunk_id) FILTER (hop = 0) AS seeds, count(*) FILTER (hop > 0) AS expanded, md5(coalesce(string_agg(chunk_id::VARCHAR, ',' ORDER BY hop, chunk_id) FILTER (hop > 0), '')) AS expanded_md5, coalesce(any_value(sections), 0) AS sections, coalesce(any_value(sections_md5), md5('')) AS sections_md5
FROM reached LEFT JOIN keys USING (query_id) GROUP BY query_id""")
def evidence_bundles(spark, sf_dir):
    """Evidence across volumes: the two best documents of each benchmark text and what is within two steps of them through shared sections that are no hubs."""
    seeds = _first(spark, sf_dir, 2).select("query_id", F.col("item_id").alias("chunk_id"))
    sections = _sections(spark, sf_dir)
    found = evidence.bundles(evidence.bundled(seeds, sections, hops=2, hub=40), sections)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return found.select("query_id", joined("seeds").alias("seeds"), F.size("expanded").cast("long").alias("expanded"), F.md5(joined("expanded")).alias("expanded_md5"), F.size("sections").cast("long").alias("sections"), F.md5(joined("sections")).alias("sections_md5"))


def _scene_sql(text: str) -> str:
    told = ", ".join(f"{{'n': {' + '.join(f'contains({text}, {chr(39)}{w}{chr(39)})::INT' for w in ws)}, 'name': '{name}'}}" for name, ws in SCENES.items())
    return f"(SELECT CASE WHEN m.n > 0 THEN m.name ELSE 'none' END FROM (SELECT list_max([{told}]) AS m))"


@query(f"""WITH {_BM25}, q AS (SELECT item_id AS query_id, {_labels_sql("coalesce(text, '')")} AS asked, {_scene_sql("text")} AS scene FROM benchmark),
  d AS (SELECT doc_id AS item_id, {_labels_sql("coalesce(text, '')")} AS held, {_scene_sql("text")} AS scene, source, lang, n_chars % 10 / 10.0::DOUBLE AS priority FROM documents),
  first AS (SELECT query_id, item_id, score, rank, round(score / max(score) OVER (PARTITION BY query_id), 4) AS likeness FROM bm25 WHERE rank <= 16),
  f AS (SELECT first.*, (q.scene = d.scene)::INT::DOUBLE AS scene, round(len(list_intersect(asked, held)) / greatest(len(asked), 1)::DOUBLE, 4) AS labels, (((source IS NOT NULL)::INT + (lang IS NOT NULL)::INT) / 2)::DOUBLE AS coverage, round(priority, 4) AS priority FROM first JOIN q USING (query_id) JOIN d USING (item_id)),
  s AS (SELECT *, round(likeness * 0.5::DOUBLE + scene * 0.15::DOUBLE + labels * 0.15::DOUBLE + coverage * 0.1::DOUBLE + priority * 0.1::DOUBLE, 6) AS second FROM f)
SELECT query_id, item_id, likeness, scene, labels, coverage, priority, second, row_number() OVER (PARTITION BY query_id ORDER BY second DESC, rank, item_id)::INTEGER AS place FROM s QUALIFY place <= 4""")
def second_stage_rank(spark, sf_dir):
    """Second ranking: the first hits by likeness, scene, labels, covered sections and priority, weighted."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), labels().alias("asked"), tagging.best_group(F.col("text"), SCENES, "none").alias("asked_scene"))
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), labels().alias("held"), tagging.best_group(F.col("text"), SCENES, "none").alias("held_scene"), F.array_compact(F.array("source", "lang")).alias("sections"), (F.col("n_chars") % 10 / 10).alias("worth"))
    hits = _first(spark, sf_dir, 16)
    rows = items.join(F.broadcast(hits), "item_id").join(F.broadcast(asked), "query_id")  # 16 rows a question, and the questions
    features = {
        "likeness": (evidence.share_of_best(), 0.5), "scene": ((F.col("asked_scene") == F.col("held_scene")).cast("double"), 0.15),
        "labels": (F.size(F.array_intersect("asked", "held")) / F.greatest(F.size("asked"), F.lit(1)), 0.15), "coverage": (F.size("sections") / 2, 0.1), "priority": (F.col("worth"), 0.1),
    }
    return evidence.reordered(rows, features, 4).select("query_id", "item_id", *features, "second", "place")


#: Latin stand-ins for the label pools of perspectives.
POOLS = [("manager", "the"), ("manager", "and"), ("manager", "les"), ("subordinate", "der"), ("subordinate", "und"), ("subordinate", "que"), ("peer", "con"), ("peer", "los"), ("peer", "of"), ("observer", "ing"), ("observer", "tion"), ("observer", "ment")]


def _votes(name: str, of: str, text: str) -> str:
    return f"""
  {name}_votes AS (SELECT x.id, perspective, count(*) AS n, array_to_string(list_sort(list(term))[1:3], ',') AS terms FROM ({of}) x JOIN pools ON contains(x.text, term) GROUP BY ALL),
  {name} AS (SELECT id, CASE WHEN round(max(n) / sum(n)::DOUBLE, 4) >= 0.4 THEN arg_min(perspective, {{'n': -n, 'p': perspective}}) ELSE 'unknown' END AS perspective, round(max(n) / sum(n)::DOUBLE, 4) AS confidence, arg_min(terms, {{'n': -n, 'p': perspective}}) AS reason FROM {name}_votes GROUP BY id)"""


@query(f"""WITH {_BM25}, pools(perspective, term) AS (VALUES {", ".join(f"('{p}', '{t}')" for p, t in POOLS)}), {_votes("asked_by", "SELECT item_id AS id, text FROM benchmark", "text")}, {_votes("held_by", "SELECT doc_id AS id, text FROM documents", "text")},
  h AS (SELECT b.query_id, b.item_id, b.rank, coalesce(a.perspective, 'unknown') AS perspective, coalesce(a.confidence, 0) AS confidence, coalesce(a.reason, '') AS reason, coalesce(a.perspective <> 'unknown' AND a.perspective = coalesce(d.perspective, 'unknown'), FALSE) AS matched
    FROM bm25 b LEFT JOIN asked_by a ON a.id = b.query_id LEFT JOIN held_by d ON d.id = b.item_id WHERE b.rank <= 8)
SELECT query_id, item_id, rank::INTEGER AS rank, perspective, confidence, reason, matched FROM h QUALIFY matched OR NOT bool_or(matched) OVER (PARTITION BY query_id)""")
def perspective_hits(spark, sf_dir):
    """Perspectives by label pools, of questions and documents; hits of the question's perspective, or all where there is none."""
    pools = spark.createDataFrame(POOLS, "perspective string, term string")
    asked = evidence.perspectives(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), "query_id", "text", pools, least=0.4)
    items = evidence.perspectives(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text"), "item_id", "text", pools, least=0.4)
    return evidence.of_perspective(_first(spark, sf_dir, 8), asked, items).join(asked, "query_id").select("query_id", "item_id", "rank", "perspective", "confidence", "reason", "matched")


_EXPECTED = "expected AS (SELECT item_id AS query_id, min(doc_id) AS expected FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text)) GROUP BY item_id)"
_DETAILS = """{0}, {1},
  top AS (SELECT query_id, string_agg(item_id::VARCHAR, ',' ORDER BY rank) AS top FROM bm25 WHERE rank <= {2} GROUP BY query_id),
  details AS (SELECT e.query_id, e.expected, r.rank IS NOT NULL AS hit, coalesce(r.rank, -1)::INTEGER AS rank, round(coalesce(1.0::DOUBLE / r.rank, 0), 6) AS reciprocal_rank, coalesce(top, '') AS top
    FROM expected e LEFT JOIN bm25 r ON r.query_id = e.query_id AND r.item_id = e.expected AND r.rank <= {2} LEFT JOIN top t ON t.query_id = e.query_id)"""


def _details(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("hay"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lower("text").alias("pattern"))
    truth = patterns.contained(docs, "doc_id", "hay", items, "pattern").join(items, "pattern").groupBy("query_id").agg(F.min("doc_id").alias("item_id"))
    return retrieval.evaluation_rows(_first(spark, sf_dir, k), truth)


@query(f"WITH {_DETAILS.format(_BM25, _EXPECTED, 4)} SELECT * FROM details")
def retrieval_details(spark, sf_dir):
    """For every benchmark text that some document holds whether BM25 finds the first of them among its four best, with what it found."""
    return _details(spark, sf_dir, 4).withColumn("top", F.array_join(F.transform("top", lambda x: x.cast("string")), ","))


@query(f"""WITH {_DETAILS.format(_BM25, _EXPECTED, 1)}, m AS (SELECT query_id, expected, coalesce(lang, '') AS lang, row_number() OVER (PARTITION BY coalesce(lang, '') ORDER BY query_id)::INTEGER AS place FROM details JOIN documents ON doc_id = expected WHERE NOT hit)
SELECT * FROM m WHERE place <= 10""")
def retrieval_misses(spark, sf_dir):
    """The first ten texts of each language for which another document comes first."""
    langs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("expected"), F.coalesce("lang", F.lit("")).alias("lang"))
    return retrieval.misses(langs.join(F.broadcast(_details(spark, sf_dir, 1)), "expected"), "lang").select("query_id", "expected", "lang", "place")
