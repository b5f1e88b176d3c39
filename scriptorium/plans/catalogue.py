"""Registered queries over the given tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.functions import tokens as T
from scriptorium.operators import audit, chunking, extraction, intent, merging, ordering, patterns, postings, report, retrieval, sections, tagging
from scriptorium.sources import files
from scriptorium.streaming import append

from . import workflow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Latin stand-ins for the vocabularies, for the tables at hand.
NOISE = ["the", "and", "that", "with"]
TOPICS = {"power": ["the", "les"], "people": ["ing", "ment"], "alliance": ["und", "der"], "time": ["tion", "ción"], "trust": ["con", "que"]}
EVENTS = ["ment", "tion", "keit", "ción", "ing", "heit", "eau"]
MODERN, CLASSICAL = ["the", "of", "les", "der", "que"], ["with", "von", "qui", "los"]
MARKERS = ["Licensed", "Released", "All rights"]
INTENT = {"commentary": ["qui"], "analysis": ["nicht", "thing"], "first_person": ["auch", "was"], "lookup": ["avec", "eine"], "factual": ["de", "of"], "domain": ["the", "der"], "out_of_scope": ["ión", "est"]}
SCENES = {"upward": ["the", "and"], "team": ["der", "die", "und"], "trust": ["les", "que"], "exit": ["los", "con"]}
ROLES = {"user": "asker", "assistant": "adviser", "system": "rule maker"}


def query(sql: str = ""):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_array(text: str):
    """All words of a text, in lower case."""
    return F.regexp_extract_all(F.lower(X.text_or_empty(F.col(text))), F.lit(T.LATIN_TOKEN), F.lit(0))


def document_index(spark: SparkSession, sf_dir: str) -> postings.Index:
    """The stored index of the documents' words."""
    return postings.index(table(spark, sf_dir, "documents"), "doc_id", F.lower(X.text_or_empty(F.col("text"))), "words", T.LATIN_GAP)


def _overlaps(spark: SparkSession, sf_dir: str, k: int) -> dict[str, DataFrame]:
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(word_array("text")).alias("terms"))
    return postings.overlaps(questions, document_index(spark, sf_dir), k, noise=tuple(NOISE))


_LEXICAL = r"""
  q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS token FROM benchmark),
  d AS (SELECT doc_id AS item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS token FROM documents),
  s AS (SELECT query_id, item_id, count(*) AS overlap,
          sum(CASE WHEN token IN ('the', 'and', 'that', 'with') THEN 0 WHEN length(token) >= 3 THEN 1.35::DOUBLE WHEN length(token) = 2 THEN 0.9::DOUBLE ELSE 0 END) AS bonus
        FROM q JOIN d USING (token) GROUP BY ALL),
  lexical AS (SELECT query_id, item_id, overlap, round(ln(1 + overlap::DOUBLE) + least(4.5::DOUBLE, bonus) + 0.5::DOUBLE * 0.35::DOUBLE, 4) AS score FROM s)
"""


@query(f"WITH {_LEXICAL} SELECT query_id, item_id, overlap, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM lexical) WHERE rank <= 4")
def token_overlap_topk(spark, sf_dir):
    """The 4 best documents for each benchmark text."""
    return _overlaps(spark, sf_dir, 4)["scored"]


@query(r"""
SELECT item_id, list_sort(list_transform(list_distinct(list_transform(list_filter(regexp_extract_all(regexp_replace(replace(replace(replace(replace(text, 'that', ' '), 'with', ' '), 'the', ' '), 'and', ' '), '^$', ''), '[\p{L}\p{N}_]+'),
  lambda t: length(t) >= 2), lambda t: lower(t))), lambda t: lpad((1000 - length(t))::VARCHAR, 4, '0') || t)) AS keyed,
  len(keyed)::INTEGER AS n_terms, array_to_string(list_transform(keyed, lambda t: t[5:]), ' ') AS terms FROM benchmark
""".replace("SELECT item_id, list_sort", "SELECT item_id, n_terms, terms FROM (SELECT item_id, list_sort") + ")")
def query_terms(spark, sf_dir):
    """K3, K4: cleaned terms of the benchmark texts, longest first."""
    terms = T.clean_terms(T.query_terms(F.col("text"), ["that", "with", "the", "and"], dense=False))
    return table(spark, sf_dir, "benchmark").select("item_id", terms.alias("t")).select("item_id", F.size("t").alias("n_terms"), F.array_join("t", " ").alias("terms"))


_VECTORS = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


def _dense(spark, sf_dir, limit):
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieval.dense_ranked(asked, rows.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")), limit, digits=4, but_own=True)


_DENSE = _VECTORS + """,
  dense AS (SELECT q.vec_id AS query_id, c.vec_id AS item_id, round(list_dot_product(q.v, c.v), 4) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
  top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM dense)"""


@query(f"WITH {_DENSE} SELECT query_id, item_id, score, rank::INTEGER AS rank FROM top WHERE rank <= 4")
def dense_topk(spark, sf_dir):
    """The 4 nearest vectors of every hundredth one."""
    return _dense(spark, sf_dir, 4)


@query(f"""WITH {_DENSE}, hits AS (SELECT t.query_id, t.rank FROM top t JOIN v a ON a.vec_id = t.query_id JOIN v b ON b.vec_id = t.item_id WHERE rank <= 4 AND a.label = b.label),
  f AS (SELECT q.vec_id, q.label, min(h.rank) AS rank FROM v q LEFT JOIN hits h ON h.query_id = q.vec_id WHERE q.vec_id % 100 = 0 GROUP BY ALL)
SELECT label, count(*) AS n, round(avg((rank IS NOT NULL)::INT), 6) AS hit_rate, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr FROM f GROUP BY ROLLUP (label)""")
def retrieval_eval(spark, sf_dir):
    """Hit rate at 4 and reciprocal rank, an equal label being the truth, by label and overall."""
    rows = table(spark, sf_dir, "embeddings")
    labels = rows.select(F.col("vec_id").alias("item_id"), F.col("label").alias("item_label"))
    hits = _dense(spark, sf_dir, 4).join(labels, "item_id").select("query_id", F.col("item_label").alias("label"), "rank")
    truth = rows.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "label")
    first = truth.join(hits, ["query_id", "label"], "left").groupBy("query_id", "label").agg(F.min("rank").alias("rank"))
    return retrieval.evaluated(first.select("query_id", F.lit(1).alias("item"), "rank").where("rank is not null"), truth.withColumn("item", F.lit(1)), ["label"], item="item")


@query(f"""WITH {_LEXICAL},
  a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM lexical QUALIFY rank <= 16),
  o AS (SELECT query_id, item_id, overlap::DOUBLE AS score FROM lexical),
  b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM o QUALIFY rank <= 16),
  u AS (SELECT query_id, item_id, rank, 0 AS i, 'scored' AS name FROM a UNION ALL SELECT query_id, item_id, rank, 1, 'overlap' FROM b),
  f AS (SELECT query_id, item_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, string_agg(name, '+' ORDER BY i) AS branches FROM u GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM f)
SELECT query_id, item_id, score, branches, rank::INTEGER AS rank FROM r WHERE rank <= 4""")
def rrf_fusion(spark, sf_dir):
    """Two rankings of the documents, fused."""
    return retrieval.fused(_overlaps(spark, sf_dir, retrieval.branch_limit(4)), limit=4)


@query("""WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
  h AS (SELECT conv_id // 10 AS query_id, conv_id AS item_id, max(turn) AS turns FROM conversations GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY turns DESC, item_id) AS rank FROM h),
  e AS (SELECT r.query_id, r.item_id::VARCHAR AS item, conv_id || ':' || turn AS member, r.turns::DOUBLE AS score, row_number() OVER (PARTITION BY r.query_id ORDER BY rank, n) AS place
        FROM r JOIN t ON t.conv_id = r.item_id WHERE rank <= 4 AND n <= 2)
SELECT query_id, item, member, score, place::INTEGER AS place FROM e WHERE place <= 6""")
def expand_evidence(spark, sf_dir):
    """The longest conversations of each block of ten, expanded to their first turns."""
    turns = table(spark, sf_dir, "conversations")
    hits = turns.groupBy(F.floor(F.col("conv_id") / 10).alias("query_id"), F.col("conv_id").alias("item_id")).agg(F.max("turn").cast("double").alias("score"))
    lists = chunking.ordered_list(turns.select(F.col("conv_id").alias("item_id"), "turn"), ["item_id"], "turn")
    members = lists.select("item_id", F.transform("pieces", lambda p: F.concat(F.col("item_id").cast("string"), F.lit(":"), p["turn"].cast("string"))).alias("members"))
    return retrieval.expanded(retrieval.ranked(hits, "query_id", "item_id", "score", 4), members)


@query(r"""SELECT lang, count(*) AS documents, sum(len(s)) AS sentences, round(avg(len(s)), 4) AS mean_sentences, max(len(s)) AS most
FROM (SELECT lang, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[^.!?;\n]+[.!?;]?'), lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM documents) GROUP BY lang""")
def sentence_split_stats(spark, sf_dir):
    """Sentences per language."""
    n = F.size(X.sentences(F.col("text"))).cast("long")
    return table(spark, sf_dir, "documents").select("lang", n.alias("s")).groupBy("lang").agg(F.count("*").alias("documents"), F.sum("s").alias("sentences"), F.round(F.avg("s"), 4).alias("mean_sentences"), F.max("s").alias("most"))


_KEYED = r"k AS (SELECT *, lower(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}_]', '', 'g')) AS norm FROM documents)"


@query(f"""WITH {_KEYED}, g AS (SELECT norm, lang, count(*) AS n, min(doc_id) AS first, list_distinct(list(source)) AS sources FROM k GROUP BY ALL)
SELECT norm_sha, n::BIGINT AS n, first_id, names, kinds FROM (
  SELECT md5(norm) AS norm_sha, sum(n) AS n, min(first) AS first_id, array_to_string(list_sort(list_distinct(flatten(list(sources)))), ',') AS names, string_agg(lang || ':' || n, ',' ORDER BY lang) AS kinds FROM g GROUP BY norm) WHERE n >= 2""")
def normalize_text_groups(spark, sf_dir):
    """Groups of documents with equal normalised text."""
    rows = table(spark, sf_dir, "documents").withColumn("norm_sha", F.md5(X.comparable(F.col("text"))))
    return audit.large_groups(rows, "norm_sha", 2, "doc_id", "source", "lang")


@query(f"""WITH {_KEYED},
  g AS (SELECT doc_id, lang, unnest(CASE WHEN length(norm) = 0 THEN [] WHEN length(norm) <= 2 THEN [norm] ELSE list_distinct(list_transform(range(1, length(norm)), lambda i: ch[i] || ch[i + 1])) END) AS gram FROM (SELECT *, string_split(norm, '') AS ch FROM k)),
  n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
  s AS (SELECT doc_id AS a, doc_id + unnest([1, 2, 3, 4, 5]) AS b, lang, gram FROM g),
  c AS (SELECT s.a, s.b, count(*) AS c FROM s JOIN g ON g.doc_id = s.b AND g.gram = s.gram AND g.lang IS NOT DISTINCT FROM s.lang GROUP BY ALL)
SELECT a, b, round(c::DOUBLE / (x.n + y.n - c), 6) AS similarity FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c::DOUBLE / (x.n + y.n - c) >= 0.82""")
def near_dup_pairs(spark, sf_dir):
    """Near duplicates at most five documents apart, in one language."""
    return merging.adjacent_near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", ["lang"])


@query("SELECT item_id, count(doc_id) AS documents, min(doc_id) AS first_doc FROM benchmark LEFT JOIN documents ON contains(lower(documents.text), lower(benchmark.text)) GROUP BY item_id")
def benchmark_containment(spark, sf_dir):
    """The containment join of section 2.8: documents that hold a whole benchmark text, by one automaton over all of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("hay"))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("pattern"))
    held = patterns.contained(docs, "doc_id", "hay", items, "pattern").groupBy("pattern").agg(F.count("doc_id").alias("n"), F.min("doc_id").alias("first"))
    return items.join(held, "pattern", "left").groupBy("item_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("documents"), F.min("first").alias("first_doc"))


@query("""SELECT doc_id, s AS start, length(substring(text, s::BIGINT + 1, 1400))::INTEGER AS chars, md5(substring(text, s::BIGINT + 1, 1400)) AS text_md5
FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 240, 1), 1160))::INTEGER AS s FROM documents WHERE length(text) > 0)""")
def char_windows(spark, sf_dir):
    """Character windows of 1400 with 240 overlap."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(chunking.character_windows(F.col("text"))).alias("w"))
    return rows.select("doc_id", "w.start", F.length("w.text").alias("chars"), F.md5("w.text").alias("text_md5"))


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
  f AS (SELECT conv_id, i, n::BIGINT AS size, 1 AS pack FROM t WHERE i = 1
    UNION ALL SELECT t.conv_id, t.i, CASE WHEN f.size + t.n > 1600 THEN t.n ELSE f.size + t.n END, CASE WHEN f.size + t.n > 1600 THEN f.pack + 1 ELSE f.pack END FROM f JOIN t ON t.conv_id = f.conv_id AND t.i = f.i + 1)
SELECT conv_id, pack::INTEGER AS pack, min(i)::INTEGER AS first, max(i)::INTEGER AS last, max(size)::INTEGER AS size FROM f GROUP BY conv_id, pack""")
def pack_chunks_sized(spark, sf_dir):
    """Turns of a conversation in packs of up to 1600 characters."""
    lists = chunking.ordered_list(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text")
    packs = chunking.sized_packs(F.transform("pieces", lambda p: F.length(F.coalesce(p["text"], F.lit("")))), 1600)
    return lists.select("conv_id", F.posexplode(packs).alias("n", "p")).select("conv_id", (F.col("n") + 1).alias("pack"), "p.first", "p.last", "p.size")


_LINES = "l AS (SELECT doc_id, list_transform(list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: trim(s, ' ') <> ''), lambda s: length(s)) AS sizes FROM documents)"
_NO_PACK = "[]::STRUCT(first INTEGER, last INTEGER, size BIGINT)[]"
_PACK = "[{{'first': {0}::INTEGER, 'last': {1}::INTEGER, 'size': {2}::BIGINT}}]".format


@query(f"""WITH RECURSIVE {_LINES},
  f AS (SELECT doc_id, sizes, 0 AS i, 0 AS first, 0 AS last, 0::BIGINT AS size, FALSE AS fresh, 0::BIGINT AS tail, {_NO_PACK} AS made FROM l
    UNION ALL
    SELECT doc_id, sizes, i, CASE WHEN n > 1600 THEN 0 WHEN grown >= 1600 THEN i ELSE begin END, CASE WHEN n > 1600 THEN 0 ELSE i END, CASE WHEN n > 1600 THEN 0 WHEN grown >= 1600 THEN n ELSE grown END, n <= 1600 AND grown < 1600, CASE WHEN n > 1600 THEN 0 ELSE n END,
      CASE WHEN n > 1600 THEN CASE WHEN first > 0 AND fresh THEN {_PACK('first', 'last', 'size')} ELSE {_NO_PACK} END || {_PACK('i', 'i', 'n')}
        ELSE CASE WHEN ends THEN {_PACK('first', 'last', 'size')} ELSE {_NO_PACK} END || CASE WHEN grown >= 1600 THEN {_PACK('begin', 'i', 'grown')} ELSE {_NO_PACK} END END
    FROM (SELECT *, CASE WHEN ends THEN CASE WHEN tail + n + 1 <= 1600 THEN last ELSE i END WHEN first > 0 THEN first ELSE i END AS begin, CASE WHEN ends THEN CASE WHEN tail + n + 1 <= 1600 THEN tail + n + 1 ELSE n END WHEN first > 0 THEN size + n + 1 ELSE n END AS grown
      FROM (SELECT * EXCLUDE (i), i + 1 AS i, sizes[i + 1] AS n, first > 0 AND (size + sizes[i + 1] + 1 > 1600 OR (size >= 900 AND size + sizes[i + 1] + 1 > 1400)) AS ends FROM f WHERE i < len(sizes)))),
  m AS (SELECT doc_id, i, unnest(CASE WHEN i = len(sizes) AND first > 0 AND fresh THEN made || {_PACK('first', 'last', 'size')} ELSE made END) AS p, generate_subscripts(CASE WHEN i = len(sizes) AND first > 0 AND fresh THEN made || {_PACK('first', 'last', 'size')} ELSE made END, 1) AS k FROM f)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, k)::INTEGER AS pack, p.first AS first, p.last AS last, p.size::INTEGER AS size FROM m""")
def pack_chunks_overlap(spark, sf_dir):
    """Lines of a document in packs with the last line carried over."""
    lines = F.filter(F.split(X.text_or_empty(F.col("text")), "\n"), lambda s: F.trim(s) != "")
    rows = table(spark, sf_dir, "documents").select("doc_id", lines.alias("lines"))
    packs = rows.select("doc_id", "lines", F.posexplode(chunking.overlapping_packs(F.transform("lines", F.length))).alias("n", "p"))
    return packs.select("doc_id", (F.col("n") + 1).alias("pack"), "p.first", "p.last", "p.size")


@query("SELECT conv_id, count(*)::INTEGER AS pieces, sum(length(coalesce(text, '')))::INTEGER AS chars, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY turn)) AS text_md5 FROM conversations GROUP BY conv_id")
def whole_group_window(spark, sf_dir):
    """One window over each conversation."""
    rows = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    return chunking.group_windows(rows, "conv_id", "turn", "text").select("conv_id", "pieces", "chars", F.md5("text").alias("text_md5"))


@query("SELECT doc_id, array_to_string(list_filter(['ment', 'tion', 'keit', 'ción', 'ing', 'heit', 'eau'], lambda w: contains(text, w))[1:5], ',') AS events FROM documents")
def event_tags(spark, sf_dir):
    """The first five event words of each document."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tagging.present(F.col("text"), EVENTS), ",").alias("events"))


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(text, 'the') OR contains(text, 'les') THEN 'power' END, CASE WHEN contains(text, 'ing') OR contains(text, 'ment') THEN 'people' END,
  CASE WHEN contains(text, 'und') OR contains(text, 'der') THEN 'alliance' END, CASE WHEN contains(text, 'tion') OR contains(text, 'ción') THEN 'time' END, CASE WHEN contains(text, 'con') OR contains(text, 'que') THEN 'trust' END], lambda x: x IS NOT NULL)[1:3], ',') AS topics FROM documents""")
def keyword_tags(spark, sf_dir):
    """The first three topic groups of each document."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tagging.groups(F.col("text"), TOPICS), ",").alias("topics"))


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), p AS (SELECT doc_id, text, least(nullif(strpos(text, 'Licensed'), 0), nullif(strpos(text, 'Released'), 0), nullif(strpos(text, 'All rights'), 0)) AS pos FROM d)
SELECT doc_id, length(CASE WHEN pos IS NULL THEN trim(text, ' ') ELSE trim(left(text, pos - 1), ' ') END)::INTEGER AS fact_chars, CASE WHEN pos IS NULL THEN '' ELSE md5(trim(substring(text, pos), ' ')) END AS comment_md5 FROM p""")
def marker_split(spark, sf_dir):
    """Documents cut at the first marker."""
    cut = sections.fact_and_comment(X.text_or_empty(F.col("text")), MARKERS)
    rows = table(spark, sf_dir, "documents").select("doc_id", cut.alias("c"))
    return rows.select("doc_id", F.length("c.fact").alias("fact_chars"), F.when(F.col("c.comment") == "", "").otherwise(F.md5("c.comment")).alias("comment_md5"))


def _occurs(word: str) -> str:
    return f"((length(text) - length(replace(text, '{word}', ''))) // {len(word)})"


@query(f"SELECT doc_id, ({' + '.join(map(_occurs, MODERN))} - ({' + '.join(map(_occurs, CLASSICAL))}))::INTEGER AS score FROM documents")
def modern_score(spark, sf_dir):
    """Marks of one style less marks of the other."""
    return table(spark, sf_dir, "documents").select("doc_id", tagging.modern_score(F.col("text"), MODERN, CLASSICAL).alias("score"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
  t AS (SELECT doc_id, line, trim(raw, ' ') AS text FROM l WHERE trim(raw, ' ') <> ''),
  k AS (SELECT *, CASE WHEN regexp_matches(text, '^[A-Z][^ ]*\.$') THEN 'chapter' WHEN length(text) <= 40 THEN 'year' ELSE 'text' END AS kind FROM t),
  c AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'chapter' THEN text END IGNORE NULLS) OVER w, '') AS chapter, coalesce(last_value(CASE WHEN kind = 'year' THEN text WHEN kind = 'chapter' THEN '' END IGNORE NULLS) OVER w, '') AS year
    FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT doc_id, chapter, year, count(*) AS lines, sum(length(text))::BIGINT AS chars FROM c WHERE kind = 'text' GROUP BY ALL""")
def carry_headings(spark, sf_dir):
    """Headings carried over the lines of a document."""
    lines = sections.lines_of(table(spark, sf_dir, "documents"), "doc_id", "text")
    kind = F.when(F.col("text").rlike(r"^[A-Z][^ ]*\.$"), "chapter").when(F.length("text") <= 40, "year").otherwise("text")
    rows = sections.carried(lines.withColumn("kind", kind), "doc_id", "line", F.col("kind"), "text", ["chapter", "year"]).where("kind = 'text'")
    return rows.groupBy("doc_id", "chapter", "year").agg(F.count("*").alias("lines"), F.sum(F.length("text")).alias("chars"))


@query(r"""WITH e AS (SELECT page_id, regexp_extract_all(html, '<h1>[^<]*</h1>') AS h FROM pages)
SELECT page_id, len(h)::INTEGER AS headings, trim(regexp_replace(regexp_replace(coalesce(h[1], ''), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM e""")
def html_headings(spark, sf_dir):
    """Flat first-level headings of the pages."""
    found = sections.flat_elements(F.col("html"), ["h1"])
    return table(spark, sf_dir, "pages").select("page_id", found.alias("h")).select("page_id", F.size("h").alias("headings"), F.coalesce(F.get("h", F.lit(0))["text"], F.lit("")).alias("title"))


@query()
def html_elements(spark, sf_dir):
    """Text elements of the pages with their headings, by the full parser."""
    return sections.element_chunks(sections.parsed_elements(table(spark, sf_dir, "pages"), "page_id", "html")).select(F.col("id").alias("page_id"), "place", "h1", "h2", "h3", "text")


def _any(words, column="text"):
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


@query(f"""SELECT conv_id, turn, CASE WHEN {_any(INTENT['out_of_scope'])} AND NOT {_any(INTENT['domain'])} THEN 'out_of_scope' WHEN {_any(INTENT['commentary'])} THEN 'commentary_lookup'
  WHEN {_any(INTENT['analysis'])} OR {_any(INTENT['first_person'])} THEN 'analysis' WHEN {_any(INTENT['lookup'])} THEN 'factual_lookup' WHEN {_any(INTENT['factual'])} AND length(text) <= 36 THEN 'factual_lookup' ELSE 'analysis' END AS intent
FROM conversations WHERE role = 'user'""")
def intent_route(spark, sf_dir):
    """Intent of the user turns by rules."""
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", intent.rule_intent(F.col("text"), INTENT).alias("intent"))


@query("WITH c AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), s AS (" + " UNION ALL ".join(
    f"SELECT conv_id, turn, '{name}' AS scene, " + " + ".join(f"contains(text, '{w}')::INT" for w in words) + " AS n FROM c" for name, words in SCENES.items()
) + ") SELECT conv_id, turn, CASE WHEN max(n) = 0 THEN 'none' ELSE arg_max(scene, lpad(n::VARCHAR, 3, '0') || scene) END AS scene FROM s GROUP BY conv_id, turn")
def scene_pick(spark, sf_dir):
    """The scene with most keywords; ties to the greatest name."""
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", tagging.best_group(F.col("text"), SCENES, "none").alias("scene"))


@query("SELECT role, CASE role WHEN 'user' THEN 'asker' WHEN 'assistant' THEN 'adviser' WHEN 'system' THEN 'rule maker' ELSE trim(role) END AS canonical, count(*) AS turns FROM conversations GROUP BY role")
def role_normalize(spark, sf_dir):
    """Canonical roles."""
    rows = table(spark, sf_dir, "conversations").withColumn("canonical", merging.canonical_role(F.col("role"), ROLES))
    return rows.groupBy("role", "canonical").agg(F.count("*").alias("turns"))


@query(f"""WITH {_KEYED} SELECT arg_max(doc_id, n_chars * 1000000000 - doc_id) AS doc_id, list_sort(list_distinct(list(source))) AS sources, max(n_chars) AS max_n_chars, count(*) AS members FROM k GROUP BY norm, lang""")
def exact_dedupe_merge(spark, sf_dir):
    """Documents with equal normalised text and language merged, the longest kept."""
    rows = table(spark, sf_dir, "documents")
    return merging.exact_groups(rows, [X.comparable(F.col("text")), F.col("lang")], [F.col("n_chars"), -F.col("doc_id")], ["doc_id"], ["source"], ["n_chars"])


@query("""SELECT conv_id, max(turn) AS turn, max(length(text))::INTEGER AS chars, list_sort(list_distinct(list(role))) AS role FROM conversations GROUP BY conv_id""")
def collapse_outputs(spark, sf_dir):
    """Maxima and distinct notes per conversation."""
    return merging.collapsed(table(spark, sf_dir, "conversations").withColumn("chars", F.length("text")), "conv_id", ["turn", "chars"], "role")


@query("""WITH a AS (SELECT conv_id, role AS name, arg_max(text, length(text) * 1000000 - turn) AS role, min(turn) AS f FROM conversations WHERE trim(role) <> '' GROUP BY conv_id, role)
SELECT conv_id, name, role, row_number() OVER (PARTITION BY conv_id ORDER BY f, name)::INTEGER AS place FROM a QUALIFY place <= 5""")
def merged_speakers(spark, sf_dir):
    """Speakers of a conversation by name, with their longest description, in order of first mention."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("role").alias("name"), F.col("text").alias("role"), F.col("turn").alias("position"))
    return merging.merged_actors(rows, "conv_id")


@query("""SELECT count(*) AS n, count_if(l.quality = 1) AS good, count_if(l.toxic = 1) AS toxic, count_if(l.doc_id IS NULL) AS unlabelled,
  round(count_if(l.quality = 1) / count(*)::DOUBLE, 6) AS good_share, round(count_if(l.toxic = 1) / count(*)::DOUBLE, 6) AS toxic_share, round(count_if(l.doc_id IS NULL) / count(*)::DOUBLE, 6) AS unlabelled_share, sum(n_chars)::BIGINT AS chars
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def audit_summary(spark, sf_dir):
    """A5: one row of corpus metrics."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "label_id"), F.col("doc_id") == F.col("label_id"), "left")
    conditions = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1, "unlabelled": F.col("label_id").isNull()}
    return audit.summary(rows.select("quality", F.col("toxic"), "label_id", "n_chars"), conditions, {"chars": F.col("n_chars")})


@query("""SELECT field, missing FROM (SELECT count_if(trim(coalesce(text, '')) = '') AS text, count_if(trim(coalesce(lang, '')) = '') AS lang, count_if(trim(coalesce(source, '')) = '') AS source FROM documents) UNPIVOT (missing FOR field IN (text, lang, source))""")
def missing_fields(spark, sf_dir):
    """Blank fields of the documents."""
    return audit.missing(table(spark, sf_dir, "documents"), ["text", "lang", "source"])


@query("SELECT source, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY source ORDER BY n DESC, first LIMIT 20")
def top_counts(spark, sf_dir):
    """The most frequent sources."""
    return audit.top_counts(table(spark, sf_dir, "documents"), "source", "doc_id")


@query("""SELECT lang, count(*) AS n, min(length(text))::BIGINT AS shortest, max(length(text))::BIGINT AS longest, round(avg(length(text)), 1) AS mean, round(median(length(text)), 1) AS median,
  count_if(length(text) BETWEEN 900 AND 1400) AS in_range, count_if(length(text) > 1600) AS over FROM documents GROUP BY lang""")
def length_stats(spark, sf_dir):
    """A1, A2: length statistics per language."""
    return audit.length_stats(table(spark, sf_dir, "documents"), F.length("text"), ["lang"])


@query("SELECT source, n, hits, round(hits / n::DOUBLE, 6) AS share FROM (SELECT source, count(*) AS n, count_if(length(text) < 200) AS hits FROM documents GROUP BY source) WHERE hits >= 4 OR round(hits / n::DOUBLE, 6) >= 0.05")
def outlier_groups(spark, sf_dir):
    """A3: sources with many short documents."""
    return audit.outliers(table(spark, sf_dir, "documents"), "source", F.length("text") < 200)


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN length(text) < 200 THEN 'short' END, CASE WHEN contains(text, '###') THEN 'marks' END, CASE WHEN length(text) > 20000 THEN 'long' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM documents WHERE length(text) < 200 OR contains(text, '###') OR length(text) > 20000""")
def review_candidates(spark, sf_dir):
    """A10: documents to look at, with the reasons."""
    n = F.length("text")
    found = audit.review_candidates(table(spark, sf_dir, "documents"), "doc_id", {"short": n < 200, "marks": F.contains("text", F.lit("###")), "long": n > 20000})
    return found.select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query("SELECT doc_id FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 300")
def random_sample(spark, sf_dir):
    """300 documents, the same on every run."""
    return audit.sampled(table(spark, sf_dir, "documents"), "doc_id", 300).select("doc_id")


@query("SELECT doc_id, n_chars FROM documents ANTI JOIN labels USING (doc_id)")
def resume_pending(spark, sf_dir):
    """Documents that no output has yet."""
    return files.pending(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), None, "doc_id").select("doc_id", "n_chars")


@query("""WITH c AS (SELECT conv_id, list_sort(list_distinct(list(turn))) AS chunks FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
SELECT conv_id, turn, array_to_string(coalesce(chunks, []), ',') AS chunks FROM conversations LEFT JOIN c USING (conv_id) WHERE role = 'user'""")
def commentary_links(spark, sf_dir):
    """User turns with the answers of their conversation; an empty list where there is none."""
    turns = table(spark, sf_dir, "conversations")
    answers = turns.where("role = 'assistant'").select(F.col("turn").alias("chunk_id"), F.array("conv_id").alias("keys"))
    linked = chunking.links(turns.where("role = 'user'").select("conv_id", "turn"), answers, "conv_id", "turn")
    return linked.select("conv_id", "turn", F.array_join(F.transform("chunks", lambda c: c.cast("string")), ",").alias("chunks"))


@query("""WITH d AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, lang IS DISTINCT FROM lag(lang) OVER (PARTITION BY source ORDER BY doc_id) AS new FROM documents)
SELECT doc_id, sum(CASE WHEN n = 1 OR new THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS run FROM d""")
def consecutive_runs(spark, sf_dir):
    """Runs of consecutive documents of a source with one language (A, B, A are three)."""
    return ordering.run_numbers(table(spark, sf_dir, "documents"), ["source"], "doc_id", ["lang"]).select("doc_id", "run")


@query("""SELECT doc_id, md5(CASE WHEN length(t) > 280 THEN left(t, 277) || '...' ELSE t END) AS brief_md5, left(regexp_replace(regexp_replace(t, '[^0-9A-Za-z一-鿿]+', '-', 'g'), '^-+|-+$', '', 'g'), 24) AS slug
FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]+>', '', 'g'), '\\s+', ' ', 'g'), ' ') AS t FROM documents)""".replace("\\\\", "\\"))
def text_scalars(spark, sf_dir):
    """Normalised, shortened and slugged texts."""
    rows = table(spark, sf_dir, "documents").withColumn("t", X.normalized(F.col("text")))
    return rows.select("doc_id", F.md5(X.shortened(F.col("t"))).alias("brief_md5"), X.slug(F.col("t")).alias("slug"))


@query("SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    """Tumbling windows over the events, the batch form of the streaming operator (an extension)."""
    return append.windowed_counts(table(spark, sf_dir, "events"), "ts", ["event_type"])


@query("""SELECT n.n_name AS nation, count(*) AS orders, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE l.l_returnflag = 'R' GROUP BY n.n_name""")
def star_revenue(spark, sf_dir):
    """Plumbing: a star join with an aggregate."""
    t = lambda name: table(spark, sf_dir, name)
    rows = t("lineitem").where("l_returnflag = 'R'").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(F.col("n_name").alias("nation")).agg(F.count("*").alias("orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query(r"""WITH RECURSIVE g AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, CASE WHEN length(norm) = 0 THEN []::VARCHAR[] WHEN length(norm) <= 2 THEN [norm] ELSE list_distinct(list_transform(range(1, length(norm)), lambda j: substring(norm, j, 2))) END AS grams
    FROM (SELECT conv_id, turn, lower(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}_]', '', 'g')) AS norm FROM conversations)),
  f AS (SELECT conv_id, 0::BIGINT AS i, NULL::BIGINT AS turn, NULL::BIGINT AS merged_into, []::STRUCT(turn BIGINT, grams VARCHAR[])[] AS kept FROM g WHERE i = 1
    UNION ALL SELECT conv_id, i, turn, coalesce(into_, turn), CASE WHEN into_ IS NULL THEN kept || [{'turn': turn, 'grams': grams}] ELSE kept END
    FROM (SELECT g.conv_id, g.i, g.turn, g.grams, f.kept, list_filter(f.kept[-5:], lambda k: len(k.grams) > 0 AND len(g.grams) > 0 AND len(list_intersect(k.grams, g.grams))::DOUBLE / (len(k.grams) + len(g.grams) - len(list_intersect(k.grams, g.grams))) >= 0.82)[-1].turn AS into_
      FROM f JOIN g ON g.conv_id = f.conv_id AND g.i = f.i + 1))
SELECT conv_id, turn, merged_into FROM f WHERE i > 0""")
def folded_merges(spark, sf_dir):
    """Near duplicates of a conversation's turns merged into the last five kept ones."""
    return merging.folded_near_duplicates(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


_SENTENCES = "list_filter(list_transform(regexp_extract_all(text, '[^.!?;\n]+[.!?;]?'), lambda s: trim(s, ' ')), lambda s: s <> '')"


@query(f"""WITH RECURSIVE s AS (SELECT doc_id, {_SENTENCES} AS sentences FROM documents WHERE length(text) > 1600),
  p AS (SELECT doc_id, flatten(list_transform(sentences, lambda s: list_transform(range(0, length(s), 1400), lambda j: {{'text': substring(s, j + 1, 1400), 'size': CASE WHEN length(s) > 1400 THEN 1400 ELSE length(s) END}}))) AS pieces FROM s),
  f AS (SELECT doc_id, pieces, 1 AS i, 1 AS part, pieces[1].size AS size FROM p
    UNION ALL SELECT doc_id, pieces, i + 1, CASE WHEN size + pieces[i + 1].size > 1400 THEN part + 1 ELSE part END, CASE WHEN size + pieces[i + 1].size > 1400 THEN pieces[i + 1].size ELSE size + pieces[i + 1].size END FROM f WHERE i < len(pieces))
SELECT doc_id, (part - 1)::INTEGER AS part, sum(length(pieces[i].text))::INTEGER AS chars, md5(string_agg(pieces[i].text, '' ORDER BY i)) AS text_md5 FROM f GROUP BY doc_id, part""")
def sentence_parts(spark, sf_dir):
    """Oversized documents cut at sentences."""
    rows = table(spark, sf_dir, "documents").where(F.length("text") > 1600)
    parts = chunking.sentence_parts(X.sentences(F.col("text")), F.col("text"))
    return rows.select("doc_id", F.posexplode(parts).alias("part", "text")).select("doc_id", "part", F.length("text").alias("chars"), F.md5("text").alias("text_md5"))


@query(f"""WITH RECURSIVE s AS (SELECT doc_id, {_SENTENCES} AS sentences FROM documents WHERE length(text) > 1600),
  e AS (SELECT doc_id, sentences, list_transform(range(0, len(sentences) + 1), lambda i: coalesce(list_sum(list_transform(sentences[1:i], lambda s: length(s))), 0)::BIGINT) AS ends FROM s),
  f AS (SELECT doc_id, sentences, ends, 0 AS k, -1::BIGINT AS pos, 0::BIGINT AS size, 0::BIGINT AS onward FROM e
    UNION ALL
    SELECT doc_id, sentences, ends, k, pos, size, CASE WHEN pos + size >= len(sentences) THEN len(sentences) ELSE greatest(pos + 1, pos + size - 3) END
    FROM (SELECT doc_id, sentences, ends, k + 1 AS k, onward AS pos, greatest(len(list_filter(ends, lambda x: x > ends[onward + 1] AND x - ends[onward + 1] <= 1400)), 1) AS size FROM f WHERE onward < len(sentences))),
  w AS (SELECT doc_id, k, array_to_string(sentences[pos + 1 : pos + size], '') AS text FROM f WHERE k > 0),
  c AS (SELECT doc_id, k, unnest(CASE WHEN length(text) > 1400 THEN range(0, length(text) - 240, 1160) ELSE [0] END) AS o, text FROM w),
  p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, o) AS part, count(*) OVER (PARTITION BY doc_id) AS n, CASE WHEN length(text) > 1400 THEN substring(text, o + 1, 1400) ELSE text END AS text FROM c),
  j AS (SELECT *, lead(text) OVER (PARTITION BY doc_id ORDER BY part) AS following FROM p),
  t AS (SELECT *, bool_or(part = n - 1 AND length(following) < 600 AND length(text) + length(following) <= 1600) OVER (PARTITION BY doc_id) AS joins FROM j)
SELECT doc_id, (part - 1)::INTEGER AS part, length(x)::INTEGER AS chars, md5(x) AS text_md5 FROM (SELECT *, CASE WHEN joins AND part = n - 1 THEN text || following ELSE text END AS x FROM t) WHERE NOT (joins AND part = n)""")
def sentence_parts_overlap(spark, sf_dir):
    """C4: oversized documents cut at sentences, three of them repeated, a short last part joined to the one before."""
    rows = table(spark, sf_dir, "documents").where(F.length("text") > 1600)
    cut = rows.select("doc_id", "text", X.sentences(F.col("text")).alias("sentences")).select("doc_id", F.transform(F.array(F.struct("sentences", "text")), lambda x: chunking.overlapping_sentence_parts(x["sentences"], x["text"]))[0].alias("parts"))
    return cut.select("doc_id", F.posexplode("parts").alias("part", "text")).select("doc_id", "part", F.length("text").alias("chars"), F.md5("text").alias("text_md5"))


@query(r"""WITH w AS (SELECT 'd' || doc_id AS chunk_id, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS words, list_filter([source, lang], lambda x: x IS NOT NULL) AS keys FROM documents WHERE text IS NOT NULL),
  a AS (SELECT *, array_to_string(words[1:6], ' ') AS title, len(list_distinct(words)) / len(words)::DOUBLE AS score, list_sort(list_transform(string_split(text, chr(10)), lambda s, i: {'n': -length(s), 'i': i, 's': s}))[1].s AS summary FROM w WHERE len(words) > 0)
SELECT 'case-' || chunk_id || '-01-' || left(regexp_replace(regexp_replace(title, '[^0-9A-Za-z一-鿿]+', '-', 'g'), '^-+|-+$', '', 'g'), 24) AS case_id, chunk_id, title, md5(trim(summary, ' ')) AS summary_md5, 'other' AS case_type, score, 0.85::DOUBLE AS source_priority,
  array_to_string(CASE WHEN len(keys) = 2 AND keys[1] = keys[2] THEN keys[1:1] ELSE keys END, ',') AS section_keys FROM a WHERE score >= 0.65""")
def extracted_cases(spark, sf_dir):
    """Prompts, a deterministic stand-in for the model, parsing, acceptance."""
    chunks = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chunk_id"), F.array_distinct(F.array_compact(F.array(F.col("source"), F.col("lang")))).alias("section_keys"), "text")
    chunks = chunks.withColumn("section_texts", extraction.section_texts(F.col("section_keys"), F.col("text")))
    asked = extraction.prompts(chunks, "Extract cases.\n{{payload}}", {"payload": extraction.payload(["chunk_id", "section_keys", "text", "section_texts"])})

    def model(texts: list[str]) -> list[str]:
        import json

        found = json.loads(texts[0].split("\n", 1)[1])
        words, parts = found.get("text", "").split(), found.get("section_texts", {})
        score = len(set(words)) / max(1, len(words))
        told = {"title": " ".join(words[:6]), "summary": max(found.get("text", "").split("\n"), key=len), "score": str(score), "section_keys": [k for k, t in parts.items() if t.split()], "actors": []}
        return ["```json\n" + json.dumps({"cases": [told], "global_notes": []}) + "\n```"]

    told = extraction.answered(asked.select("chunk_id", "section_keys", "prompt"), model)
    return extraction.cases(told).select("case_id", "chunk_id", "title", F.md5("summary").alias("summary_md5"), "case_type", "score", "source_priority", F.array_join("section_keys", ",").alias("section_keys"))


def _answer_branch(name: str, words: str, long: float, short: float, cap: float, weight: float) -> str:
    return rf"""
  {name}_words AS (SELECT doc_id AS item_id, unnest(list_distinct(regexp_extract_all(lower({words}), '[\p{{L}}\p{{N}}_]+'))) AS token FROM d),
  {name}_sums AS (SELECT query_id, item_id, ln(1 + count(*)::DOUBLE) + least({cap}::DOUBLE, sum(CASE WHEN length(token) >= 3 THEN {long}::DOUBLE WHEN length(token) = 2 THEN {short}::DOUBLE ELSE 0 END)) + 0.5::DOUBLE * {weight}::DOUBLE AS total FROM asked JOIN {name}_words USING (token) GROUP BY ALL),
  {name} AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY round(total, 4) DESC, item_id) AS rank FROM {name}_sums QUALIFY rank <= 200)"""


_ANSWERED = rf"""WITH q AS (SELECT item_id AS query_id, lower(text) AS text FROM benchmark),
  r AS (SELECT query_id, text, CASE WHEN {_any(INTENT['out_of_scope'])} AND NOT {_any(INTENT['domain'])} THEN 'out_of_scope' WHEN {_any(INTENT['commentary'])} THEN 'commentary_lookup' WHEN {_any(INTENT['analysis'])} OR {_any(INTENT['first_person'])} THEN 'analysis'
    WHEN {_any(INTENT['lookup'])} THEN 'factual_lookup' WHEN {_any(INTENT['factual'])} AND length(text) <= 36 THEN 'factual_lookup' ELSE 'analysis' END AS intent FROM q),
  asked AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'))) AS token FROM r WHERE intent <> 'out_of_scope'),
  d AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[^.!?;
]+[.!?;]?'), lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM documents),
  {_answer_branch("sparse", "text", 1.15, 0.75, 4.8, 0.3)}, {_answer_branch("dense", "concat_ws(' ', s[1], s[-1])", 1.35, 0.9, 5.0, 0.25)},
  f AS (SELECT query_id, item_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT * FROM sparse UNION ALL SELECT * FROM dense) GROUP BY ALL),
  hits AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM f QUALIFY rank <= 4),
  m AS (SELECT query_id, rank, doc_id, unnest(range(0, least(2, length(text) // 1400 + 1))) AS part FROM hits JOIN d ON doc_id = item_id),
  e AS (SELECT query_id, rank, doc_id || ':' || part AS member, part FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank, part) <= 6),
  shown AS (SELECT query_id, string_agg(member, ',' ORDER BY rank, part) AS evidence FROM e GROUP BY query_id),
  counts AS (SELECT query_id, count(*)::INTEGER AS n_cases FROM hits GROUP BY query_id)
SELECT r.query_id, intent, '向上管理' AS scene, n_cases, coalesce(evidence, '') AS evidence, intent = 'out_of_scope' OR (evidence IS NOT NULL AND n_cases >= 2) AS passed FROM r LEFT JOIN counts USING (query_id) LEFT JOIN shown USING (query_id)"""


@query(_ANSWERED)
def answered_questions(spark, sf_dir):
    """Benchmark texts answered from the documents: whole texts (sparse) and first and last sentences (dense), each by a stored index."""
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lower("text").alias("text"))
    docs = table(spark, sf_dir, "documents")
    cases = docs.select(F.col("doc_id").alias("item_id"))
    members = docs.select(F.col("doc_id").alias("item_id"), F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / 1400).cast("int")), lambda i: F.concat(F.col("doc_id").cast("string"), F.lit(":"), i.cast("string"))).alias("members"))
    ends = F.transform(F.array(X.sentences(X.text_or_empty(F.col("text")))), lambda s: F.concat_ws(" ", F.get(s, F.lit(0)), F.get(s, F.size(s) - 1)))[0]
    dense = postings.index(docs, "doc_id", F.regexp_extract_all(F.lower(ends), F.lit(T.LATIN_TOKEN), F.lit(0)), "first and last sentence")

    def searched(search: DataFrame, k: int) -> dict[str, DataFrame]:
        asked = search.select("query_id", F.col("tokens").alias("terms"))
        of = {"sparse": (document_index(spark, sf_dir), (1.15, 0.75, 4.8, 0.3)), "dense": (dense, (1.35, 0.9, 5.0, 0.25))}
        return {name: postings.overlaps(asked, index, k, long_bonus=long, short_bonus=short, cap=cap, priority_weight=weight)["scored"] for name, (index, (long, short, cap, weight)) in of.items()}

    found = workflow.answered(questions, cases, members, vocabulary=INTENT, searched=searched)
    return found.select("query_id", "intent", "scene", F.size("cases").alias("n_cases"), F.array_join("evidence", ",").alias("evidence"), "passed")
