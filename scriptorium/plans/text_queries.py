"""Registered queries of scalar functions, tags, line kinds and records, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.functions import tokens as T
from scriptorium.operators import audit, case_merging, chunking, extraction, intent, merging, ordering, report, retrieval, sections, tagging
from scriptorium.sources import corpus, files

from . import build
from .catalogue import EVENTS, TOPICS, query, table

FALLBACK = ["der", "los", "the"]


@query("""SELECT item_id, len(g)::INTEGER AS n_grams, md5(array_to_string(list_sort(g), ' ')) AS grams_md5 FROM (SELECT item_id, flatten(list_transform([2, 3], lambda n: list_transform(range(1, length(text) - n + 2), lambda i: substring(text, i, n)))) AS g FROM benchmark)""")
def character_grams(spark, sf_dir):
    """K2: all character 2- and 3-grams of the benchmark texts."""
    grams = table(spark, sf_dir, "benchmark").select("item_id", T.grams_of(F.col("text"), 2, 3).alias("g"))
    return grams.select("item_id", F.size("g").alias("n_grams"), F.md5(F.array_join(F.array_sort("g"), " ")).alias("grams_md5"))


@query(r"""SELECT doc_id, 'doc-' || lpad(doc_id::VARCHAR, 7, '0') AS chunk_id, coalesce(nullif(trim(lang, ' '), ''), nullif(trim(source, ' '), ''), '') AS first_name, coalesce(TRY_CAST(replace(source, 'src', '') AS DOUBLE), 0) AS number, coalesce(TRY_CAST(TRY_CAST(lang AS DOUBLE) AS INTEGER), 0) AS no_number,
  array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(text, ','), lambda x: trim(x, ' ')), lambda x: x <> ''))), '|') AS parts, replace(replace('{{a}} of {{b}}', '{{a}}', coalesce(lang, '')), '{{b}}', coalesce(source, '')) AS filled,
  md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped_md5, md5(lower(regexp_replace(text, '\s+', '', 'g'))) AS compact_md5 FROM (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents)""")
def record_scalars(spark, sf_dir):
    """Ids, first filled values, safe numbers, unique parts, templates, escapes."""
    rows = table(spark, sf_dir, "documents").withColumn("text", X.text_or_empty(F.col("text")))
    return rows.select(
        "doc_id", X.numbered("doc-", F.col("doc_id"), 7).alias("chunk_id"), X.first_filled(F.col("lang"), F.col("source")).alias("first_name"), X.safe_double(F.replace("source", F.lit("src"), F.lit(""))).alias("number"), X.safe_int(F.col("lang")).alias("no_number"),
        F.array_join(F.array_sort(X.unique_filled(F.split("text", ","))), "|").alias("parts"), X.filled_template(F.lit("{{a}} of {{b}}"), {"a": F.col("lang"), "b": F.col("source")}).alias("filled"),
        F.md5(X.html_escaped(F.col("text"))).alias("escaped_md5"), F.md5(X.compact(F.col("text"))).alias("compact_md5"),
    )


@query("""SELECT label, count(*) AS n, round(avg(greatest(0, 1 - d)), 6) AS mean_score FROM (SELECT e.label, e.vec_id, 1 - list_dot_product(list_transform(e.embedding, lambda x: x::DOUBLE), list_transform(f.embedding, lambda x: x::DOUBLE)) AS d
  FROM embeddings e JOIN (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label) f ON f.label = e.label) GROUP BY label""")
def distance_scores(spark, sf_dir):
    """Scores from the distances to the first vector of a label."""
    rows = table(spark, sf_dir, "embeddings")
    first = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))  # one vector a label
    scored = rows.join(first, "label").withColumn("score", T.distance_score(1 - T.dot(F.col("embedding"), F.col("first"))))
    return scored.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


_IN_TEXT = "list_filter([{}], lambda w: contains(text, w))".format


@query(rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), h AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\s+'), lambda w: ends_with(w, 'ment') OR ends_with(w, 'tion'))[1:6] AS hits FROM d),
  u AS (SELECT doc_id, text, list_filter(hits, lambda w, i: list_position(hits, w) = i) || list_filter({_IN_TEXT("'der', 'los', 'the'")}, lambda w: NOT list_contains(hits, w)) AS names FROM h)
SELECT doc_id, array_to_string(names[1:6], ',') AS names, CASE WHEN starts_with(ltrim(text, ' '), 'The') THEN 'commentary' ELSE 'fact' END AS chunk_type,
  array_to_string({_IN_TEXT(", ".join(f"'{w}'" for w in EVENTS))}[1:5], ',') AS events, (len({_IN_TEXT("'the', 'und', 'les'")}) >= 2 OR starts_with(trim(text, ' '), 'In')) AS translated FROM u""")
def chunk_tags(spark, sf_dir):
    """Names by suffix filled up from a list, events, the type by opening, the look of a translation."""
    rows = table(spark, sf_dir, "documents").select("doc_id", X.text_or_empty(F.col("text")).alias("text"))
    words = F.filter(F.split("text", r"\s+"), lambda w: w.endswith("ment") | w.endswith("tion"))
    names = tagging.filled_up(words, F.col("text"), FALLBACK)
    return rows.select(
        "doc_id", F.array_join(names, ",").alias("names"), tagging.chunk_type(F.col("text"), "The").alias("chunk_type"), F.array_join(tagging.present(F.col("text"), EVENTS), ",").alias("events"),
        tagging.translation_like(F.col("text"), ["In"], ["the", "und", "les"]).alias("translated"),
    )


@query(r"""WITH t AS (SELECT conv_id, turn, trim(regexp_replace('[' || (turn * 200) || '] ' || regexp_replace(text, '\. ', '. [' || (turn + 1) || '] ', 'g'), '\s+', ' ', 'g'), ' ') AS text FROM conversations WHERE text IS NOT NULL),
  p AS (SELECT conv_id, turn, unnest(list_filter(list_transform(string_split_regex(regexp_replace(text, '(.)(\[\d+\])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '')) AS piece FROM t),
  n AS (SELECT conv_id, TRY_CAST(nullif(regexp_extract(piece, '^\[(\d+)\]', 1), '') AS INTEGER) AS n, piece FROM p)
SELECT conv_id, count(*) AS pieces, count_if(n BETWEEN 1 AND 999) AS numbered, coalesce(sum(n) FILTER (n BETWEEN 1 AND 999), 0)::BIGINT AS numbers, sum(length(CASE WHEN n BETWEEN 1 AND 999 THEN trim(regexp_replace(piece, '^\[\d+\]\s*', ''), ' ') ELSE piece END))::BIGINT AS chars FROM n GROUP BY conv_id""")
def numbered_pieces(spark, sf_dir):
    """Turns with [n] marks cut at the marks, numbers from 1 to 999 taken off."""
    marked = F.concat(F.lit("["), (F.col("turn") * 200).cast("string"), F.lit("] "), F.regexp_replace("text", r"\. ", F.concat(F.lit(". ["), (F.col("turn") + 1).cast("string"), F.lit("] "))))
    turns = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", F.explode(sections.split_numbered(X.normalized(marked))).alias("piece")).withColumn("nb", sections.number_and_body(F.col("piece")))
    return turns.groupBy("conv_id").agg(F.count("*").alias("pieces"), F.count("nb.number").alias("numbered"), F.coalesce(F.sum("nb.number"), F.lit(0)).alias("numbers"), F.sum(F.length("nb.body")).alias("chars"))


@query("""WITH d AS (SELECT doc_id, lang, source, n_chars, ceil(doc_id / 4.0)::BIGINT AS bucket FROM documents), l AS (SELECT source AS section, max(doc_id) AS ordinal FROM documents WHERE source IS NOT NULL GROUP BY source)
SELECT d.doc_id, l.ordinal, row_number() OVER (PARTITION BY lang ORDER BY coalesce(l.ordinal, 1000000000), bucket, coalesce(source, ''), -n_chars, doc_id)::INTEGER AS place FROM d LEFT JOIN l ON l.section = d.source""")
def case_order(spark, sf_dir):
    """Documents of a language in catalogue order; the last document that holds a section (here its source) places it."""
    docs = table(spark, sf_dir, "documents")
    _, placed = merging.catalog(docs.select("doc_id", F.array("source").alias("keys"), F.col("doc_id").alias("ordinal")).where("keys[0] is not null"), "doc_id", "keys", "ordinal")
    rows = docs.join(placed.select(F.col("section").alias("source"), "ordinal"), "source", "left")
    key = case_merging.sort_key(F.col("ordinal"), F.ceil(F.col("doc_id") / 4), F.col("source"), F.col("n_chars"))
    return rows.select("doc_id", "ordinal", F.row_number().over(Window.partitionBy("lang").orderBy(*key, "doc_id")).alias("place"))


_NORM = r"lower(regexp_replace(coalesce({0}, ''), '[^\p{{L}}\p{{N}}_]', '', 'g'))".format


@query(f"SELECT doc_id, md5(trim(array_to_string([{_NORM('source')}, {_NORM('lang')}, {_NORM('text')}], ' '), ' ')) AS told_md5, md5(CASE WHEN coalesce(text, '') = '' OR length(coalesce(source, '')) > length(coalesce(text, '')) + 20 THEN coalesce(source, '') ELSE text END) AS better_md5 FROM documents")
def compare_texts(spark, sf_dir):
    """The text by which cases are compared, and the better of two texts."""
    text, source = X.text_or_empty(F.col("text")), X.text_or_empty(F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(case_merging.compare_text(F.col("source"), F.col("lang"), F.col("text"))).alias("told_md5"), F.md5(case_merging.better_text(text, source)).alias("better_md5"))


@query(r"""WITH k AS (SELECT doc_id, lang, doc_id // 4 AS section, lower(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}_]', '', 'g')) AS norm FROM documents),
  g AS (SELECT doc_id, lang, section, CASE WHEN length(norm) = 0 THEN [] WHEN length(norm) <= 2 THEN [norm] ELSE list_distinct(list_transform(range(1, length(norm)), lambda i: ch[i] || ch[i + 1])) END AS grams FROM (SELECT *, string_split(norm, '') AS ch FROM k)),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.section = b.section AS overlap, len(list_intersect(a.grams, b.grams)) AS c, len(a.grams) AS x, len(b.grams) AS y FROM g a JOIN g b ON b.doc_id > a.doc_id AND b.doc_id <= a.doc_id + 3 AND a.lang IS NOT DISTINCT FROM b.lang WHERE a.section = b.section OR b.doc_id = a.doc_id + 1)
SELECT a, b, overlap, round(c::DOUBLE / (x + y - c), 6) AS similarity FROM p WHERE x > 0 AND y > 0 AND (c::DOUBLE / (x + y - c) >= 0.82 OR (overlap AND c::DOUBLE / (x + y - c) >= 0.72))""")
def merge_candidates(spark, sf_dir):
    """Documents that may merge: one language, neighbours or of one section (four documents), with either threshold."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.floor(F.col("doc_id") / 4).alias("section"), T.bigrams(X.comparable(F.col("text"))).alias("grams"))
    return merging.merge_pairs(rows, "doc_id", "section", "grams", ["lang"], reach=3)


@query("""SELECT doc_id, CASE WHEN m.quality = 1 THEN 'good' WHEN l.doc_id IS NULL THEN intent ELSE intent END AS intent, CASE WHEN m.quality IS NULL THEN 'rule' WHEN m.quality = 1 THEN 'llm' ELSE 'rule_fallback' END AS decided_by
FROM (SELECT doc_id, CASE WHEN contains(text, 'the') THEN 'analysis' ELSE 'factual_lookup' END AS intent FROM documents) l LEFT JOIN labels m USING (doc_id)""")
def resolved_intents(spark, sf_dir):
    """The intent of a model where it is sure, else that of the rules, with who decided."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.contains("text", F.lit("the")), "analysis").otherwise("factual_lookup").alias("rule"))
    told = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality").isNotNull(), "good").alias("model"), F.col("quality").cast("double").alias("confidence"))
    decided = intent.resolved_intent(F.col("rule"), F.col("model"), F.col("confidence"))
    return docs.join(told, "doc_id", "left").select("doc_id", decided.alias("d")).select("doc_id", "d.intent", "d.decided_by")


@query("""WITH r AS (SELECT doc_id, source, length(coalesce(text, '')) AS n FROM documents), s AS (SELECT source, sum(n)::BIGINT AS chars FROM r GROUP BY source),
  t AS (SELECT *, row_number() OVER (ORDER BY chars, source) AS low, row_number() OVER (ORDER BY chars DESC, source) AS high FROM s)
SELECT 'all' AS part, NULL AS source, count(*) AS n, min(chars) AS least, max(chars) AS most, round(avg(chars), 1) AS mean, round(median(chars), 1) AS median, sum(chars)::BIGINT AS total FROM s
UNION ALL SELECT 'smallest', source, 1, chars, chars, chars, chars, chars FROM t WHERE low <= 5 UNION ALL SELECT 'largest', source, 1, chars, chars, chars, chars, chars FROM t WHERE high <= 5""")
def corpus_summary(spark, sf_dir):
    """A4: totals of the sources' sizes, and the five smallest and largest ones."""
    sizes = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.length(X.text_or_empty(F.col("text")))).alias("chars"))
    return audit.corpus_summary(sizes, "source", "chars", 5)


@query("""SELECT event_type AS name, count(*) AS n, round(avg(value), 3) AS mean_s, round(median(value), 3) AS median_s, round(min(value), 3) AS min_s, round(max(value), 3) AS max_s FROM events GROUP BY event_type""")
def latency_stats(spark, sf_dir):
    """Statistics of measured times, by what was measured."""
    return audit.latency_stats(table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("value").alias("seconds")), "name", "seconds")


@query("""SELECT source, string_agg(k, ',' ORDER BY k) AS kinds FROM (SELECT source, coalesce(lang, 'none') || ':' || count(*) AS k FROM documents GROUP BY source, coalesce(lang, 'none')) GROUP BY source""")
def pair_histograms(spark, sf_dir):
    """Counts of kinds as one text for each source."""
    kinds = table(spark, sf_dir, "documents").groupBy("source", F.coalesce("lang", F.lit("none")).alias("lang")).agg(F.count("*").alias("n"))
    return kinds.groupBy("source").agg(chunking.counted_text(F.col("lang"), F.col("n")).alias("kinds"))


@query("""SELECT doc_id, sum(length(coalesce(text, ''))) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS chars_so_far, 'chunk-' || lpad(row_number() OVER (ORDER BY doc_id)::VARCHAR, 7, '0') AS chunk_id FROM documents""")
def corpus_numbers(spark, sf_dir):
    """Numbers and totals that run through the whole corpus in order, without one task that sees it all."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.length(X.text_or_empty(F.col("text"))).alias("n"))
    rows = ordering.running_total(ordering.running_total(rows, "doc_id", [], F.col("n"), "chars_so_far"), "doc_id", [], F.lit(1), "number")
    return rows.select("doc_id", "chars_so_far", X.numbered("chunk-", F.col("number"), 7).alias("chunk_id"))


@query("""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[^.!?;\\n]+[.!?;]?'), lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM documents),
  h AS (SELECT doc_id, s, list_filter(['stupid', 'tion', 'keit', 'the'], lambda t: len(list_filter(s, lambda x: contains(x, t))) > 0)[1] AS term FROM s), p AS (SELECT *, list_position(list_transform(s, lambda x: contains(x, term)), true) AS pos FROM h)
SELECT doc_id, md5(CASE WHEN term IS NULL THEN coalesce(s[1], '') ELSE array_to_string(s[greatest(pos - 1, 1) : pos + 1], ' ') END) AS excerpt_md5 FROM p""".replace("\\\\", "\\"))
def lookup_excerpts(spark, sf_dir):
    """The sentence with the first term that occurs, and its neighbours."""
    rows = table(spark, sf_dir, "documents").select("doc_id", X.sentences(F.col("text")).alias("s"))
    terms = F.array(*[F.lit(t) for t in ("stupid", "tion", "keit", "the")])
    return rows.select("doc_id", F.md5(F.coalesce(retrieval.excerpt(F.col("s"), terms), F.lit(""))).alias("excerpt_md5"))


@query("""WITH p AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations), f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM p)
SELECT conv_id, turn, role, text, round(least(0.95, 0.45 + turn / 3.0::DOUBLE), 6) AS confidence FROM f WHERE n = 1""")
def first_views(spark, sf_dir):
    """The first turn of each role of a conversation, with the confidence of its rank."""
    rows = table(spark, sf_dir, "conversations").withColumns({"text": X.text_or_empty(F.col("text")), "score": F.col("turn").cast("double")})
    return report.mirrors(merging.first_of(rows, ["conv_id", "role"], ["turn"])).select("conv_id", "turn", "role", "text", "confidence")


@query("""SELECT doc_id, title_topic, flag FROM (SELECT doc_id, CASE WHEN contains(text, 'the') OR contains(text, 'les') THEN 'power' WHEN contains(text, 'und') OR contains(text, 'der') THEN 'alliance' ELSE '' END AS title_topic, quality = 1 AS flag, source FROM documents JOIN labels USING (doc_id)) WHERE flag IS NOT NULL AND trim(coalesce(source, '')) <> '' AND doc_id >= 10""")
def accepted_records(spark, sf_dir):
    """Records with known values and filled fields, from an ordinal on."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = files.selected_rows(files.valid(rows.withColumn("q", F.col("quality").cast("string")), {"q": ["0", "1"]}, ["source"]), "doc_id", 10)
    topic = F.coalesce(F.get(tagging.groups(F.col("text"), {k: TOPICS[k] for k in ("power", "alliance")}), F.lit(0)), F.lit(""))
    return rows.select("doc_id", topic.alias("title_topic"), (F.col("quality") == 1).alias("flag"))


@query("""SELECT 'facts' AS kind, count(*) AS n, round(sum(priority), 4) AS priority, md5(string_agg(md5(t), '' ORDER BY doc_id)) AS texts FROM (SELECT doc_id, 0.88 AS priority, array_to_string(list_filter([trim(coalesce(source, ''), ' '), trim(coalesce(lang, ''), ' '), trim(coalesce(text, ''), ' ')], lambda x: x <> ''), chr(10)) AS t FROM documents)
UNION ALL SELECT 'comments', count(*), round(sum(0.86), 4), md5(string_agg(md5(text), '' ORDER BY doc_id)) FROM documents WHERE text IS NOT NULL""")
def chunk_records(spark, sf_dir):
    """Tagging rows and commentary rows in the form of retrieval chunks."""
    docs = table(spark, sf_dir, "documents")
    named = docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("chapter_title"), F.col("lang").alias("year_title"), F.col("text").alias("white_text"))
    comments = docs.where("text is not null").select(F.col("doc_id").alias("commentary_id"), F.col("text").alias("commentary_text"))

    def told(rows, kind):
        chained = F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", F.md5("retrieval_text").alias("m")))), lambda x: x["m"]), ""))
        return rows.agg(F.count("*").alias("n"), F.round(F.sum("source_priority"), 4).alias("priority"), chained.alias("texts")).select(F.lit(kind).alias("kind"), "n", "priority", "texts")

    return told(files.tagging_chunks(named), "facts").unionByName(told(files.commentary_chunks(comments), "comments"))


@query("""SELECT doc_id, array_to_string(list_transform(list_sort(list_distinct(string_split(coalesce(source, '') || ',' || coalesce(lang, ''), ','))), lambda x: x), ',') AS keys FROM documents""")
def sorted_keys(spark, sf_dir):
    """Keys of a record in catalogue order (none of them known here, so by name)."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.split(F.concat_ws(",", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))), ",").alias("keys"))
    none = rows.sparkSession.createDataFrame([], "key string, ordinal int")
    return corpus.sorted_by_catalog(rows, "doc_id", "keys", none, "key", ["ordinal"]).select("doc_id", F.array_join("keys", ",").alias("keys"))


def _windows(size: int) -> str:
    return f"""w{size} AS (SELECT conv_id, i, n::BIGINT AS size, 1 AS pack FROM t WHERE i = 1
    UNION ALL SELECT t.conv_id, t.i, CASE WHEN f.size + t.n > {size} THEN t.n ELSE f.size + t.n END, CASE WHEN f.size + t.n > {size} THEN f.pack + 1 ELSE f.pack END FROM w{size} f JOIN t ON t.conv_id = f.conv_id AND t.i = f.i + 1)"""


@query(f"""WITH RECURSIVE t AS (SELECT conv_id, length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations), {_windows(1000)}, {_windows(2000)}
SELECT conv_id, 'w1000' AS mode, pack::INTEGER AS "window", min(i)::INTEGER AS first, max(i)::INTEGER AS last, max(size)::INTEGER AS chars FROM w1000 GROUP BY conv_id, pack
UNION ALL SELECT conv_id, 'w2000', pack::INTEGER, min(i)::INTEGER, max(i)::INTEGER, max(size)::INTEGER FROM w2000 GROUP BY conv_id, pack
UNION ALL SELECT conv_id, 'whole', 1, 1, count(*)::INTEGER, sum(n)::INTEGER FROM t GROUP BY conv_id""")
def window_experiment(spark, sf_dir):
    """Windows of two sizes and over whole conversations, in one table."""
    return build.window_experiment(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", [1000, 2000])


@query("""WITH d AS (SELECT source, doc_id, lang, coalesce(text, '') AS text, row_number() OVER w = 1 OR lang IS DISTINCT FROM lag(lang) OVER w AS changed FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
  l AS (SELECT source, doc_id, CASE WHEN changed AND coalesce(lang, '') <> '' THEN ['# ' || lang, text] ELSE [text] END AS lines FROM d)
SELECT source, doc_id, (generate_subscripts(lines, 1) - 1)::INTEGER AS place, md5(unnest(lines)) AS line_md5 FROM l""")
def changed_headings(spark, sf_dir):
    """An export of the documents of a source in which the language stands only where it changes."""
    rows = table(spark, sf_dir, "documents").withColumn("text", X.text_or_empty(F.col("text")))
    return files.with_changed_headings(rows, "source", "doc_id", ["lang"], "text").select("source", "doc_id", "place", F.md5("line").alias("line_md5"))


@query("""WITH d AS (SELECT length(text) % 4 AS k FROM documents WHERE text IS NOT NULL)
SELECT CASE WHEN k = 3 THEN 'JSONDecodeError' ELSE 'ok' END AS status, CASE WHEN k = 3 THEN 3 ELSE k + 1 END::INTEGER AS tries, count(*) AS chunks FROM d GROUP BY ALL""")
def extraction_retries(spark, sf_dir):
    """A model that fails by turns (a call that raises, an answer that does not parse, or none ever), asked by several threads a task, failed rows alone again."""
    chunks = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("\n"), F.col("text")).alias("prompt"))
    times: dict[str, int] = {}

    def model(texts: list[str]) -> list[str]:
        text = texts[0].split("\n", 1)[1]
        k = times[texts[0]] = times.get(texts[0], -1) + 1
        if len(text) % 4 == 3 or k < len(text) % 4 - 1:
            return ["{no object"]
        if k < len(text) % 4:
            raise TimeoutError("no answer")
        return ['{"cases": []}']

    told = extraction.answered_together(chunks, model)
    return told.groupBy(F.coalesce("error_type", F.lit("ok")).alias("status"), "tries").agg(F.count("*").alias("chunks"))
