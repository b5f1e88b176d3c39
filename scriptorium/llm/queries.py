"""Registered queries of this subpackage: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, conversations, fingerprints, language, licenses, pii, toxicity, url_rules, warc
from .common import durable, table
from .language import held_out
from .mixing import decisions, keyed, with_copies
from .near_dedup import near_duplicates
from .packing import pack
from .topk import exact_top_k

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op9_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components over 2-word shingles at similarity 0.8."""
    found = near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


ORACLE_SQL["op9_minmax_near_dedup"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS node, doc_id AS root FROM documents
  UNION
  SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.node WHERE r.root < e.b)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, r.root AS component_id, d.doc_id = r.root AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT node, min(root) AS root FROM reach GROUP BY node) r ON r.node = d.doc_id
"""


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary file is, on any machine of the cluster that has the tokenizer package."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op4_concat_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 byte-level ids, each document ended by id 1."""
    pieces = pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), end_id=1, length=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source with weights 1, 2, 3, ..., at most three epochs."""
    slim = durable(keyed(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "key", "tie"))
    mixed = with_copies(slim, decisions(slim, (1, 2, 3), 3))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE_SQL["op2_source_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    length(regexp_replace(coalesce(text, ''), '[#$%&*|<>{}=~^_]+', '', 'g')) / greatest(length(coalesce(text, '')), 1)::DOUBLE AS clean,
    ('0x' || substr(md5(concat_ws('|', '11', doc_id, md5(coalesce(text, '')))), 1, 13))::BIGINT AS h
  FROM documents),
k AS (SELECT doc_id, source, size, -ln((h + 1) / 4503599627370496.0::DOUBLE) / (0.25::DOUBLE + 0.75::DOUBLE * clean * clean) AS key FROM d),
s AS (SELECT source, sum(size)::DOUBLE AS source_size FROM k GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, sum(source_size) OVER () AS total FROM s),
o AS (SELECT *, 3 * source_size AS cap,
    (total - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (SELECT source, source_size, least(cap, weight * (SELECT level FROM o WHERE level <= cap / weight ORDER BY cap / weight, source NULLS LAST LIMIT 1)) AS target FROM o),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS epochs FROM t),
p AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS UNBOUNDED PRECEDING) - k.size / 2.0::DOUBLE AS middle
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target,
  (size * (epochs + CASE WHEN middle <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p
"""


@query
def op6_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = language.with_language(docs.select("doc_id", "text"), language.train(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), F.col("language.prediction").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.languages").alias("languages"), F.col("language.shares").alias("shares"))


@query
def op5_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labelled documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.with_toxicity(docs.select("doc_id", "text"), toxicity.train(docs, table(spark, sf_dir, "labels")), name="score")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score").withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query
def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    found = fingerprints.fingerprinted(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("grams")).alias("fingerprint"), fingerprints.as_text(F.col("edited_grams")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("grams"), F.col("edited_grams")).alias("near_edited"), fingerprints.likeness(F.col("grams"), F.col("next.grams")).alias("near_next"),
    )


#: Key of the registered query. Deployments pass their own, from a secret store.
DEMONSTRATION_KEY = b"demonstration key of the queries"


@query
def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their personal data replaced by pseudonyms."""
    found = pii.pseudonymized(table(spark, sf_dir, "documents"), DEMONSTRATION_KEY)
    return found.select("doc_id", "text", F.size("pii_kinds").alias("n_replaced"), "pii_kinds")


@query
def op3_norm_bucketed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products of every 50th vector with all others."""
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5, scale=256)


ORACLE_SQL["op3_norm_bucketed_topk"] = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.n <> c.n),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op8_warc_index_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back from the archives."""
    index = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_records(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL["op8_warc_index_first"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
  CASE WHEN f.first < d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first < d.page_id THEN f.first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""


@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families of the paragraphs of all documents."""
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.train(docs))


#: The rules of the registered query.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query
def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the rules; a url that no rule fits is allowed."""
    return url_rules.judged(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


ORACLE_SQL["op11_url_rules"] = """
WITH rules(h, p, v) AS (VALUES """ + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES) + r"""),
u AS (SELECT page_id, row_number() OVER () AS n, CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
w AS (SELECT page_id, n, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
x AS (SELECT page_id, n, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substring(rest, length(raw) + 1), '^[^?#]*') AS path FROM w),
f AS (SELECT x.*, h || p AS rule, v, row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC, length(h) DESC, v DESC) AS place
  FROM x LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM f WHERE place = 1
"""


@query
def op13_pair_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents aligned between the byte-level and the piece tokenizer, with corpus-wide counts of the linked ids."""
    return alignment.alignment(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), tokenizer_file("piece_bpe_32k.model"))


def damaged(turns: DataFrame) -> DataFrame:
    """Turns of conversations damaged by crc32(conv_id:turn) % 20; dropped turns are kept as not present."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    body = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    rows = turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(text("role")).alias("role"), body.alias("text"), (kind != 0).alias("present"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("times", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("times")


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, its turns damaged, with the cheapest repair."""
    return conversations.repaired(damaged(table(spark, sf_dir, "conversations")), present=F.col("present"))[1]


def _least(*ways: str) -> str:
    return f"list_min(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))"


def _way(state: int, cost: str, letter: str, said: str, source: str = "v") -> str:
    return f"CASE WHEN {source}[{state + 1}] IS NOT NULL THEN {{'c': {source}[{state + 1}].c + {cost}, 'a': {source}[{state + 1}].a || '{letter}', 't': {said.format(f'{source}[{state + 1}].t')}}} END"


def _with_insert(source: str) -> str:
    """The states of `source`, or one insert later."""
    user = [_way(s, "2", "I", "list_append({}, 'user:')", source) for s in (0, 1, 3)]
    assistant = _way(2, "2", "I", "list_append({}, 'assistant:')", source)
    return f"[{source}[1], {source}[2], {_least(f'{source}[3]', *user)}, {_least(f'{source}[4]', assistant)}]"


def _row_taken() -> str:
    """The states after one more turn."""
    same = "{}"
    keep, user, assistant = "list_append({}, role || ':' || text)", "list_append({}, 'user:' || text)", "list_append({}, 'assistant:' || text)"
    kept = lambda state, initial: f"CASE WHEN NOT forced AND left(role, 1) = '{initial}' THEN {_way(state, 'more', 'K', keep)} END"
    put = lambda state, said: f"CASE WHEN NOT forced THEN {_way(state, '2 + more', 'R', said)} END"
    gone = [_way(s, "3", "D", same) for s in range(4)]
    return (
        f"[{gone[0]}, {_least(gone[1], kept(0, 's'))}, {_least(gone[2], *[kept(s, 'u') for s in (0, 1, 3)], *[put(s, user) for s in (0, 1, 3)])}, "
        f"{_least(gone[3], kept(2, 'a'), put(2, assistant))}]"
    )


_NO_STATE = "NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR[])"
ORACLE_SQL["op12_conversation_repair"] = f"""
WITH RECURSIVE o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, row_number() OVER () AS n FROM conversations),
tables AS (SELECT list_transform(range(256), lambda i: list_reduce(range(9), lambda c, k: CASE WHEN k = 0 THEN c WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT)) AS t),
k AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM o),
h AS (SELECT conv_id, turn, role, text, n, xor(list_reduce(list_transform(string_split(s, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS kind FROM k, tables),
d AS (SELECT conv_id, turn, n, copy, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE kind WHEN 0 THEN []::INTEGER[] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM h)),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, n, copy) AS i FROM d),
g AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS again, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM r),
f AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM g),
s AS (SELECT *, fault IN ('blank', 'duplicate') AS forced, (fault = 'truncated')::BIGINT AS more FROM f),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, [{{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}}, {_NO_STATE}, {_NO_STATE}, {_NO_STATE}] AS v FROM o GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, {_row_taken()} FROM (
    SELECT conv_id, i, role, text, forced, more, {_with_insert("w")} AS v FROM (
      SELECT s.conv_id, s.i, s.role, s.text, s.forced, s.more, {_with_insert("walk.v")} AS w FROM walk JOIN s ON s.conv_id IS NOT DISTINCT FROM walk.conv_id AND s.i = walk.i + 1))),
ends AS (SELECT conv_id, {_with_insert("w")} AS v FROM (SELECT conv_id, {_with_insert("walk.v")} AS w FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)),
best AS (SELECT conv_id, {_least("v[1]", "v[4]")} AS x FROM ends),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM s GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, x.c::BIGINT AS cost, x.a AS audit, sha256(array_to_string(x.t, chr(10))) AS repaired_sha256
FROM best b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id
"""
