"""Corpus pipeline: documents through five of the training-data operators, a written table after each stage.

1. language_id: documents whose language cannot be told (no text, or no letter in it) go; all others stay.
2. near_dedup: of each group of near duplicates (5-word shingles, similarity 0.8) the document with the smallest id stays.
3. pii: personal data in the texts is replaced by format-preserving pseudonyms.
4. mix: sources are mixed to target weights 1, 2, 3, ...; a document occurs as often as the mix takes it.
5. pack: the mix in token sequences of 2048 ids.

Each stage works on all that its predecessor kept and, but for the last, returns the columns of documents.

Edge cases. Null and empty texts go in the first stage, as do texts without a letter. Without any language label that can be learned, all texts
with a letter stay. Null ids, sources and languages stay; equal ids with different texts are different documents, equal rows one group of near duplicates. Ties
among near duplicates go to the smallest id. Very long texts stay whole. Empty table: no rows. Columns other than those of documents are dropped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import language, mixing, near_dedup, packing, pii
from scriptorium.llm.common import durable, shared_folder, table
from scriptorium.llm.queries import DEMONSTRATION_KEY, tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: The stages include classification and tokenization, which SQL cannot express; the tests hold them against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in which a language is found. Where no row names a language that could be learned, all that have a letter stay."""
    model = language.train(docs)
    told = language.with_language(docs, model, name="__language")
    found = F.col("__language.prediction") != "und"
    return told.where(found if model.languages else found | language.has_letter(F.col("text"))).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates. A row is known by its id and its text, so rows that share an id are told apart."""
    key = ["doc_id", "__digest"]
    found = near_dedup.near_duplicates(docs, k=5, percent=80).select(F.col("id").alias("doc_id"), F.col("digest").alias("__digest"), "chosen")
    marked = durable(found.groupBy(*key).agg(F.max("chosen").alias("__stays"), F.count("*").alias("__n")).where("doc_id is not null and (not __stays or __n > 1)"))
    of_text = docs.withColumn("__digest", F.xxhash64("text"))
    gone, twice = marked.where("not __stays").select(*key), marked.where("__stays").select(*key)
    slim = lambda rows: F.broadcast(rows) if rows.count() <= near_dedup.BROADCAST_IDS else rows
    stay = of_text.join(slim(gone), key, "left_anti")
    if not twice.isEmpty():  # repeated rows
        twice = slim(twice)
        stay = stay.join(twice, key, "left_anti").union(stay.join(twice, key, "left_semi").dropDuplicates(key))
    return stay.select(*COLUMNS)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data."""
    return pii.pseudonymized(docs, DEMONSTRATION_KEY).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources meet their targets."""
    keyed = mixing.keyed(docs)
    decided = mixing.decisions(durable(keyed.select("source", "size", "key", "tie")))
    taken = mixing.with_copies(keyed, decided).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences, with their ids."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.tiktoken"), end_id=1, length=2048)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup_stage), ("pii", pseudonyms), ("mix", mix), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
