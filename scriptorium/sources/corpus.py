"""Where a corpus comes from, and whether an index over it is still current."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import chunking

#: The columns of a retrieval chunk.
CHUNK = (
    "chunk_id string, volume_no int, volume_title string, chapter_title string, year string, chunk_type string, retrieval_text string, section_keys array<string>, "
    "topic_tags array<string>, situation_tags array<string>, source_priority double"
)


def resolved(candidates: list[str | None], exists: Callable[[str], bool]) -> str | None:
    """The first candidate that is given and exists; a name ending in .json also stands for .jsonl, and the other way round."""
    for path in candidates:
        if not path:
            continue
        for name in [path] + [path[: -len(a)] + b for a, b in ((".jsonl", ".json"), (".json", ".jsonl")) if path.endswith(a)]:
            if exists(name):
                return name
    return None


def load(spark: SparkSession, path: str | None, cache: str | None, seed: DataFrame, variable: str = "CORPUS_PATH", schema: str = CHUNK, exists: Callable[[str], bool] = os.path.exists) -> DataFrame:
    """The corpus named by the environment, the argument or the cache, in this order; the seed rows if none exists. Rows that do not fit
    the schema raise, but for the cache, which then gives way to the seed."""
    given = resolved([os.environ.get(variable), path], exists)
    if given:
        return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", str(given.endswith(".json")).lower()).json(given)
    kept = resolved([cache], exists)
    if kept:
        rows = spark.read.schema(schema + ", _bad string").option("columnNameOfCorruptRecord", "_bad").option("multiLine", str(kept.endswith(".json")).lower()).json(kept).cache()
        if rows.where("_bad is not null").isEmpty():
            return rows.drop("_bad")
    return seed


def assembled(sections: DataFrame, packs: DataFrame, keys: list[str], order: str, version: str, priority: float = 0.9) -> DataFrame:
    """Chunks from sections (keys, order, section_key, text, year, pair_type) and packs (keys, pack, first, last: places from 1).

    Texts are joined by line breaks, years are merged, pair types are counted as text.
    """
    lists = chunking.ordered_list(sections, keys, order, "section_key", "text", "year", "pair_type")
    part = F.slice("pieces", F.col("first"), F.col("last") - F.col("first") + 1)
    rows = packs.join(lists, keys).withColumn("p", part)
    get = lambda name: F.transform("p", lambda x: x[name])
    return rows.select(
        *keys, F.concat(F.concat_ws("-", *[F.col(k).cast("string") for k in keys]), F.lit("-c"), F.lpad(F.col("pack").cast("string"), 5, "0")).alias("chunk_id"), F.array_join(get("text"), "\n").alias("text"),
        get("section_key").alias("section_keys"), chunking.merged_titles(get("year")).alias("year"), chunking.histogram_text(get("pair_type")).alias("pair_types"), F.size("p").alias("sections"),
        F.aggregate(get("text"), F.lit(0), lambda a, t: a + F.length(t)).alias("chars"), F.lit(priority).alias("source_priority"), F.lit(version).alias("chunk_version"),
    )


def sorted_by_catalog(rows: DataFrame, id_col: str, array: str, catalog: DataFrame, name: str, ordinals: list[str], unknown: int = 10**9) -> DataFrame:
    """rows with the distinct values of an array column in catalog order, unknown ones last and by name."""
    flat = rows.select(id_col, F.explode(F.array_distinct(array)).alias(name)).join(catalog, name, "left")
    place = [F.coalesce(F.col(o), F.lit(unknown)).alias(o) for o in ordinals]
    back = flat.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(*place, F.col(name)))).alias("__s")).select(id_col, F.transform("__s", lambda x: x[name]).alias(array))
    return rows.drop(array).join(back, id_col, "left").withColumn(array, F.coalesce(array, F.array().cast("array<string>")))


def status(corpus: DataFrame, index_meta: DataFrame, now: DataFrame) -> DataFrame:
    """One row: corpus size, and whether the index metadata (n, signature) still describe it. now: a fresh row of the same form."""
    same = index_meta.select(F.col("n").alias("index_n"), F.col("signature").alias("index_signature"))
    size = corpus.agg(F.count("*").alias("rows"))
    current: Column = (F.col("n") == F.col("index_n")) & (F.col("signature") == F.col("index_signature"))
    return size.crossJoin(now).crossJoin(same).select("rows", F.when(current, "dense and sparse").otherwise("sparse only").alias("mode"))
