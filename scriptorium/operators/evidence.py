"""What follows a first search: neighbouring hits joined, repeated chapters held back, bundles over linked chunks, a second ranking by features, perspectives.

Hits are the few best items of each question (query, item, score, ...), so windows by question are short. Corpus tables (sections of chunks,
texts) are joined by key and never collected.

Nulls: a hit with a null chapter belongs to the chapter of nulls; a null ordinal is adjacent to nothing; a null section links nothing; a feature that is null is 0; a text that is null has no perspective.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.sources.store import durable

from .patterns import contained
from .retrieval import small_side

UNKNOWN = "unknown"


def spans(hits: DataFrame, chapter: str, ordinal: str, score: str = "score", gap: int = 1, query: str = "query_id") -> DataFrame:
    """query, chapter, first, last, hits, best and total: hits of one chapter that are at most `gap` apart, as one span."""
    order = Window.partitionBy(query, chapter).orderBy(F.col(ordinal).asc_nulls_first())
    new = F.coalesce(F.col(ordinal) - F.lag(ordinal).over(order) > gap, F.lit(True)).cast("int")
    numbered = hits.withColumn("__new", new).withColumn("__span", F.sum("__new").over(order))
    found = numbered.groupBy(query, chapter, "__span").agg(F.min(ordinal).alias("first"), F.max(ordinal).alias("last"), F.count("*").alias("hits"), F.max(score).alias("best"), F.sum(score).alias("total"))
    return found.drop("__span")


def diverse(rows: DataFrame, chapter: str, score: str, tie: str, k: int, fade: float = 0.8, query: str = "query_id", digits: int = 4) -> DataFrame:
    """rows with `faded` and rank, the k best of each question: each further row of a chapter counts `fade` times as much as the one before.

    That is what a greedy choice with fading chapters takes: within a chapter rows come by falling score, so the n-th has been faded n - 1 times when its turn comes.
    """
    turn = F.row_number().over(Window.partitionBy(query, chapter).orderBy(F.desc(score), tie))
    faded = rows.withColumn("faded", F.round(F.col(score) * F.pow(F.lit(fade), turn - 1), digits))
    return faded.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("faded"), tie))).where(F.col("rank") <= k)


def bundled(seeds: DataFrame, sections: DataFrame, hops: int = 2, hub: int = 50, query: str = "query_id", chunk: str = "chunk_id", section: str = "section") -> DataFrame:
    """query, chunk, hop: the chunks that are within `hops` steps of a question's seeds, a step leading from a chunk through one of its sections to the chunks of that section.

    sections: chunk, section, once each. Sections of more than `hub` chunks lead nowhere: they hold together what has nothing in common, and a step
    through them would cost the square of their size. Each hop works on what the last one added and is written to the shared folder.
    """
    linked = sections.where(F.col(section).isNotNull() & F.col(chunk).isNotNull())
    open_ = linked.groupBy(section).agg(F.count("*").alias("__n")).where(F.col("__n") <= hub).select(section)
    doors = durable(linked.join(open_, section).select(chunk, section))
    reached = durable(seeds.select(query, chunk).distinct().withColumn("hop", F.lit(0)))
    new = reached
    for hop in range(1, hops + 1):
        through = small_side(durable(new.join(doors, chunk).select(query, section).distinct()))
        near = doors.join(through, section).select(query, chunk).distinct()
        new = durable(near.join(reached, [query, chunk], "left_anti").withColumn("hop", F.lit(hop)))
        if new.isEmpty():
            break
        reached = durable(reached.unionByName(new))
    return reached


def bundles(reached: DataFrame, sections: DataFrame, query: str = "query_id", chunk: str = "chunk_id", section: str = "section") -> DataFrame:
    """One row a question: seeds, expanded (chunks by hop and id) and sections of all its chunks, hubs included. A question reaches at most its seeds times hub to the power of hops chunks."""
    listed = F.array_sort(F.collect_list(F.struct("hop", F.col(chunk).alias("c"))))
    chunks = reached.groupBy(query).agg(listed.alias("x"))
    of = lambda keep: F.transform(F.filter("x", keep), lambda e: e["c"])
    keys = sections.where(F.col(section).isNotNull()).join(small_side(reached.select(query, chunk)), chunk).groupBy(query).agg(F.array_sort(F.collect_set(section)).alias("sections"))
    told = chunks.select(query, of(lambda e: e["hop"] == 0).alias("seeds"), of(lambda e: e["hop"] > 0).alias("expanded"))
    return told.join(keys, query, "left").withColumn("sections", F.coalesce("sections", F.array().cast("array<string>")))


def reordered(hits: DataFrame, features: dict[str, tuple[Column, float]], k: int, query: str = "query_id", item: str = "item_id", digits: int = 4) -> DataFrame:
    """hits with the features (0 to 1; null: 0), their weighted sum `second` and the new place `place`, the k best of each question; ties to the earlier rank, then the smaller item."""
    rows = hits.withColumns({name: F.round(F.coalesce(value, F.lit(0.0)), digits) for name, (value, _) in features.items()})
    second = reduce(lambda a, b: a + b, [F.col(name) * weight for name, (_, weight) in features.items()])
    ranked = rows.withColumn("second", F.round(second, digits + 2))
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("second"), "rank", item))).where(F.col("place") <= k)


def share_of_best(score: str = "score", query: str = "query_id") -> Column:
    """A score as a share of the question's best one."""
    return F.col(score) / F.max(score).over(Window.partitionBy(query))


def perspectives(texts: DataFrame, id_col: str, text_col: str, pools: DataFrame, least: float = 0.5, shown: int = 3) -> DataFrame:
    """id, perspective, confidence, reason: each text's perspective by the label pools (perspective, term) whose terms it holds.

    The votes of a perspective are the terms of its pool in the text; most votes win, ties go to the name first in order. Confidence is the share of all votes; below
    `least`, and without votes, the perspective is unknown. The reason lists the first `shown` terms that spoke for the winner. texts: one row an id.
    """
    pools = pools.select("perspective", "term").distinct()
    met = contained(texts, id_col, text_col, pools, "term").join(F.broadcast(pools.withColumnRenamed("term", "pattern")) if pools.count() <= 10_000 else pools.withColumnRenamed("term", "pattern"), "pattern")
    votes = met.groupBy(id_col, "perspective").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("pattern")).alias("terms"))  # a text's terms of one pool
    told = votes.groupBy(id_col).agg(F.min_by(F.struct("perspective", "n", "terms"), F.struct(-F.col("n"), F.col("perspective"))).alias("best"), F.sum("n").alias("all"))
    share = F.round(F.col("best.n") / F.col("all"), 4)
    known = told.select(id_col, F.when(share >= least, F.col("best.perspective")).otherwise(UNKNOWN).alias("perspective"), share.alias("confidence"), F.array_join(F.slice("best.terms", 1, shown), ",").alias("reason"))
    every = texts.select(id_col).join(known, id_col, "left")
    return every.select(id_col, F.coalesce("perspective", F.lit(UNKNOWN)).alias("perspective"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("reason", F.lit("")).alias("reason"))


def of_perspective(hits: DataFrame, asked: DataFrame, items: DataFrame, query: str = "query_id", item: str = "item_id") -> DataFrame:
    """hits whose item has the perspective of the question, with `matched`; all hits of a question whose perspective is unknown or that has no such hit.

    asked: query, perspective. items: item, perspective, of which those of the few hits are looked up.
    """
    known = asked.where(F.col("perspective") != UNKNOWN).select(query, F.col("perspective").alias("__asked"))
    held = items.join(small_side(hits.select(item).distinct()), item).select(item, F.col("perspective").alias("__held"))
    told = hits.join(known, query, "left").join(held, item, "left").withColumn("matched", F.coalesce(F.col("__asked") == F.col("__held"), F.lit(False)))
    some = F.max("matched").over(Window.partitionBy(query))
    return told.withColumn("__some", some).where("matched or not __some").drop("__asked", "__held", "__some")
