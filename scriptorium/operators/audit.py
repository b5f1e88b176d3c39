"""Corpus quality: statistics, frequencies, missing fields, large groups, review candidates. Aggregations on a key, all of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def length_stats(rows: DataFrame, size: Column, keys: list[str], low: int = 900, high: int = 1400, most: int = 1600) -> DataFrame:
    """count, min, max, mean, median, rows in [low, high] and rows over most, per key."""
    rows = rows.withColumn("__n", size)
    n = F.col("__n")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.groupBy(*keys).agg(
        F.count("__n").alias("n"), zero(F.min(n)).cast("long").alias("shortest"), zero(F.max(n)).cast("long").alias("longest"), F.round(zero(F.avg(n)), 1).alias("mean"), F.round(zero(F.median(n)), 1).alias("median"),
        F.count_if(n.between(low, high)).alias("in_range"), F.count_if(n > most).alias("over"),
    )


def outliers(rows: DataFrame, key: str, condition: Column, least: int = 4, share: float = 0.05) -> DataFrame:
    """Keys with at least `least` rows, or that share of rows, that meet the condition; worst first in rank."""
    sums = rows.groupBy(key).agg(F.count("*").alias("n"), F.count_if(condition).alias("hits"))
    return sums.withColumn("share", F.round(F.col("hits") / F.col("n"), 6)).where((F.col("hits") >= least) | (F.col("share") >= share))


def summary(rows: DataFrame, conditions: dict[str, Column], sums: dict[str, Column]) -> DataFrame:
    """One row: n, the count and share of each condition (share 0 of nothing), and sums."""
    shares = [F.coalesce(F.round(F.try_divide(F.count_if(c), F.count("*")), 6), F.lit(0.0)).alias(f"{name}_share") for name, c in conditions.items()]
    return rows.agg(F.count("*").alias("n"), *[F.count_if(c).alias(name) for name, c in conditions.items()], *shares, *[F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in sums.items()])


def missing(rows: DataFrame, fields: list[str]) -> DataFrame:
    """field, missing: how many rows have null or blank there."""
    counts = rows.agg(*[F.count_if(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "").alias(c) for c in fields])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("missing")) for c in fields])).alias("x")).select("x.*")


def top_counts(rows: DataFrame, value: str, order: str, limit: int = 20) -> DataFrame:
    """The most frequent values; of equal ones the one seen first."""
    return rows.groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), "first").limit(limit)


def large_groups(rows: DataFrame, key: str, least: int, ids: str, names: str, kind: str) -> DataFrame:
    """Keys with at least `least` rows: n, smallest and number of ids, sorted distinct names, and the histogram of kinds as text."""
    big = rows.groupBy(key, kind).agg(F.count("*").alias("n"), F.min(ids).alias("first"), F.collect_set(names).alias("names"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(kind, "n"))), lambda x: F.concat(x[kind], F.lit(":"), x["n"].cast("string"))), ",")
    return big.groupBy(key).agg(F.sum("n").alias("n"), F.min("first").alias("first_id"), F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list("names")))), ",").alias("names"), text.alias("kinds")).where(F.col("n") >= least)


def review_candidates(rows: DataFrame, id_col: str, reasons: dict[str, Column]) -> DataFrame:
    """id and the reasons that hold for it; rows without one are left out."""
    named = F.array(*[F.when(c, F.lit(name)) for name, c in reasons.items()])
    return rows.select(id_col, F.array_compact(named).alias("reasons")).where(F.size("reasons") > 0)


def lowest(rows: DataFrame, score: str, below: float, order: str, limit: int = 50) -> DataFrame:
    return rows.where(F.col(score) < below).orderBy(score, order).limit(limit)


def sampled(rows: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, the same ones on every run."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"))), id_col).limit(n)


def markdown(title: str, table: DataFrame, columns: list[str]) -> DataFrame:
    """A table as markdown lines: line number and line."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    head = ["# " + title, "| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    spark = table.sparkSession
    top = reduce(lambda a, b: a.union(b), [spark.range(1).select(F.lit(i).cast("long").alias("number"), F.lit(line).alias("line")) for i, line in enumerate(head)])
    return top.union(table.select((F.monotonically_increasing_id() + len(head)).alias("number"), cells.alias("line")))


def corpus_summary(sizes: DataFrame, key: str, size: str, ends: int = 5) -> DataFrame:
    """Rows of one form: part `all` with count, least, most, mean, median and total of the sizes, and the `ends` smallest and largest keys."""
    n = F.col(size)
    row = lambda part, name, *values: [F.lit(part).alias("part"), name.alias(key), *[v.alias(c) for c, v in zip(("n", "least", "most", "mean", "median", "total"), values)]]
    whole = sizes.agg(F.count("*").alias("c"), F.min(n).alias("a"), F.max(n).alias("b"), F.round(F.avg(n), 1).alias("m"), F.round(F.median(n), 1).alias("d"), F.sum(n).alias("t"))
    out = whole.select(*row("all", F.lit(None).cast("string"), *[F.col(c) for c in "cabmdt"]))
    for part, order in (("smallest", n.asc()), ("largest", n.desc())):
        some = sizes.orderBy(order, key).limit(ends)
        out = out.unionByName(some.select(*row(part, F.col(key), F.lit(1).cast("long"), n, n, n.cast("double"), n.cast("double"), n)))
    return out


def latency_stats(times: DataFrame, key: str, seconds: str) -> DataFrame:
    """Count, mean, median, least and most of measured seconds, by what was measured."""
    s = F.col(seconds)
    return times.groupBy(key).agg(F.count(s).alias("n"), *[F.round(f(s), 3).alias(f"{name}_s") for name, f in (("mean", F.avg), ("median", F.median), ("min", F.min), ("max", F.max))])
