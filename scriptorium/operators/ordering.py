"""Numbers that run through a whole table, or a whole group, without one task that holds it all.

Rows are dealt into cells: ranges of a numeric order column with about equally many rows each, whatever group they belong to. Windows run
within a cell; cells are joined by prefix sums over one row a (group and) cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 256


def with_cell(rows: DataFrame, order: str, name: str = "__cell", cells: int = CELLS) -> DataFrame:
    """rows with the number of their range of the order column, ascending; a null order comes first."""
    found = rows.agg(F.percentile_approx(order, [i / cells for i in range(cells)], 4 * cells).alias("q")).first()["q"]
    edges = F.array(*[F.lit(e) for e in sorted(set(found or [0]))])
    return rows.withColumn(name, F.when(F.col(order).isNull(), F.lit(-1)).otherwise(F.size(F.filter(edges, lambda e: e <= F.col(order)))))


def running_total(rows: DataFrame, order: str, ties: list[str], weight: Column, name: str) -> DataFrame:
    """rows with the sum of weight over all rows up to their own, in order of `order` and then `ties`."""
    rows = with_cell(rows, order).withColumn("__w", weight)
    totals = rows.groupBy("__cell").agg(F.sum("__w").alias("__sum"))
    before = F.sum("__sum").over(Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1))
    base = totals.select("__cell", F.coalesce(before, F.lit(0)).alias("__base"))  # CELLS rows at most
    within = F.sum("__w").over(Window.partitionBy("__cell").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, within).join(F.broadcast(base), "__cell").withColumn(name, F.col(name) + F.col("__base")).drop("__cell", "__w", "__base")


def run_numbers(rows: DataFrame, partition: list[str], order: str, keys: list[str], name: str = "run") -> DataFrame:
    """Numbers consecutive rows with equal keys within each partition, in order: A, B, A are three runs."""
    own = F.struct(*keys)
    rows = with_cell(rows, order)
    cell = [*partition, "__cell"]
    ends = rows.groupBy(*cell).agg(F.max_by(own, order).alias("__last"))
    by = Window.partitionBy(*partition).orderBy("__cell")
    ends = ends.select(*cell, F.lag("__last").over(by).alias("__before"), (F.row_number().over(by) == 1).alias("__start"))
    w = Window.partitionBy(*cell).orderBy(order)
    joined = matched(rows, ends, cell)
    changed = F.when(F.row_number().over(w) == 1, F.col("__start") | ~own.eqNullSafe(F.col("__before"))).otherwise(~own.eqNullSafe(F.lag(own).over(w)))
    marked = joined.withColumn("__new", changed.cast("int")).drop("__before", "__start").withColumn(name, F.sum("__new").over(w))
    totals = marked.groupBy(*cell).agg(F.sum("__new").alias("__n"))
    base = totals.select(*cell, F.coalesce(F.sum("__n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    return matched(marked, base, cell).withColumn(name, F.col(name) + F.col("__base")).drop("__cell", "__new", "__base")


def matched(rows: DataFrame, per_cell: DataFrame, keys: list[str]) -> DataFrame:
    """rows with what is known of their cell; null keys are equal."""
    named = per_cell.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[c for c in per_cell.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return rows.join(named, same).drop(*[f"__k_{k}" for k in keys])
