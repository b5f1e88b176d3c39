"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a target: its weight's share of all words, at most `cap` times its own size, the excess shared again
by weight. A source is taken in complete epochs first; what remains of its target is a weighted sample without
replacement: every document draws the exponential key -ln(u) / quality, documents are taken in ascending order of their
keys, and the prefix sum of their sizes is cut at the budget (a document is in if its middle word is). Documents stay
whole, so a source misses its target by half a document at most.

Scale. u is a hash of id and text, so reruns agree and no order of rows matters. No source is sorted as a whole: two
histograms of 1,024 key buckets find the bucket in which a source's budget ends, with prefix sums over buckets, and only
the keys of that bucket, about a millionth of the source, are sorted. What comes out is one row per source, with the
last key taken; applying it to documents is a map without a shuffle of texts.

Only DataFrame functions are used.

Edge cases. Null text has size 0. A null source is a source of its own, last in order. Null ids are allowed. Rows with
equal id and text draw equal keys; where a budget ends among them a second key, a hash of a row's place in the table, tells
which of them are taken, by the same histograms, so that no number of copies moves a target. Those rows are equal, so reruns agree. A source of size 0 has target 0. Empty table: no rows.
Columns of the input named like the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

WORD = r"[^\x20\x09-\x0D]+"
#: Marks that are rare in prose; their share lowers a document's quality.
SYMBOLS = r"[#$%&*|<>{}=~^_]+"
BUCKETS = 1024
#: Rows of per-source decisions that may be sent to all executors (some 10 MB); more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """0.25 to 1: falls with the share of symbol characters."""
    text = F.coalesce(text, F.lit(""))
    clean = F.length(F.regexp_replace(text, SYMBOLS, "")) / F.greatest(F.length(text), F.lit(1))
    return 0.25 + 0.75 * clean * clean


def sampling_key(id_col: Column, text: Column, weight: Column, seed: int) -> Column:
    """Exponential key: -ln(u) / weight, u from 52 bits of a hash of seed, id and text."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), id_col.cast("string"), F.md5(F.coalesce(text, F.lit("")))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 1) / F.lit(float(2**52))
    return -F.log(u) / weight


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> DataFrame:
    """docs with size (words), key, and tie, which tells rows of equal key apart; docs is a table, or a deterministic plan over one."""
    text = F.col(text_col).cast("string")
    return _tied(docs.drop("tie").withColumns({"size": word_count(text), "key": sampling_key(F.col(id_col), text, quality(text), seed)}))


def _tied(rows: DataFrame) -> DataFrame:
    return rows if "tie" in rows.columns else rows.withColumn("tie", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(BUCKETS**4)))


def targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """source, source_size, target from source, source_size. One row a source goes through a global window."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(Window.partitionBy())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))).withColumn("all_words", total)
    weighed = weighed.withColumn("limit", F.col("source_size") * float(cap)).withColumn("ratio", F.col("limit") / F.col("weight"))
    # In ascending order of limit per weight the capped sources come first; behind them what is left is shared by weight.
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("all_words") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levelled = weighed.withColumn("level", level).withColumn("place", F.row_number().over(order))
    share = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(Window.partitionBy())
    return levelled.select("source", "source_size", F.least(F.col("limit"), share["level"] * F.col("weight")).alias("target"))


def _position() -> Column:
    """Number of a key's bucket among BUCKETS squared, ascending with the key."""
    return F.least(F.floor((1 - F.exp(-F.col("key"))) * float(BUCKETS * BUCKETS)), F.lit(BUCKETS * BUCKETS - 1)).cast("long")


def _edge_bucket(rows: DataFrame, bucket: Column) -> DataFrame:
    """Per source: the first bucket whose sizes go beyond rest, and the rest at its start. rows: source, rest, size, position."""
    sums = rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    over = sums.withColumn("before", before).where("before + words > rest")
    first = over.groupBy("source").agg(F.min(F.struct("bucket", "before", "rest")).alias("x"))
    return first.select("source", F.col("x.bucket").alias("bucket"), (F.col("x.rest") - F.col("x.before")).alias("rest"))


def _join(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """rows with decisions by source, null equal to null; decisions must be materialized."""
    small = decisions.count() <= BROADCAST_SOURCES
    decisions = decisions.withColumnRenamed("source", "__source")
    return rows.join(F.broadcast(decisions) if small else decisions, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def decisions(slim: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """One row a source: source_size, target, epochs, edge, last_key and last_tie. slim: materialized rows of source, size, key, tie."""
    slim = _tied(slim)
    budget = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(cap))).otherwise(0).cast("long")
    budget = durable(budget.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    rows = _join(slim.withColumn("position", _position()), budget.where("rest > 0").select("source", "rest"))
    coarse = durable(_edge_bucket(rows, F.floor(F.col("position") / BUCKETS)))
    rows = _join(slim.withColumn("position", _position()), coarse).where(F.floor(F.col("position") / BUCKETS) == F.col("bucket")).drop("bucket")
    edge = durable(_edge_bucket(rows, F.col("position")))
    inside = _join(slim.withColumn("position", _position()), edge).where("position = bucket")
    keys = inside.groupBy("source", "key").agg(F.sum("size").alias("words"), F.max("size").alias("each"), F.count("*").alias("n"), F.first("rest").alias("rest"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    started = keys.withColumn("before", before).where(F.col("before") + F.col("each") / 2 <= F.col("rest"))
    room = F.when(F.col("each") > 0, F.least("n", F.floor((F.col("rest") - F.col("before")) / F.col("each") + 0.5))).otherwise(F.col("n"))
    last = durable(started.groupBy("source").agg(F.max_by(F.struct("key", room.alias("room"), "n"), "key").alias("x")).select("source", F.col("x.key").alias("last_key"), "x.room", "x.n"))
    last = last.join(_last_tie(slim, last.where("room < n").select("source", "last_key", F.col("room").alias("rest"))), F.col("source").eqNullSafe(F.col("tie_source")), "left") if not last.where("room < n").isEmpty() else last.withColumn("last_tie", F.lit(None).cast("long"))
    last = last.select("source", "last_key", F.coalesce("last_tie", F.lit(BUCKETS**4)).alias("last_tie"))
    edge = edge.select(F.col("source").alias("edge_source"), F.col("bucket").alias("edge"))
    last = last.withColumnRenamed("source", "last_source")
    both = budget.join(edge, F.col("source").eqNullSafe(F.col("edge_source")), "left").join(last, F.col("source").eqNullSafe(F.col("last_source")), "left")
    none_left = F.when(F.col("rest") > 0, F.lit(BUCKETS * BUCKETS)).otherwise(F.lit(-1))  # the budget takes all, or nothing
    return durable(both.select("source", "source_size", "target", "epochs", F.coalesce("edge", none_left).cast("long").alias("edge"), "last_key", "last_tie"))


def _last_tie(slim: DataFrame, ends: DataFrame) -> DataFrame:
    """tie_source and last_tie: the greatest tie that is taken of the `rest` rows of each source's last key. Few sources, each with any number of copies."""
    equal = _join(slim.select("source", "key", "tie", F.lit(1).alias("size")), durable(ends)).where("key = last_key").drop("key", "last_key")
    for bucket in (F.floor(F.col("tie") / BUCKETS**3), F.floor(F.col("tie") / BUCKETS**2)):
        edge = durable(_edge_bucket(equal, bucket).withColumnRenamed("rest", "left"))
        # What lies before the bucket in which the rest ends is taken, what lies behind it is not.
        equal = _join(equal.withColumn("at", bucket), edge).where("at = bucket").drop("at", "bucket", "rest").withColumnRenamed("left", "rest")
    number = F.row_number().over(Window.partitionBy("source").orderBy("tie"))
    best = equal.withColumn("n", number).where("n <= rest").groupBy("source").agg(F.max("tie").alias("last_tie"))
    start = edge.select(F.col("source").alias("tie_source"), (F.col("bucket") * BUCKETS**2 - 1).alias("start"))
    return start.join(best, F.col("tie_source").eqNullSafe(F.col("source")), "left").select("tie_source", F.coalesce("last_tie", "start").alias("last_tie"))


def with_copies(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """keyed rows with source_size, target and copies (complete epochs, and one more for those sampled)."""
    fresh = rows.drop("source_size", "target", "copies", "position", "epochs", "edge", "last_key", "last_tie")
    both = _join(_tied(fresh).withColumn("position", _position()), decided)
    sampled = (F.col("position") < F.col("edge")) | ((F.col("position") == F.col("edge")) & F.coalesce((F.col("key") < F.col("last_key")) | ((F.col("key") == F.col("last_key")) & (F.col("tie") <= F.col("last_tie"))), F.lit(False)))
    return both.withColumn("copies", F.col("epochs") + sampled.cast("long")).drop("position", "epochs", "edge", "last_key", "last_tie", "tie")
