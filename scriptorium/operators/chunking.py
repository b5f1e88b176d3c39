"""Chunks: size-bounded packing of ordered pieces, with or without overlap, and windows over characters or groups.

Packing depends on what was packed before, so it is a fold over the ordered pieces of one group (a document, a conversation, a
run of sections), one row of the input each; groups are independent and spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CHUNK = "array<struct<first:int,last:int,size:int>>"
_STATE = "struct<done:" + _CHUNK + ",first:int,last:int,size:int>"


def ordered_list(rows: DataFrame, group: list[str], order: str, *columns: str) -> DataFrame:
    """One row a group with `pieces`, an array of structs in order."""
    return rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("pieces"))


def sized_packs(sizes: Column, target: int) -> Column:
    """Packs of consecutive pieces: a pack ends when the next piece would take it over target. Array of (first, last, size), from 1."""
    start = F.struct(F.array().cast(_CHUNK).alias("done"), F.lit(0).alias("first"), F.lit(0).alias("last"), F.lit(0).alias("size"))
    items = F.transform(sizes, lambda x, i: F.struct(x.cast("int").alias("n"), (i + 1).alias("i")))

    def step(s: Column, x: Column) -> Column:
        full = (s["first"] > 0) & (s["size"] + x["n"] > target)
        closed = F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), s["last"].alias("last"), s["size"].alias("size"))))
        return F.struct(
            F.when(full, closed).otherwise(s["done"]).alias("done"), F.when(full | (s["first"] == 0), x["i"]).otherwise(s["first"]).alias("first"), x["i"].alias("last"), F.when(full, x["n"]).otherwise(s["size"] + x["n"]).alias("size")
        )

    end = lambda s: F.when(s["first"] > 0, F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), s["last"].alias("last"), s["size"].alias("size"))))).otherwise(s["done"])
    return F.aggregate(items, start, step, end)


def overlapping_packs(sizes: Column, soft: int = 900, target: int = 1400, hard: int = 1600, overlap: bool = True) -> Column:
    """Packs with the last piece carried into the next. Array of (first, last, size), piece numbers from 1.

    Pieces are joined by one separator each. A pack ends before a piece that would take it over hard, or over target once it has
    reached soft; it ends after a piece with which it reaches hard. The carried piece is left behind where it does not fit with the
    next one. A piece longer than hard is a pack of its own and is carried nowhere; blank pieces are skipped. The last pack, and one
    before a piece longer than hard, is kept only if something new is in it.
    """
    start = F.struct(F.array().cast(_CHUNK).alias("done"), F.lit(0).alias("first"), F.lit(0).alias("last"), F.lit(0).alias("size"), F.lit(False).alias("fresh"), F.lit(0).alias("tail"))
    items = F.filter(F.transform(sizes, lambda x, i: F.struct(x.cast("int").alias("n"), (i + 1).alias("i"))), lambda x: x["n"] > 0)
    chunk = lambda a, b, n: F.array(F.struct(a.cast("int").alias("first"), b.cast("int").alias("last"), n.cast("int").alias("size")))

    def state(done, first, last, size, fresh, tail):
        return F.struct(done.alias("done"), first.cast("int").alias("first"), last.cast("int").alias("last"), size.cast("int").alias("size"), fresh.alias("fresh"), tail.cast("int").alias("tail"))

    zero = F.lit(0)

    def step(s: Column, x: Column) -> Column:
        n, i = x["n"], x["i"]
        held = s["first"] > 0
        flushed = F.when(held & s["fresh"], F.concat(s["done"], chunk(s["first"], s["last"], s["size"]))).otherwise(s["done"])
        longer = s["size"] + n + 1
        ends = held & ((longer > hard) | ((s["size"] >= soft) & (longer > target)))
        carried = F.lit(overlap) & (s["tail"] + n + 1 <= hard)
        first = F.when(ends, F.when(carried, s["last"]).otherwise(i)).when(held, s["first"]).otherwise(i)
        size = F.when(ends, F.when(carried, s["tail"] + n + 1).otherwise(n)).when(held, longer).otherwise(n)
        done = F.when(ends, F.concat(s["done"], chunk(s["first"], s["last"], s["size"]))).otherwise(s["done"])
        grown = state(done, first, i, size, F.lit(True), n)
        # Reaching hard ends the pack at once; its last piece is carried, as something not new.
        full = state(F.concat(done, chunk(first, i, size)), i if overlap else zero, i, n if overlap else zero, F.lit(False), n)
        return F.when(n > hard, state(F.concat(flushed, chunk(i, i, n)), zero, zero, zero, F.lit(False), zero)).when(size >= hard, full).otherwise(grown)

    return F.aggregate(items, start, step, lambda s: F.when((s["first"] > 0) & s["fresh"], F.concat(s["done"], chunk(s["first"], s["last"], s["size"]))).otherwise(s["done"]))


def character_windows(text: Column, width: int = 1400, overlap: int = 240) -> Column:
    """Windows of width characters that overlap: array of (start, text). No window lies wholly within the one before."""
    stride = max(1, width - overlap)
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - overlap - 1, F.lit(0)), F.lit(stride))
    cut = F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring(text, s + 1, F.lit(width)).alias("text")))
    return F.when(F.length(text) > 0, cut).otherwise(F.array().cast("array<struct<start:int,text:string>>"))


def sentence_parts(sentences: Column, text: Column, target: int = 1400) -> Column:
    """Parts of an oversized text: sentences joined up to target; a longer sentence is cut, and its pieces stand alone. A text without
    sentences is cut by characters."""
    cut = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length(s), F.lit(1)) - 1) / target).cast("int")), lambda j: F.substring(s, j * target + 1, F.lit(target)))
    pieces = F.flatten(F.transform(sentences, lambda s: F.transform(cut(s), lambda p: F.struct(p.alias("text"), F.when(F.length(s) > target, target).otherwise(F.length(p)).alias("size")))))
    packs = sized_packs(F.transform(pieces, lambda p: p["size"]), target)
    joined = F.transform(packs, lambda p: F.array_join(F.transform(F.slice(pieces, p["first"], p["last"] - p["first"] + 1), lambda x: x["text"]), ""))
    return F.when(F.size(sentences) > 0, joined).otherwise(F.filter(cut(text), lambda p: p != ""))


def overlapping_sentence_parts(sentences: Column, text: Column, target: int = 1400, back: int = 3, overlap: int = 240, least: int = 600, hard: int = 1600) -> Column:
    """Parts of an oversized text that overlap: each goes on up to target and begins `back` sentences before the end of the one before.

    A sentence longer than target is cut into windows of characters. A last part shorter than least joins the one before where both fit hard.
    """
    # What is used more than once is bound by a lambda, so that it is worked out once a row.
    bound = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    sums = F.aggregate(sentences, F.array(F.lit(0)), lambda done, s: F.concat(done, F.array(F.element_at(done, -1) + F.length(s))))  # characters of the first 0, 1, ... sentences
    spans = "array<struct<first:int,size:int>>"

    def step(state: Column, _: Column) -> Column:
        at, ends = state["at"], state["ends"]
        n = F.size(ends) - 1
        size = F.greatest(F.size(F.filter(ends, lambda e: (e > F.get(ends, at)) & (e <= F.get(ends, at) + target))), F.lit(1))

        def onward(size: Column) -> Column:
            following = F.when(at + size >= n, n).otherwise(F.greatest(at + 1, at + size - back))
            return F.struct(following.cast("int").alias("at"), ends.alias("ends"), F.concat(state["done"], F.array(F.struct((at + 1).cast("int").alias("first"), size.cast("int").alias("size")))).alias("done"))

        return F.when(at < n, bound(size, onward)).otherwise(state)

    start = F.struct(F.lit(0).alias("at"), sums.alias("ends"), F.array().cast(spans).alias("done"))
    found = F.aggregate(sentences, start, step, lambda s: s["done"])
    windows = lambda t: F.transform(character_windows(t, target, overlap), lambda w: w["text"])
    whole = F.transform(found, lambda p: F.array_join(F.slice(sentences, p["first"], p["size"]), ""))
    parts = F.flatten(F.transform(whole, lambda t: F.when(F.length(t) > target, windows(t)).otherwise(F.array(t))))

    def tail_joined(parts: Column) -> Column:
        last, previous = F.element_at(parts, -1), F.get(parts, F.size(parts) - 2)
        joins = (F.size(parts) >= 2) & (F.length(last) < least) & (F.length(previous) + F.length(last) <= hard)
        return F.when(joins, F.concat(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 2, F.lit(0))), F.array(F.concat(previous, last)))).otherwise(parts)

    return F.when(F.size(sentences) > 0, bound(parts, tail_joined)).otherwise(windows(text))


def group_windows(rows: DataFrame, group: str, order: str, text: str, separator: str = "\n") -> DataFrame:
    """One window over each whole group: its text in order, pieces and size."""
    lists = ordered_list(rows, [group], order, text)
    texts = F.transform("pieces", lambda p: p[text])
    return lists.select(group, F.array_join(texts, separator).alias("text"), F.size("pieces").alias("pieces"), F.aggregate(texts, F.lit(0), lambda a, t: a + F.length(t)).alias("chars"))


def merged_titles(titles: Column) -> Column:
    """The first and last of the distinct titles, or the only one."""
    unique = F.array_distinct(F.filter(titles, lambda t: t != ""))
    return F.when(F.size(unique) <= 1, F.coalesce(F.get(unique, F.lit(0)), F.lit(""))).otherwise(F.concat_ws(" – ", F.element_at(unique, 1), F.element_at(unique, -1)))


def histogram_text(values: Column) -> Column:
    """value:count of the distinct values in order, joined by commas."""
    unique = F.array_sort(F.array_distinct(values))
    return F.array_join(F.transform(unique, lambda u: F.concat(u, F.lit(":"), F.size(F.filter(values, lambda v: v == u)).cast("string"))), ",")


def counted_text(value: Column, n: Column) -> Column:
    """The same from counted values, as an aggregate: one row a distinct value."""
    pairs = F.array_sort(F.collect_list(F.concat(value, F.lit(":"), n.cast("string"))))
    return F.array_join(pairs, ",")


def links(members: DataFrame, chunks: DataFrame, key: str, id_col: str, chunk_col: str = "chunk_id") -> DataFrame:
    """Every member with the sorted chunks that hold its key; an empty list where none does. chunks: chunk, keys (array)."""
    flat = chunks.select(chunk_col, F.explode("keys").alias(key)).groupBy(key).agg(F.sort_array(F.collect_set(chunk_col)).alias("chunks"))
    return members.join(flat, key, "left").withColumn("chunks", F.coalesce("chunks", F.array().cast(flat.schema["chunks"].dataType)))
