"""Document fingerprints by winnowing.

The words of a text (lower-cased; a Han or kana character counts as a word) are hashed, a k-gram has the rolling hash of its words,
sum of h[i + j] * BASE**(k - 1 - j) modulo PRIME, and in every window of w consecutive k-grams the smallest hash is
chosen, the rightmost of equal ones. Chosen hashes keep their positions. Two texts that share k + w - 1 consecutive
words share a fingerprint; nothing shorter than k words ever matches.

The rolling hash of a run follows from those of its two parts, so all k-grams of a text come from a few passes over whole arrays
(pairs, pairs of pairs, ...) instead of an update word by word; the values are the same. Multiplications stay below 2**62.

A k-gram is held as one long: 31 bits of hash, then 31 bits that fall with the position, so that one `least` finds the
smallest hash and its rightmost place. Window minima are built by doubling too.

Scale. Fingerprints are a map. The next document in id order comes from one shuffle of the texts into about equal ranges of
ids (at most MAX_RANGES; two histograms find them), with the first document of each range copied to the end of the range before.

Only DataFrame functions are used.

Edge cases. Null text counts as empty: empty fingerprint. Fewer than k words: one k-gram of all of them. Two empty
fingerprints are alike (1.0), an empty and another are not (0.0). Rows without an id are in no order: each is its own next.
Rows of one id are ordered by their text and share a range. A single document is its own next. A very long text is one row of
arrays, 8 bytes a word. Empty table: no rows. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

#: Words: runs without white space; each Han, hiragana or katakana character by itself.
WORD = r"[぀-ヿ一-鿿]|[^\x20\x09-\x0D぀-ヿ一-鿿]+"
#: Fixed values of the rolling hash.
PRIME, BASE = 2**31 - 1, 1_000_003
RANGE_ROWS = 1024
MAX_RANGES = 100_000
#: Quantile cells of the ids, and parts of each.
CELLS, PARTS = 128, 1024
_LOW31 = (1 << 31) - 1


def _from(array: Column, start: int) -> Column:
    return F.slice(array, F.lit(start), F.greatest(F.size(array) - (start - 1), F.lit(0)))


def word_hashes(text: Column) -> Column:
    """xxhash64 of each word, modulo PRIME."""
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)), lambda w: F.pmod(F.xxhash64(w), F.lit(PRIME)))


def _joined(a: Column, b: Column, width: int) -> Column:
    """Rolling hashes of longer runs: those of runs `a`, each followed by `width` words with the hashes `b`."""
    return F.zip_with(a, b, lambda x, y: (x * F.lit(pow(BASE, width, PRIME)) + y) % F.lit(PRIME))


def _with_kgrams(df: DataFrame, hashes: str, out: str, k: int) -> DataFrame:
    """Adds `out`: one long per k-gram of the array column `hashes`."""
    h = F.col(hashes)
    n = F.size(h)
    combined, width, powers = h, 1, {1: h}
    while width * 2 <= k:
        combined = _joined(combined, _from(combined, width + 1), width)
        width *= 2
        powers[width] = combined
    done = width
    for p in sorted(powers, reverse=True)[1:]:
        while done + p <= k:
            combined = _joined(combined, _from(powers[p], done + 1), p)
            done += p
    short = F.array(F.aggregate(h, F.lit(0).cast("long"), lambda a, x: (a * F.lit(BASE) + x) % F.lit(PRIME)))
    grams = F.when(n == 0, F.array().cast("array<bigint>")).when(n < k, short).otherwise(F.slice(combined, F.lit(1), F.greatest(n - (k - 1), F.lit(1))))
    packed = F.transform(grams, lambda x, i: F.shiftleft(x, 31) + (F.lit(_LOW31).cast("long") - i))
    return df.withColumn(out, packed)


def with_winnowed(df: DataFrame, text: Column, name: str, k: int = 5, w: int = 4) -> DataFrame:
    """Adds `name`: the chosen k-grams of the text in order of position, as longs (see the module)."""
    assert w & (w - 1) == 0, "windows of a power of two"
    hashes, grams = f"__{name}_hashes", f"__{name}_grams"
    df = _with_kgrams(df.withColumn(hashes, word_hashes(text)), hashes, grams, k)
    low, width = F.col(grams), 1
    while width < w:
        low = F.zip_with(low, _from(low, width + 1), lambda a, b: F.least(a, b))
        width *= 2
    windows = F.slice(low, F.lit(1), F.greatest(F.size(grams) - (w - 1), F.least(F.size(grams), F.lit(1))))
    return df.withColumn(name, F.array_distinct(windows)).drop(hashes, grams)


def hash_of(gram: Column) -> Column:
    return F.shiftright(gram, 31)


def position_of(gram: Column) -> Column:
    return F.lit(_LOW31).cast("long") - gram.bitwiseAND(F.lit(_LOW31).cast("long"))


def as_text(grams: Column) -> Column:
    """hash:position of each, hash in hexadecimal, joined by blanks."""
    return F.array_join(F.transform(grams, lambda g: F.concat(F.lower(F.hex(hash_of(g))), F.lit(":"), position_of(g).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the hashes of two fingerprints."""
    x, y = (F.array_distinct(F.transform(c, hash_of)) for c in (a, b))
    common = F.size(F.array_intersect(x, y))
    union = F.size(x) + F.size(y) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def _ranges(docs: DataFrame) -> DataFrame:
    """docs (id, text) with range: a number that ascends with the id and has about RANGE_ROWS rows for each value.

    Ids fall into quantile cells, each cut into equal parts; the parts are counted and joined to ranges by a prefix sum, so ids that
    cluster within a cell are spread too.
    """
    shape = docs.agg(F.count("id").alias("n"), F.percentile_approx("id", [i / CELLS for i in range(CELLS + 1)], 10_000).alias("q")).first()
    if shape["q"] is None:
        return docs.withColumn("range", F.lit(-1).cast("long"))
    edges = F.array(*[F.lit(b).cast("long") for b in sorted({*shape["q"]})])
    cell = F.greatest(F.size(F.filter(edges, lambda b: b <= F.col("id"))), F.lit(1))
    low, high = F.get(edges, cell - 1).cast("double"), F.coalesce(F.get(edges, cell), F.get(edges, cell - 1)).cast("double")
    within = F.floor((F.col("id").cast("double") - low) / F.greatest(high - low, F.lit(1.0)) * PARTS)
    docs = docs.withColumn("place", cell * PARTS + F.greatest(F.least(within, F.lit(PARTS - 1)), F.lit(0)))
    counts = docs.where("id is not null").groupBy("place").agg(F.count("*").alias("rows"))  # CELLS * PARTS rows at most
    before = F.sum("rows").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    size = max(RANGE_ROWS, shape["n"] // MAX_RANGES + 1)
    ranges = durable(counts.select("place", F.floor(F.coalesce(before, F.lit(0)) / size).alias("range")))
    alone = -1 - F.pmod(F.xxhash64("text"), F.lit(MAX_RANGES))  # rows without an id
    return docs.join(F.broadcast(ranges), "place", "left").withColumn("range", F.coalesce("range", alone).cast("long")).drop("place")


def with_next(docs: DataFrame, id_col: str, text_col: str, derive) -> DataFrame:
    """id, text, what derive adds to each document, and `next`: a struct of the next document's text and derived columns."""
    docs = _ranges(docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")))
    firsts = docs.where("id is not null").groupBy("range").agg(F.min("id").alias("id"))  # MAX_RANGES rows and some
    order = Window.orderBy("range")
    ends = firsts.select("id", F.col("range").alias("home"), F.coalesce(F.lag("range").over(order), F.max("range").over(Window.partitionBy())).alias("goes_to"))
    ends = durable(ends).withColumnRenamed("id", "first_id")
    copies = docs.join(F.broadcast(ends), (F.col("range") == F.col("home")) & (F.col("id") == F.col("first_id")))
    rows = docs.withColumn("copy", F.lit(False)).unionByName(copies.select("id", "text", F.col("goes_to").alias("range"), F.lit(True).alias("copy")))
    rows = derive(rows.repartition("range"))
    own = F.struct(*[c for c in rows.columns if c not in ("id", "range", "copy")])
    ahead = F.lead(own).over(Window.partitionBy("range").orderBy("copy", "id", "text"))
    return rows.withColumn("next", F.when(F.col("id").isNull(), own).otherwise(ahead)).where(~F.col("copy")).drop("range", "copy")


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, w: int = 4) -> DataFrame:
    """id, text, grams, edited (text with its last quarter replaced from the next document), edited_grams and next (text, grams)."""
    found = with_next(docs, id_col, text_col, lambda rows: with_winnowed(rows, F.col("text"), "grams", k, w))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next.text"), F.lit(1), cut))
    return with_winnowed(found.withColumn("edited", edited), F.col("edited"), "edited_grams", k, w)
