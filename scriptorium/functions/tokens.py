"""Tokens, n-grams and similarities, as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text_or_empty

CJK_TOKEN = r"[一-鿿]{2,}|[a-zA-Z0-9_]+"
LATIN_TOKEN = r"[\p{L}\p{N}_]+"
#: What lies between Latin tokens.
LATIN_GAP = r"[^\p{L}\p{N}_]+"


def grams_of(text: Column, least: int, most: int) -> Column:
    """All character n-grams of least to most characters, as an array. One pass of a look-ahead pattern per size."""
    return F.concat(*[F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in range(least, most + 1)])


def tokens(text: Column, pattern: str = LATIN_TOKEN, keywords: Iterable[str] = (), longest_run: int = 12) -> Column:
    """Distinct tokens. Ideograph runs of 3 to longest_run characters add their 2- and 3-grams; keywords are added where the
    text without blanks contains them."""
    text = text_or_empty(text)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    keywords = list(keywords)
    if "一-鿿" in pattern:
        runs = F.filter(found, lambda t: t.rlike(f"^[一-鿿]{{3,{longest_run}}}$"))
        found = F.concat(found, F.flatten(F.transform(runs, lambda t: grams_of(t, 2, 3))))
    if keywords:
        dense = F.replace(text, F.lit(" "), F.lit(""))
        found = F.concat(found, F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(dense, k)))
    return F.array_distinct(found)


def without_noise(text: Column, noise: Iterable[str]) -> Column:
    """Noise terms become blanks, longest first."""
    for term in sorted(set(noise), key=lambda t: (-len(t), t)):
        text = F.replace(text, F.lit(term), F.lit(" "))
    return text


def query_terms(text: Column, noise: Iterable[str] = (), cjk: bool = False, dense: bool = True) -> Column:
    """Distinct terms of a question: Latin terms of two letters at least in lower case; ideograph spans of up to four characters
    as they are, longer ones as their 2- to 4-grams."""
    text = text_or_empty(text)
    if dense:
        text = F.regexp_replace(text, r"(?U)\s+", "")
    text = without_noise(text, noise)
    if not cjk:
        return F.array_distinct(F.transform(F.filter(F.regexp_extract_all(text, F.lit(LATIN_TOKEN), F.lit(0)), lambda t: F.length(t) >= 2), F.lower))
    spans = F.regexp_extract_all(text, F.lit(r"[一-鿿]{2,12}|[a-zA-Z0-9_]{2,}"), F.lit(0))
    parts = F.transform(spans, lambda s: F.when(~s.rlike("^[一-鿿]+$"), F.array(F.lower(s))).when(F.length(s) <= 4, F.array(s)).otherwise(grams_of(s, 2, 4)))
    return F.array_distinct(F.flatten(parts))


def clean_terms(terms: Column, noise: Iterable[str] = ()) -> Column:
    """Lower case, without noise and repeats, longest first and then in order of the characters."""
    low = F.filter(F.array_distinct(F.transform(terms, lambda t: F.lower(F.trim(t)))), lambda t: t != "")
    if noise := list(noise):
        low = F.array_except(low, F.array(*[F.lit(n) for n in noise]))
    keyed = F.array_sort(F.transform(low, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    return F.transform(keyed, lambda x: x["t"])


def bigrams(text: Column) -> Column:
    """Distinct character pairs; a text of up to two characters is its only pair; none of an empty text."""
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(F.length(text) <= 2, F.array(text)).otherwise(F.array_distinct(grams_of(text, 2, 2)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 if either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(common / (F.size(a) + F.size(b) - common))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of numbers, as doubles; the cosine of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance_score(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - distance)
