"""Scalar text functions, as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, the ideographic space included.
SPACE = r"(?U)\s+"
#: Sentences: up to and with an end mark. Pass another pattern where the full stop does not end one.
CJK_SENTENCE = r"[^。！？；!?;]+[。！？；!?;]?"
LATIN_SENTENCE = r"[^.!?;\n]+[.!?;]?"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def normalized(c: Column, drop_prefixes: Iterable[str] = ()) -> Column:
    """Byte order mark and tags dropped, malformed prefixes dropped, white space runs to one blank, trimmed."""
    c = F.regexp_replace(F.translate(text_or_empty(c), "﻿", ""), r"<[^>]+>", "")
    for prefix in drop_prefixes:
        c = F.when(F.trim(c).startswith(prefix), F.substring(F.ltrim(c), F.lit(len(prefix) + 1), F.length(c))).otherwise(c)
    return F.trim(F.regexp_replace(c, SPACE, " "))


def compact(c: Column) -> Column:
    """Lower case without white space."""
    return F.lower(F.regexp_replace(text_or_empty(c), SPACE, ""))


def comparable(c: Column) -> Column:
    """Lower case, letters, digits and underscores only."""
    return F.lower(F.regexp_replace(text_or_empty(c), r"[^\p{L}\p{N}_]", ""))


def sentences(c: Column, pattern: str = LATIN_SENTENCE) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(text_or_empty(c), F.lit(pattern), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")


def shortened(c: Column, limit: int = 280, mark: str = "...") -> Column:
    """At most `limit` characters; a longer text ends with the mark."""
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit - len(mark))), F.lit(mark))).otherwise(c)


def safe_double(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def safe_int(c: Column) -> Column:
    return F.coalesce(c.try_cast("double").try_cast("int"), F.lit(0))


def slug(c: Column, limit: int = 24) -> Column:
    """Letters, digits and ideographs; all else becomes single hyphens."""
    return F.left(F.regexp_replace(F.regexp_replace(text_or_empty(c), r"[^0-9A-Za-z一-鿿]+", "-"), "^-+|-+$", ""), F.lit(limit))


def first_filled(*columns: Column) -> Column:
    """The first that is not null or blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns], F.lit(""))


def unique_filled(array: Column) -> Column:
    """Trimmed values without blanks and repeats, in order."""
    return F.array_distinct(F.filter(F.transform(array, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def numbered(prefix: str, number: Column, width: int = 5) -> Column:
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))


def occurrences(c: Column, word: str) -> Column:
    """How often a word occurs, without overlaps."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(word), F.lit("")))) / len(word)).cast("int")


def contains_any(c: Column, words: Iterable[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | c.contains(word)
    return found


def words_in(c: Column, words: Iterable[str]) -> Column:
    """Those of the words that the text contains, in the order given."""
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(c, w))


def signature(*columns: Column) -> Column:
    """SHA-1 of the values as JSON: equal for equal rows."""
    return F.sha1(F.to_json(F.struct(*columns)))


def filled_template(template: Column, values: dict[str, Column]) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), text_or_empty(value))
    return template


def html_escaped(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c
