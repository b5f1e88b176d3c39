"""Tags from vocabularies: which words, groups, marks a text contains. One projection each; vocabularies are parameters."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions import lexicon
from scriptorium.functions.text import contains_any, occurrences, words_in


def people(text: Column, suffixes: Iterable[str] = lexicon.PEOPLE_SUFFIXES, fallback: Iterable[str] = lexicon.PEOPLE_FALLBACK, most: int = 6) -> Column:
    """Names by suffix (the first `most` hits, without repeats), filled up with the fallback words that occur."""
    hits = F.regexp_extract_all(text, F.lit(f"[一-龥]{{1,4}}(?:{'|'.join(suffixes)})"), F.lit(0))
    return filled_up(hits, text, fallback, most)


def filled_up(hits: Column, text: Column, fallback: Iterable[str], most: int = 6) -> Column:
    """The first `most` hits without repeats, filled up to `most` with the fallback words that occur."""
    named = F.array_distinct(F.slice(hits, 1, most))
    return F.slice(F.array_union(named, words_in(text, fallback)), 1, most)


def present(text: Column, words: Iterable[str] = lexicon.EVENTS, most: int = 5) -> Column:
    """The first `most` words that occur, in vocabulary order."""
    return F.slice(words_in(text, words), 1, most)


def groups(text: Column, mapping: Mapping[str, Iterable[str]] = lexicon.TOPICS, most: int = 3) -> Column:
    """The first `most` groups of which a keyword occurs."""
    return F.slice(F.array_compact(F.array(*[F.when(contains_any(text, words), F.lit(name)) for name, words in mapping.items()])), 1, most)


def group_score(text: Column, words: Iterable[str]) -> Column:
    """How many of the words occur."""
    score = F.lit(0)
    for word in words:
        score = score + F.contains(text, F.lit(word)).cast("int")
    return score


def best_group(text: Column, mapping: Mapping[str, Iterable[str]] = lexicon.SCENES, default: str = "") -> Column:
    """The group with most keywords in the text; of equal ones the greatest name; the default without any."""
    scored = F.array(*[F.struct(group_score(text, words).alias("n"), F.lit(name).alias("name")) for name, words in mapping.items()])
    best = F.array_max(scored)
    return F.when(best["n"] > 0, best["name"]).otherwise(F.lit(default))


def chunk_type(text: Column, marker: str = "臣光曰", special: str = "commentary", plain: str = "fact") -> Column:
    return F.when(F.ltrim(text).startswith(marker), special).otherwise(plain)


def modern_score(text: Column, modern: Iterable[str] = lexicon.MODERN_MARKERS, classical: Iterable[str] = lexicon.CLASSICAL_MARKERS) -> Column:
    """Marks of modern prose less marks of classical prose; a mark that is listed twice counts twice."""
    total = F.lit(0)
    for mark in modern:
        total = total + occurrences(text, mark)
    for mark in classical:
        total = total - occurrences(text, mark)
    return total


def translation_like(text: Column, prefixes: Iterable[str] = lexicon.TRANSLATION_PREFIXES, markers: Iterable[str] = lexicon.TRANSLATION_MARKERS) -> Column:
    """Starts like a translation, notes a date, or has two of the markers."""
    text = F.trim(text)
    starts = F.lit(False)
    for prefix in prefixes:
        starts = starts | text.startswith(prefix)
    return starts | text.rlike(r"（公元前?\d+年") | (group_score(text, markers) >= 2)
