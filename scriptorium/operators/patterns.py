"""Many patterns looked for in every text at once: an automaton over all patterns, built once a task and run once over each text.

Patterns are a stated set (terms or passages of questions). They come to the driver in parts of at most PART patterns and PART_CHARS characters; each part is
one pass over the texts, so the set may have any size, and a part's automaton fits a task. Texts are never shuffled and never meet patterns one by one: a pass costs its characters
and its matches.

Nulls: a null text holds nothing, a null pattern is in nothing; the empty pattern is in every text that is not null. Repeated patterns count once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART, PART_CHARS = 200_000, 8_000_000
#: Rows of matches that are handed on at once.
ROWS = 50_000

_built: dict[tuple[str, ...], object] = {}


def automaton(patterns: tuple[str, ...]):
    """Of distinct, filled patterns, by their places. A worker keeps its last one."""
    import ahocorasick

    if patterns not in _built:
        _built.clear()
        made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, pattern in enumerate(patterns):
            made.add_word(pattern, i)
        made.make_automaton()
        _built[patterns] = made
    return _built[patterns]


def found(patterns: tuple[str, ...], text: str | None) -> set[int]:
    """Places of the patterns that a text holds."""
    return {i for _, i in automaton(patterns).iter(text)} if text and patterns else set()


def parts(values: Iterable[str]) -> Iterator[tuple[str, ...]]:
    """Patterns in parts of bounded size, in order."""
    part: list[str] = []
    chars = 0
    for value in values:
        part.append(value)
        chars += len(value)
        if len(part) == PART or chars >= PART_CHARS:
            yield tuple(part)
            part, chars = [], 0
    if part:
        yield tuple(part)


def contained(texts: DataFrame, id_col: str, text_col: str, patterns: DataFrame, pattern_col: str) -> DataFrame:
    """id, pattern: which texts hold which patterns, once each row of texts."""
    distinct = patterns.select(F.col(pattern_col).cast("string").alias("pattern")).where("pattern is not null").distinct()
    rows = texts.select(id_col, F.col(text_col).cast("string").alias("__text")).where("__text is not null")
    kind = rows.schema[id_col].dataType.simpleString()

    def met(part: tuple[str, ...]) -> DataFrame:
        filled = tuple(p for p in part if p)
        always = ("",) if len(filled) < len(part) else ()

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                ids, what, n = [], [], 0
                made = lambda: pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(what, pa.string())], names=[id_col, "pattern"])  # noqa: B023, E731
                for place, text in enumerate(batch.column(1)):
                    names = [*always, *(filled[i] for i in found(filled, text.as_py()))]
                    ids += [place] * len(names)
                    what += names
                    n += len(names)
                    if n >= ROWS:
                        yield made()
                        ids, what, n = [], [], 0
                yield made()

        return rows.mapInArrow(run, f"{id_col} {kind}, pattern string")

    out = None
    for part in parts(r["pattern"] for r in distinct.toLocalIterator()):
        out = met(part) if out is None else out.union(met(part))
    return out if out is not None else rows.select(id_col, F.col("__text").alias("pattern")).limit(0)
