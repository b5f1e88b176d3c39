"""Merging structured cases: exact groups first, then near duplicates in corpus order.

A case is a row: case_id, actor, kind, title, conflict, pattern, summary (texts), sections (array), chunks (array), tags (array), score,
priority, and its place in the corpus: ordinal (of its first chunk) and position (of its first section). Near duplicates are found by
a fold over the cases of a book in corpus order that looks back at the LOOK_BACK cases it kept last. The fold is cut wherever no later
case can merge with an earlier one (the ordinals are too far apart and no section is on both sides), so what one task folds is a
stretch of neighbouring cases, not a book, and it passes through the task: a stretch as long as a book takes one task's time, but no more memory than LOOK_BACK cases.

Nulls: a null text is empty and equal to empty, a null list empty, a null score 0. A case without chunks merges with none; one without an
ordinal only over a common section.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from scriptorium.functions.text import comparable, text_or_empty
from scriptorium.sources.store import durable

from .ordering import matched, with_cell
from .retrieval import spread

UNKNOWN = 10**9
#: Kept cases that a case is compared with, similarity from which it merges, and with a section in common, greatest distance of ordinals otherwise.
LOOK_BACK, ALIKE, ALIKE_OVERLAPPING, DISTANCE = 5, 0.82, 0.72, 1
#: A text gives way to one that is longer by more than this.
LONGER = 20
TEXTS = ("title", "summary", "conflict", "pattern")
LISTS = ("sections", "chunks", "tags")
STATE = ("actor", "kind", "score", "case_id", *TEXTS, *LISTS, "priority", "ordinal", "position", "merged")
#: Texts by which near duplicates are told.
TOLD = ("title", "conflict", "pattern")
#: Cases that are Python objects at once.
ROWS = 256


def compare_text(title: Column, conflict: Column, pattern: Column) -> Column:
    """What near duplicates are told by: the three texts without marks, joined by blanks."""
    return F.trim(F.concat_ws(" ", *[comparable(c) for c in (title, conflict, pattern)]))


def sort_key(ordinal: Column, position: Column, actor: Column, score: Column) -> list[Column]:
    """Corpus order of cases: chunk, place of the section, actor, best score first; unknown places last."""
    return [F.coalesce(ordinal, F.lit(UNKNOWN)), F.coalesce(position, F.lit(UNKNOWN)), text_or_empty(actor), -F.coalesce(score, F.lit(0.0))]


def better_text(primary: Column, secondary: Column) -> Column:
    """The primary text, unless it is empty or shorter by more than LONGER."""
    return F.when((primary == "") | ((secondary != "") & (F.length(secondary) > F.length(primary) + LONGER)), secondary).otherwise(primary)


def _cleaned(cases: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    rows = cases.withColumns({c: F.trim(text_or_empty(F.col(c))) for c in (*TEXTS, "actor", "kind")} | {c: F.coalesce(c, empty) for c in LISTS} | {"score": F.coalesce("score", F.lit(0.0)), "priority": F.coalesce("priority", F.lit(0.85))})
    return rows.withColumn("merged", F.lit(0))


def _state(rows: DataFrame) -> Column:
    return F.struct("actor", "kind", "score", F.length(compare_text(F.col("title"), F.col("conflict"), F.col("pattern"))).alias("told"), F.length("summary").alias("size"), "case_id", *TEXTS, *LISTS, "priority", "ordinal", "position", "merged")


def _united(a: Column, b: Column) -> Column:
    """Two states as one. The one with the greater (score, told, size) is preferred, the first of equal ones."""
    second = F.struct(b["score"], b["told"], b["size"]) > F.struct(a["score"], a["told"], a["size"])
    pick = lambda f: (F.when(second, b[f]).otherwise(a[f]), F.when(second, a[f]).otherwise(b[f]))
    texts = {t: better_text(*pick(t)) for t in TEXTS}
    lists = {c: F.array_union(*pick(c)) for c in LISTS} | {c: F.array_sort(F.array_union(*pick(c))) for c in ("sections", "chunks")}
    first = F.struct(F.coalesce(b["ordinal"], F.lit(UNKNOWN)), F.coalesce(b["position"], F.lit(UNKNOWN))) < F.struct(F.coalesce(a["ordinal"], F.lit(UNKNOWN)), F.coalesce(a["position"], F.lit(UNKNOWN)))
    fields = {
        "actor": a["actor"], "kind": a["kind"], "score": F.greatest(a["score"], b["score"]), "told": F.length(compare_text(texts["title"], texts["conflict"], texts["pattern"])), "size": F.length(texts["summary"]), "case_id": pick("case_id")[0], **texts, **lists,
        "priority": F.greatest(a["priority"], b["priority"]), "ordinal": F.when(first, b["ordinal"]).otherwise(a["ordinal"]), "position": F.when(first, b["position"]).otherwise(a["position"]), "merged": a["merged"] + b["merged"] + 1,
    }
    return F.struct(*[fields[f].alias(f) for f in ("actor", "kind", "score", "told", "size", "case_id", *TEXTS, *LISTS, "priority", "ordinal", "position", "merged")])


def exact_merged(cases: DataFrame, by: list[str]) -> DataFrame:
    """One case for each (by, actor, kind, sections, comparable title, comparable conflict), folded in order of case_id. merged: cases that went into it, less one."""
    rows = _cleaned(cases)
    key = {"actor": F.col("actor"), "kind": F.col("kind"), "of": F.array_join("sections", "\u0001"), "t": comparable(F.col("title")), "c": comparable(F.col("conflict"))}
    first = F.array_sort(F.collect_list(F.struct("case_id", _state(rows).alias("s"))))
    groups = rows.groupBy(*by, *[c.alias(f"key_{n}") for n, c in key.items()]).agg(first.alias("of"))
    folded = groups.select(*by, F.aggregate(F.slice("of", 2, F.greatest(F.size("of") - 1, F.lit(0))), F.get("of", F.lit(0))["s"], lambda s, x: _united(s, x["s"])).alias("s"))
    return folded.select(*by, "s.*").drop("told", "size")


def stretches(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, place and stretch: the ordinal at which the stretch of a place begins. A new one begins where the ordinals are too far apart and no section lies on both sides.

    One row a book and place, dealt into ranges of places; what lies before and after a range comes from one row a book and range.
    """
    ends = rows.groupBy(*by, F.coalesce("ordinal", F.lit(UNKNOWN)).alias("place")).agg(F.min(F.array_min("sections")).alias("low"), F.max(F.array_max("sections")).alias("high"))
    places, cell = with_cell(ends, "place"), [*by, "__cell"]
    up, down = (Window.partitionBy(*by).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("__cell"), F.desc("__cell")))
    known = places.groupBy(*cell).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("place").alias("place"))
    known = known.select(*cell, F.max("high").over(up).alias("__reach"), F.max("place").over(up).alias("__last"), F.min("low").over(down).alias("__ahead"))
    w, back = (Window.partitionBy(*cell).orderBy(o) for o in (F.asc("place"), F.desc("place")))
    reach = F.greatest(F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1)), "__reach")
    ahead = F.least(F.min("low").over(back.rowsBetween(Window.unboundedPreceding, 0)), "__ahead")
    told = matched(places, known, cell).withColumns({"reach": reach, "ahead": ahead, "last": F.coalesce(F.lag("place").over(w), "__last")})
    parted = F.col("last").isNull() | ((F.col("place") - F.col("last") > DISTANCE) & F.coalesce(F.col("ahead") > F.col("reach"), F.lit(True)))
    cut = told.select(*cell, "place", F.when(parted, F.col("place")).alias("cut"))
    begun = cut.groupBy(*cell).agg(F.max("cut").alias("cut"))
    begun = begun.select(*cell, F.max("cut").over(up).alias("__begun"))
    within = F.max("cut").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return matched(cut, begun, cell).select(*by, "place", F.coalesce(within, "__begun").alias("stretch"))


class _Kept:
    """A case of the fold, with its sections and chunks as ordered sets once others went into it."""

    def __init__(self, row: dict):
        self.row, self.plain, self.twice = row, dict(zip(TOLD, row.pop("__plain"))), dict(zip(TOLD, row.pop("__twice")))
        self.sections, self.chunks = dict.fromkeys(row["sections"]), dict.fromkeys(row["chunks"])
        self.known = set(self.sections) - {None}
        self._measure()

    def _measure(self) -> None:
        self.told, self.size, self.grams = len(" ".join(self.plain[t] for t in TOLD).strip(" ")), len(self.row["summary"]), _grams("".join(self.twice[t] for t in TOLD))

    def rank(self) -> tuple:
        score = self.row["score"]
        return score != score, 0.0 if score != score else score, self.told, self.size

    def place(self) -> tuple:
        return tuple(UNKNOWN if self.row[c] is None else self.row[c] for c in ("ordinal", "position"))

    def near(self, new: _Kept) -> bool:
        """Whether the two are near duplicates: one actor and kind, neighbours, similar."""
        a, b = self.row, new.row
        if a["actor"] != b["actor"] or a["kind"] != b["kind"] or not self.chunks or not new.chunks:
            return False
        overlap = any(x in self.known for x in new.known)
        if not overlap and (a["ordinal"] is None or b["ordinal"] is None or abs(a["ordinal"] - b["ordinal"]) > DISTANCE):
            return False
        if not self.grams or not new.grams:
            return False
        common = len(self.grams & new.grams)
        return common / (len(self.grams) + len(new.grams) - common) >= (ALIKE_OVERLAPPING if overlap else ALIKE)

    def unite(self, new: _Kept) -> None:
        """What _united() gives; sections and chunks are put in order when the case is done."""
        a, b = self.row, new.row
        first, second = (new, self) if new.rank() > self.rank() else (self, new)
        texts = {t: first if not (first.row[t] == "" or (second.row[t] != "" and len(second.row[t]) > len(first.row[t]) + LONGER)) else second for t in TEXTS}
        taken = {t: (x.row[t], x.plain.get(t), x.twice.get(t)) for t, x in texts.items()}
        place = new if new.place() < self.place() else self
        more = {"case_id": first.row["case_id"], "tags": list(dict.fromkeys(first.row["tags"] + second.row["tags"])), "ordinal": place.row["ordinal"], "position": place.row["position"], "merged": a["merged"] + b["merged"] + 1}
        most = {c: max(a[c], b[c], key=lambda x: (x != x, x)) for c in ("score", "priority")}
        self.sections |= new.sections
        self.chunks |= new.chunks
        self.known |= new.known
        a |= more | most | {t: x[0] for t, x in taken.items()} | {"sections": None, "chunks": None}
        for t in TOLD:
            self.plain[t], self.twice[t] = taken[t][1:]
        self._measure()

    def done(self) -> dict:
        for c in ("sections", "chunks"):
            if self.row[c] is None:
                self.row[c] = sorted(getattr(self, c), key=lambda x: (x is None, x or ""))
        return self.row


def _grams(text: str) -> set[str]:
    return {text} if 0 < len(text) <= 2 else {text[i : i + 2] for i in range(len(text) - 1)}


def merged_cases(cases: DataFrame, by: list[str]) -> DataFrame:
    """by (the columns that tell books apart) and the cases after exact and near-duplicate merging; merged counts what went into each, less one.

    A case merges into the nearest of the last LOOK_BACK kept ones that is near, else it is kept itself.
    """
    rows = durable(exact_merged(cases, by))
    place = F.coalesce("ordinal", F.lit(UNKNOWN))
    order = sort_key(F.col("ordinal"), F.col("position"), F.col("actor"), F.col("score")) + [F.col("case_id")]
    plain = F.array(*[comparable(F.col(t)) for t in TOLD])
    held = matched(rows.withColumn("place", place), stretches(rows, by), [*by, "place"])
    # A stretch lies in one task, in order, and is passed through: of it no more than LOOK_BACK cases are held.
    dealt = spread(held, *by, "stretch").sortWithinPartitions(*by, "stretch", *order, _state(held))
    given = dealt.select(*by, "stretch", *STATE, plain.alias("__plain"), F.transform(plain, comparable).alias("__twice"))
    kinds = StructType([given.schema[c] for c in (*by, *STATE)])
    types = to_arrow_schema(kinds)

    def fold(batches):
        import pyarrow as pa

        key, kept, out = None, [], []
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                for row in batch.slice(at, ROWS).to_pylist():
                    of = (*(row[c] for c in by), row.pop("stretch"))
                    if of != key:
                        out += [k.done() for k in kept]
                        key, kept = of, []
                    new = _Kept(row)
                    into = next((k for k in reversed(kept) if k.near(new)), None)
                    if into is not None:
                        into.unite(new)
                    else:
                        kept.append(new)
                        if len(kept) > LOOK_BACK:
                            out.append(kept.pop(0).done())
                if out:
                    yield pa.RecordBatch.from_pylist(out, types)
                    out = []
        out += [k.done() for k in kept]
        if out:
            yield pa.RecordBatch.from_pylist(out, types)

    return given.mapInArrow(fold, kinds)


def consolidated_runs(runs: list[DataFrame], by: list[str]) -> DataFrame:
    """Several extraction runs post-processed as one: columns by name, then merged_cases."""
    every = runs[0]
    for run in runs[1:]:
        every = every.unionByName(run, allowMissingColumns=True)
    return merged_cases(every, by)
