"""Search over structured cases: weighted texts of a case, its lexical scores, fusion with the evidence for each hit, evidence for answers.

A case is a row: case_id, title, summary, conflict, actor, kind, pattern (texts), tags, roles, views (arrays of texts), priority. The texts
that are searched are columns made once (`indexed`). A question is a row: query_id, text, tokens, terms. Questions are few and cases
many, so the questions come to the tasks, in blocks (`retrieval.asked_blocks`): a case is read once, whatever the branches, by one automaton over the terms of all questions and one look-up
for each of its tokens, and a task keeps the best cases of each question. Only those few are made again to be explained. Nothing else is shuffled.

Nulls: a null text is empty, a null list too, a null priority is DEFAULT_PRIORITY. A case without texts scores by its priority alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import lexicon
from scriptorium.functions import tokens as T
from scriptorium.functions.text import compact, shortened, text_or_empty
from scriptorium.sources.store import durable

from .patterns import automaton, contained
from .retrieval import Asking, Best, Naming, asked_blocks, ranked, small_side, spread

DEFAULT_PRIORITY = 0.5
#: Bonus of a long and of a short exact term, their cap, and the weight of the priority, by branch.
SPARSE, DENSE = (1.15, 0.75, 4.8, 0.3), (1.35, 0.9, 5.0, 0.25)
#: What a tag, a role, a view and the kind of a case add, and a phrase of the dense text.
TAG, ROLE, VIEW, KIND, PHRASE = 0.45, 0.4, 0.35, 0.25, 0.8
LONG_TERM, SHOWN_TERMS, FUSED_TERMS = 3, 6, 8
#: Cases that are Python objects, and whose scores are ranked, at once.
CASES = 256
TEXTS, LISTS = ("title", "summary", "conflict", "actor", "kind", "pattern"), ("tags", "roles", "views")


def _joined(parts: list[Column]) -> Column:
    """Filled parts, a line each."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "\n")


def indexed(cases: DataFrame, pattern: str = T.LATIN_TOKEN, keywords: Iterable[str] = ()) -> DataFrame:
    """cases with cleaned fields and, for each branch, its text, the text without blanks, and its tokens.

    The dense text names title and pattern twice, so that they weigh more; the sparse text holds all fields but the pattern.
    """
    empty = F.array().cast("array<string>")
    clean = {c: F.trim(text_or_empty(F.col(c))) for c in TEXTS} | {c: F.coalesce(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != ""), empty) for c in LISTS}
    rows = cases.withColumns(clean | {"priority": F.coalesce(F.nullif(F.col("priority"), F.lit(0.0)), F.lit(DEFAULT_PRIORITY))})
    words = lambda c: F.array_join(c, " ")
    rows = rows.withColumns({
        "dense_text": _joined([F.col(c) for c in ("title", "title", "pattern", "pattern", "summary", "conflict")]),
        "sparse_text": _joined([*(F.col(c) for c in ("title", "summary", "conflict", "actor", "kind")), *(words(F.col(c)) for c in LISTS)]),
    })
    return rows.withColumns({f"{b}_{name}": make for b in ("dense", "sparse") for name, make in (("compact", compact(F.col(f"{b}_text"))), ("tokens", T.tokens(F.col(f"{b}_text"), pattern, keywords)))})


def asked(questions: DataFrame, text: str = "text", noise: Iterable[str] = (), case_noise: Iterable[str] = (), pattern: str = T.LATIN_TOKEN, cjk: bool = False) -> DataFrame:
    """query_id, text, tokens and terms (cleaned, longest first) of the questions."""
    terms = T.clean_terms(T.query_terms(F.col(text), noise, cjk, dense=cjk), case_noise)
    return questions.select("query_id", text_or_empty(F.col(text)).alias("text"), T.tokens(F.col(text), pattern).alias("tokens"), terms.alias("terms"))


def _any_term(terms: Column, text: Column) -> Column:
    return F.exists(terms, lambda t: F.contains(text, t))


def _within(values: Column, text: Column) -> Column:
    return F.filter(values, lambda v: F.contains(text, v))


def _fields(named: dict[str, Column], otherwise: str) -> Column:
    found = F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in named.items()]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(otherwise)))


def sparse_hits(questions: DataFrame, index: DataFrame, limit: int, names: dict[str, str] = lexicon.FIELD_NAMES, template: str = lexicon.REASON) -> DataFrame:
    """query_id, case_id, score, terms, fields, reason and rank: the `limit` best cases by tokens, terms, tags, roles, views, kind and priority."""
    return branches(questions, index, limit, names, template, ("sparse",))["sparse"]


def dense_text_hits(questions: DataFrame, index: DataFrame, limit: int, names: dict[str, str] = lexicon.FIELD_NAMES, template: str = lexicon.REASON) -> DataFrame:
    """As sparse_hits, over the dense text: what stands in for a vector search where there is none."""
    return branches(questions, index, limit, names, template, ("dense",))["dense"]


def branches(questions: DataFrame, index: DataFrame, limit: int, names: dict[str, str] = lexicon.FIELD_NAMES, template: str = lexicon.REASON, of: tuple[str, ...] = ("sparse", "dense"), only: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """sparse_hits and dense_text_hits by name, from one pass over the cases. only: the index of given cases alone (case_id), where that is less work than to take them from the index."""
    question, hit = F.col("question"), F.col("hit")
    viewed = F.exists("views", lambda v: _any_term(hit, v))
    of_kind = (F.col("kind") != "") & F.contains(question, F.col("kind"))
    named = lambda c: F.size(_within(F.col(c), question))
    fields = {
        "sparse": _fields({names["detail"]: F.size(hit) > 0, names["tag"]: named("tags") > 0, names["role"]: named("roles") > 0, names["view"]: viewed, names["kind"]: of_kind}, names["sparse"]),
        "dense": dense_fields(hit, names),
    }
    best = durable(_best(questions, index, of, limit))  # `limit` cases a question, branch and task
    top = {b: ranked(best.where(F.col("branch") == b).drop("branch"), "query_id", "case_id", "score", limit).where("score > 0") for b in of}
    met = _hit(reduce(lambda a, b: a.union(b), [rows.select("case_id") for rows in top.values()]), index, only)
    return {b: _explained(rows, questions, met, f"{b}_compact", fields[b], template) for b, rows in top.items()}


def vector_hits(questions: DataFrame, index: DataFrame, scores: DataFrame, limit: int, names: dict[str, str] = lexicon.FIELD_NAMES, template: str = lexicon.REASON) -> DataFrame:
    """The same columns from the scores (query_id, case_id, score) of a vector search."""
    best = durable(ranked(scores.select("query_id", "case_id", F.round("score", 4).alias("score")), "query_id", "case_id", "score", limit).where("score > 0"))
    return _explained(best, questions, _hit(best, index), "dense_compact", dense_fields(F.col("hit"), names), template)


def dense_fields(terms: Column, names: dict[str, str] = lexicon.FIELD_NAMES) -> Column:
    # An expression inside a lambda is worked out for each term, so the texts are bound to values first.
    texts = F.array(F.struct(compact(F.col("pattern")).alias("pattern"), compact(F.col("title")).alias("title")))
    return F.transform(texts, lambda x: _fields({names["pattern"]: _any_term(terms, x["pattern"]), names["title"]: _any_term(terms, x["title"])}, names["dense"]))[0]


def _with_hit(rows: DataFrame, index: DataFrame, questions: DataFrame, text: str) -> DataFrame:
    """`hit`: the question's terms that the case's text without blanks holds. A term that any field holds is among them, so all else is asked of these few. A text is read once for all
    questions, as one long case may be the best for most of them."""
    terms = questions.select("query_id", F.posexplode("terms").alias("at", "pattern"))
    held = contained(index, "case_id", text, terms, "pattern")
    hits = rows.select("query_id", "case_id").join(small_side(terms), "query_id").join(held, ["case_id", "pattern"])
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "pattern"))), lambda x: x["pattern"])  # no more than the question has
    found = rows.join(hits.groupBy("query_id", "case_id").agg(listed.alias("hit")), ["query_id", "case_id"], "left")
    return found.withColumn("hit", F.coalesce("hit", F.array().cast("array<string>")))


class _Asked:
    """A block of questions, by term, by token, and by what their texts contain."""

    def __init__(self, rows: list[dict]):
        import numpy as np

        self.ids, self.terms, self.tokens, self.naming = [r["query_id"] for r in rows], Asking(r["terms"] for r in rows), Asking(r["tokens"] for r in rows), Naming([r["text"] for r in rows])
        self.long = np.array([len(t) >= LONG_TERM for t in self.terms.values], bool)

    def holding(self, texts: list[str]):
        """Rows of texts and places of the terms that they hold."""
        import numpy as np

        if not self.terms.values:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        look = automaton(self.terms.values)
        each = [{i for _, i in look.iter(text)} for text in texts]
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        return np.repeat(np.arange(len(texts)), sizes), np.fromiter(chain.from_iterable(each), np.int64, sizes.sum())

    def scores(self, part, branch: str):
        """Cases x questions: shared tokens, capped terms and priority; sparse: with tags, roles and kinds that the question names, and views that hold one of its terms; dense: with a
        long term as it stands in the text."""
        import numpy as np
        import pyarrow.compute as pc

        n, (long, short, cap, weight) = part.num_rows, SPARSE if branch == "sparse" else DENSE
        column = lambda name: part.column(part.schema.get_field_index(name))
        rows, codes = self.holding(column(f"{branch}_compact").to_pylist())
        is_long = self.long[codes]
        bonus = long * self.terms.tallied(rows[is_long], codes[is_long], n) + short * self.terms.tallied(rows[~is_long], codes[~is_long], n)
        total = np.log1p(self.tokens.tallied(*self.tokens.met(column(f"{branch}_tokens")), n)) + np.minimum(cap, bonus)
        if branch == "sparse":
            for name, worth in (("tags", TAG), ("roles", ROLE)):
                self.naming.added(total, column(name).to_pylist(), worth)
            self.naming.added(total, ([kind] for kind in column("kind").to_pylist()), KIND)
        texts = column("views" if branch == "sparse" else "phrases")
        of, (rows, codes) = pc.list_parent_indices(texts).to_numpy(), self.holding(texts.flatten().to_pylist())
        if branch == "dense":
            rows, codes = rows[self.long[codes]], codes[self.long[codes]]
        held, first = np.zeros((n, self.terms.n)), np.flatnonzero(np.diff(of, prepend=-1))
        if len(first):
            held[of[first]] = np.add.reduceat((self.terms.tallied(rows, codes, len(of)) > 0).astype(float), first)
        return total + (VIEW * held if branch == "sparse" else PHRASE * (held > 0)) + column("priority").to_numpy(zero_copy_only=False)[:, None] * weight


def _best(questions: DataFrame, index: DataFrame, of: tuple[str, ...], limit: int) -> DataFrame:
    """branch, query_id, case_id and score of cases among which are the `limit` best of each branch."""
    # A term holds no line break, so what the dense text holds is what one of its parts holds.
    more = {"sparse": ["tags", "roles", "views", "kind"], "dense": [F.array_distinct(F.array("title", "pattern", "summary", "conflict")).alias("phrases")]}
    given = spread(index, "case_id").select("case_id", "priority", *[c for b in of for c in (f"{b}_compact", f"{b}_tokens", *more[b])])
    kinds = questions.schema["query_id"].dataType.simpleString(), index.schema["case_id"].dataType.simpleString()

    def against(block: list[dict]) -> DataFrame:
        def run(batches):
            import numpy as np
            import pyarrow as pa

            asked = _Asked(block)
            best = {b: Best(len(block), limit) for b in of}
            for batch in batches:
                for at in range(0, batch.num_rows, CASES):
                    part = batch.slice(at, CASES)
                    for b in of:
                        best[b].add(np.floor(asked.scores(part, b) * 1e4 + 0.5), part.column(0).to_pylist())
            found = [{"branch": b, "query_id": q, "case_id": i, "score": s / 1e4} for b in of for q, kept in zip(asked.ids, best[b].kept) for s, i, _ in kept]
            if found:
                yield pa.RecordBatch.from_pylist(found)

        return given.mapInArrow(run, f"branch string, query_id {kinds[0]}, case_id {kinds[1]}, score double")

    none = questions.sparkSession.createDataFrame([], f"branch string, query_id {kinds[0]}, case_id {kinds[1]}, score double")
    return reduce(lambda a, b: a.union(b), [against(block) for block in asked_blocks(questions.select("query_id", "text", "tokens", "terms"), "query_id")] or [none])


def _explained(best: DataFrame, questions: DataFrame, index: DataFrame, text: str, fields: Column, template: str) -> DataFrame:
    """The few best hits with what explains them. index: the cases that were hit, at least."""
    rows = _with_hit(index.join(best, "case_id").join(small_side(questions.withColumnRenamed("text", "question")), "query_id"), index, questions, text)
    shown = rows.withColumns({"found_terms": F.slice("hit", 1, SHOWN_TERMS), "fields": fields})
    return shown.select("query_id", "case_id", "score", F.col("found_terms").alias("terms"), "fields", reason(F.col("fields"), F.col("found_terms"), template).alias("reason"), "rank")


def _hit(best: DataFrame, index: DataFrame, only: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The index of the cases that were hit, a few a question, so that all else is not made again."""
    ids = small_side(best.select("case_id").distinct())
    return durable(only(ids) if only else index.join(ids, "case_id", "left_semi"))


def reason(fields: Column, terms: Column, template: str = lexicon.REASON) -> Column:
    """Why a case was found: its fields, the terms that were met (its kind without any), its pattern or what else tells most."""
    pattern = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("pattern", "summary", "title")], F.lit(""))
    told = {"fields": F.array_join(F.slice(fields, 1, 3), lexicon.COMMA), "terms": F.when(F.size(terms) > 0, F.array_join(F.slice(terms, 1, 4), lexicon.COMMA)).otherwise(F.col("kind")), "pattern": F.when(F.length(pattern) > 88, F.concat(F.left(pattern, F.lit(88)), F.lit("..."))).otherwise(pattern)}
    out = F.lit(template)
    for name, value in told.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), value)
    return out


def fused(branches: dict[str, DataFrame], limit: int, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of hits: summed score, terms of all branches (the FUSED_TERMS longest), sorted fields, the first branch's reason, rank."""
    every = reduce(lambda a, b: a.unionByName(b), [rows.withColumn("branch", F.lit(i)) for i, rows in enumerate(branches.values())])
    sums = every.groupBy("query_id", "case_id").agg(
        F.round(F.sum(1 / (k + F.col("rank"))), 6).alias("score"), F.flatten(F.collect_list("terms")).alias("terms"), F.flatten(F.collect_list("fields")).alias("fields"),
        F.min_by("reason", "branch").alias("reason"), F.max("score").alias("best_score"),
    )  # one row a branch, so the lists are short
    shown = sums.withColumns({"terms": F.slice(T.clean_terms(F.col("terms")), 1, FUSED_TERMS), "fields": F.array_sort(F.array_distinct("fields"))})
    return ranked(shown, "query_id", "case_id", "score", limit)


def mapping_reason(scene: Column, topics: Column, rules=lexicon.MAPPING_REASONS, otherwise: str = lexicon.MAPPING_OTHERWISE) -> Column:
    """The text of the first rule (scenes, topics, text) whose scenes hold the scene and whose topics meet those given."""
    texts = F.array_compact(F.array(*[
        F.when(scene.isin(scenes) & F.arrays_overlap(topics, F.array(*[F.lit(t) for t in wanted])), F.lit(text)) for scenes, wanted, text in rules
    ]))
    return F.coalesce(F.get(texts, F.lit(0)), F.lit(otherwise))


def lookup_answer(texts: Column, missing: str, most: int = 220) -> Column:
    """The shortened first text of a look-up, or what says that there is none."""
    return F.when(F.size(texts) > 0, shortened(F.get(texts, F.lit(0)), most)).otherwise(F.lit(missing))
