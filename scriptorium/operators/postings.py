"""An inverted index that is stored, and exact rankings from it.

Items are dealt into blocks of BLOCK neighbours, as they lie in their partition. A posting is a row (block, term): the items of the block that hold the term, how
often, and their lengths, with the largest frequency and the smallest length. `terms` has the document frequencies.

Search. The postings of the questions' terms meet the questions by a broadcast and are dealt by block. A task goes through its blocks and keeps the
k best items of each question; what a question's terms could add up to in a block, by the largest frequencies and smallest lengths,
is compared with its k-th best score so far, and a block that cannot reach it is not scored for that question. What a task has kept is ranked at the end. Nothing
is lost, ties included: bounds are rounded like scores. A ranking may use any sums over shared terms, as long as more never scores less.

Scale. Making an index is a map: the corpus is tokenized once, where it lies; only document frequencies are shuffled, pre-added. A search reads the index instead of
texts, shuffles the postings of its own terms, and k items a question and task. A block's state is questions x BLOCK numbers, so questions are a
stated, small set (`retrieval`); a term that all items hold is spread over all blocks.

Nulls: an item without tokens counts as an item of length 0 and has no postings; a null item id is an item. Repeated ids are items of their own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.sources.store import durable, fingerprint, stored

from .retrieval import BROADCAST_ROWS, ranked

BLOCK = 1024
#: Terms of a block that are added up at once.
TERMS = 512
#: Saturation of the term frequency, and weight of the length.
K1, B = 1.2, 0.75
#: A bound may be this much below a sum of the same numbers in another order.
SLACK = 1e-9


@dataclass(frozen=True)
class Index:
    postings: DataFrame  # block, term, items, places (of the items in the block), tfs, lengths, most (largest tf), least (smallest length)
    terms: DataFrame  # term, df
    n: int
    mean: float

    def idf(self, df: Column) -> Column:
        return F.log1p((F.lit(float(self.n)) - df + 0.5) / (df + 0.5))


def made(corpus: DataFrame, item: str, tokens: Column, gap: str | None = None) -> DataFrame:
    """The postings of corpus by block, and for each block a row without a term that counts its items and tokens. tokens: an array column, repeats included; with
    gap a text column, whose tokens are what lies between the matches of this pattern (RE2). Then texts, not lists of words, come to the tasks."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                if gap is None:
                    lists = part.column(1).fill_null(pa.scalar([], part.column(1).type))
                    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                    coded = lists.flatten().dictionary_encode()
                else:
                    lists = pc.split_pattern_regex(part.column(1).fill_null(""), gap)
                    words = lists.flatten()
                    filled = pc.not_equal(words, "")
                    lengths = np.bincount(pc.list_parent_indices(lists).filter(filled).to_numpy(), minlength=part.num_rows)
                    coded = words.filter(filled).dictionary_encode()
                code, names = coded.indices.to_numpy(), coded.dictionary
                place = np.repeat(np.arange(part.num_rows), lengths)
                key, tf = np.unique(code.astype(np.int64) * BLOCK + place, return_counts=True)
                term, place = key // BLOCK, key % BLOCK
                starts = np.flatnonzero(np.diff(term, prepend=-1))
                offsets = pa.array(np.append(starts, len(term)), pa.int32())
                listed = lambda values, kind: pa.ListArray.from_arrays(offsets, values if isinstance(values, pa.Array) else pa.array(values, kind))
                ends = lambda f, values: pa.array(f.reduceat(values, starts) if len(starts) else values, pa.int32())
                columns = [
                    pa.array(np.full(len(starts), number), pa.int64()), names.take(pa.array(term[starts])), listed(part.column(0).take(pa.array(place)), None), listed(place, pa.int32()), listed(tf, pa.int32()), listed(lengths[place], pa.int32()),
                    ends(np.maximum, tf), ends(np.minimum, lengths[place]), pa.nulls(len(starts), pa.int64()), pa.nulls(len(starts), pa.int64()),
                ]
                fields = ["block", "term", "items", "places", "tfs", "lengths", "most", "least", "n", "tokens"]
                yield pa.RecordBatch.from_arrays(columns, names=fields)
                told = [pa.array([number]), *(pa.nulls(1, c.type) for c in columns[1:8]), pa.array([part.num_rows]), pa.array([int(lengths.sum())])]
                yield pa.RecordBatch.from_arrays(told, names=fields)
                number += 1

    rows = corpus.select(F.col(item).alias("item"), tokens.alias("tokens"))
    kind = rows.schema["item"].dataType.simpleString()
    return rows.mapInArrow(run, f"block long, term string, items array<{kind}>, places array<int>, tfs array<int>, lengths array<int>, most int, least int, n long, tokens long")


def index(corpus: DataFrame, item: str, tokens: Column, name: str, gap: str | None = None) -> Index:
    """The index of corpus, made when it is first asked for and found again in the shared folder from then on. name: what tells its tokens apart; gap: as in made()."""
    spark = corpus.sparkSession
    told = f"{fingerprint(corpus)}|{name}|{item}|{gap}"
    postings = stored(spark, "postings", told, lambda: {"postings": made(corpus, item, tokens, gap)})["postings"]

    def counts() -> dict[str, DataFrame]:
        return {"terms": postings.where("term is not null").groupBy("term").agg(F.sum(F.size("items")).alias("df")), "stats": postings.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("tokens") / F.sum("n"), F.lit(0.0)).alias("mean"))}

    found = stored(spark, "terms", told, counts)
    stats = found["stats"].first()
    return Index(postings.where("term is not null").drop("n", "tokens"), found["terms"], stats["n"], stats["mean"])


def rankings(
    questions: DataFrame, of: Index, own: dict[str, Column], sums: dict[str, Callable[..., np.ndarray]], scores: dict[str, tuple[Callable[..., np.ndarray], Column]], k: int,
    query: str = "query_id", item: str = "item_id", digits: int = 4,
) -> dict[str, DataFrame]:
    """By name of a score: query, item, the sums, score (rounded) and rank of the k best items of each question that share a term with it; ties to the smaller item.

    questions: query, terms (array without repeats). own: columns of a question's term, by `term` and its `df`. sums: name to what a shared term adds, a
    function of its own columns, the term's frequency in the item and the item's length (more frequent or shorter never adds less). scores: functions of the sums, never less if one
    of them is more, and the same as column expressions. All rankings come from one pass over the postings.
    """
    exploded = durable(questions.select(query, F.explode("terms").alias("term")))
    asked = durable((of.terms.join(F.broadcast(exploded), "term") if exploded.count() <= BROADCAST_ROWS else of.terms.join(exploded, "term")).withColumns(own))
    by_term = asked.groupBy("term").agg(*[F.collect_list(c).alias(f"q_{c}") for c in (query, *own)])  # no more than there are questions
    met = of.postings.join(F.broadcast(by_term) if asked.count() <= BROADCAST_ROWS else by_term, "term").repartition("block").sortWithinPartitions("block")
    names, fields, functions = list(sums), [*own], [f for f, _ in scores.values()]
    scale = 10.0**digits

    def run(batches):
        import pyarrow as pa

        best: dict = {}  # (ranking, question): (scores, items, sums) of its k best so far
        kinds = None

        def rounded(values):
            return np.floor(values * scale + 0.5)

        def finish(parts):
            import pyarrow.compute as pc

            flat = lambda i: np.concatenate([pc.list_flatten(p.column(i)).to_numpy(zero_copy_only=False) for p in parts])
            sizes = lambda i: np.concatenate([pc.list_value_length(p.column(i)).to_numpy(zero_copy_only=False) for p in parts])
            plain = lambda i: np.concatenate([p.column(i).to_numpy(zero_copy_only=False) for p in parts]).astype(float)
            _, one, place = np.unique(flat(2), return_index=True, return_inverse=True)
            items, held_by, tfs, lengths = flat(1)[one], sizes(1), flat(3).astype(float), flat(4).astype(float)
            asking, query_place = np.unique(flat(7), return_inverse=True)
            asked_by = sizes(7)
            # What a term adds is the same for all its questions, so sums are products of a matrix of questions and terms with one of terms and items.
            at, q_at = np.cumsum([0, *held_by]), np.cumsum([0, *asked_by])
            own_columns = [flat(i)[q_at[:-1]] for i in range(8, 8 + len(fields))]
            most, least = plain(5), plain(6)
            spans = [range(t, min(t + TERMS, len(held_by))) for t in range(0, len(held_by), TERMS)]

            def asked_in(span):
                m = np.zeros((len(asking), len(span)))
                m[query_place[q_at[span.start] : q_at[span.stop]], np.repeat(np.arange(len(span)), asked_by[span.start : span.stop])] = 1
                return m

            bounds = np.zeros((len(names), len(asking)))
            for span in spans:
                m, of = asked_in(span), slice(span.start, span.stop)
                for i, name in enumerate(names):
                    bounds[i] += m @ sums[name](*(c[of] for c in own_columns), most[of], least[of])
            limits = [np.array([best[r, q][0][-1] if (r, q) in best and len(best[r, q][0]) >= k else -np.inf for q in asking]) for r in range(len(functions))]
            each = [rounded(f(*bounds) + SLACK) >= limit for f, limit in zip(functions, limits)]
            if not np.logical_or.reduce(each).any():
                return
            total = np.zeros((len(names), len(asking), len(items)))
            held = np.zeros((len(asking), len(items)), bool)
            for span in spans:
                m, of = asked_in(span), slice(at[span.start], at[span.stop])
                row = np.repeat(np.arange(len(span)), held_by[span.start : span.stop])
                added = np.zeros((len(span), len(items)))
                added[row, place[of]] = 1
                held |= m @ added > 0
                for i, name in enumerate(names):
                    added[row, place[of]] = sums[name](*(c[span.start : span.stop][row] for c in own_columns), tfs[of], lengths[of])
                    total[i] += m @ added
            for r, (f, limit, open_) in enumerate(zip(functions, limits, each)):
                found_scores = np.where(held, rounded(f(*total)), -np.inf)
                for i in np.flatnonzero(open_):
                    found = np.flatnonzero(found_scores[i] >= max(limit[i], -1e300))
                    if len(found):
                        before = best.get((r, asking[i]))
                        s, n, x = found_scores[i, found], items[found], total[:, i, found]
                        if before is not None:
                            s, n, x = np.append(before[0], s), np.append(before[1], n), np.append(before[2], x, axis=1)
                        order = np.lexsort((n, -s))[:k]
                        best[r, asking[i]] = s[order], n[order], x[:, order]

        block, parts = None, []
        for batch in batches:
            kinds = kinds or (batch.schema.field(1).type.value_type, batch.schema.field(7).type.value_type)
            numbers = batch.column(0).to_numpy()
            starts = [*np.flatnonzero(np.diff(numbers, prepend=numbers[:1] - 1)), len(numbers)] if len(numbers) else []
            for start, end in zip(starts, starts[1:]):
                if parts and numbers[start] != block:
                    finish(parts)
                    parts = []
                block = numbers[start]
                parts.append(batch.slice(start, end - start))
        if parts:
            finish(parts)
        if best:
            asking = [key for key, x in best.items() for _ in x[1]]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in asking], pa.int32()), pa.array([q for _, q in asking], kinds[1]), pa.array(np.concatenate([x[1] for x in best.values()]), kinds[0]), *(pa.array(np.concatenate([x[2][i] for x in best.values()])) for i in range(len(names)))], names=["ranking", query, item, *names])

    kind = lambda rows, c: rows.schema[c].dataType.simpleString()
    given = met.select("block", "items", "places", "tfs", "lengths", "most", "least", f"q_{query}", *[f"q_{c}" for c in fields])
    found = given.mapInArrow(run, f"ranking int, {query} {kind(asked, query)}, {item} {of.postings.schema['items'].dataType.elementType.simpleString()}, {', '.join(f'{n} double' for n in names)}")
    found = durable(found)  # k items a question, task and ranking, so that who reads them twice has one pass
    return {name: ranked(found.where(F.col("ranking") == r).drop("ranking").withColumn("score", F.round(shown, digits)), query, item, "score", k) for r, (name, (_, shown)) in enumerate(scores.items())}


def top(questions: DataFrame, of: Index, own: dict[str, Column], sums: dict[str, Callable[..., np.ndarray]], k: int, query: str, item: str) -> DataFrame:
    """One ranking by a single sum."""
    return rankings(questions, of, own, sums, {"": (lambda total: total, F.col("total"))}, k, query, item)[""].select(query, item, "score", "rank")


def bm25(questions: DataFrame, of: Index, k: int, query: str = "query_id", item: str = "item_id", k1: float = K1, b: float = B) -> DataFrame:
    """query, item, score, rank by BM25. questions: query, terms (array without repeats)."""
    mean = max(of.mean, 1e-300)

    def worth(weight, tf, length):
        return weight * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean)))

    return top(questions, of, {"weight": of.idf(F.col("df"))}, {"total": worth}, k, query, item)


def overlaps(questions: DataFrame, of: Index, k: int, query: str = "query_id", item: str = "item_id", long_bonus: float = 1.35, short_bonus: float = 0.9, cap: float = 4.5, priority: float = 0.5, priority_weight: float = 0.35, noise: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """`scored`: query, item, overlap, score, rank as retrieval.lexical_scores ranks items of one priority; `overlap`: the same by the number of shared tokens."""
    worth = F.when(F.col("term").isin(list(noise)), 0.0).when(F.length("term") >= 3, long_bonus).when(F.length("term") == 2, short_bonus).otherwise(0.0)
    sums = {"overlap": lambda w, tf, length: np.ones(np.broadcast(w, tf).shape), "bonus": lambda w, tf, length: w + np.zeros_like(tf)}
    scores = {
        "scored": (lambda n, bonus: np.log1p(n) + np.minimum(cap, bonus) + priority * priority_weight, F.log1p("overlap") + F.least(F.lit(cap), "bonus") + priority * priority_weight),
        "overlap": (lambda n, bonus: n, F.col("overlap")),
    }
    found = rankings(questions, of, {"worth": worth}, sums, scores, k, query, item)
    return {name: rows.select(query, item, F.col("overlap").cast("long").alias("overlap"), "score", "rank") for name, rows in found.items()}


def by_label(questions: DataFrame, of: Index, k: int, kinds: dict[str, float], query: str = "query_id", item: str = "item_id") -> DataFrame:
    """query, item, score, rank: items by the labels they share, rare ones first; kinds: what a label's beginning is worth (others: 1)."""
    worth = F.lit(1.0)
    for start, value in kinds.items():
        worth = F.when(F.startswith("term", F.lit(start)), value).otherwise(worth)
    return top(questions, of, {"weight": of.idf(F.col("df")) * worth}, {"total": lambda w, tf, length: w + np.zeros_like(tf)}, k, query, item)
