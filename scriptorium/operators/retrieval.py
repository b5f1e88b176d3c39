"""Retrieval: lexical and dense ranking, fusion of rankings, expansion of hits to their evidence.

Questions and corpus are both tables; every operator answers all questions at once. Questions are a stated, small set: they are
counted, and go to all executors up to a bound (beyond it by a shuffle), so the corpus is shuffled at most once, by item, whatever
the number of questions; partial top-k rankings are kept before anything is shuffled by question. Rankings break ties by the
corpus ordinal.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from scriptorium.functions import tokens as T
from scriptorium.functions.text import text_or_empty, words_in
from scriptorium.sources.store import durable


#: Tokens, or vectors, of questions that may be sent to all executors (some 20 MB); more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Vectors of a block, and pairs that are added up at once.
VECTORS, PAIRS = 1024, 500_000
#: Questions that meet an item at once, and texts that are split into words at once.
QUESTIONS, TEXTS = 2_000, 256


def small_side(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """rows, to be sent to all executors if they are at most `most`."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def spread(rows: DataFrame, *key: str) -> DataFrame:
    """rows dealt by a key to at least as many tasks as there are cores: what follows costs far more time than its bytes suggest."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *key)


def ranked(scores: DataFrame, query: str, item: str, score: str, limit: int) -> DataFrame:
    """The `limit` best items of each query: highest score, then smallest item."""
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), F.asc(item)))
    return scores.withColumn("rank", place).where(F.col("rank") <= limit)


def lexical_scores(
    queries: DataFrame, corpus: DataFrame, query: str = "query_id", item: str = "item_id", long_bonus: float = 1.35, short_bonus: float = 0.9, cap: float = 4.5,
    priority_weight: float = 0.35, digits: int = 4, noise: Iterable[str] = (), tag_weight: float = 0.25,
) -> DataFrame:
    """query, item, overlap and score = ln(1 + overlap) + capped bonus of exact terms + priority.

    queries: query, tokens (array). corpus: item, tokens (array), priority. A shared token of at least two characters that is no
    noise is an exact term; it counts long_bonus from three characters on, else short_bonus. Where the corpus has tags (array) and the queries have a text, each tag that
    the text contains adds tag_weight.
    """
    asked = queries.select(F.col(query), F.explode("tokens").alias("token"))
    # Once dealt by item, the token join and the sums per (question, item) need no further shuffle.
    tagged = ["tags"] if "tags" in corpus.columns and "text" in queries.columns else []
    held = spread(corpus.select(F.col(item), "priority", "tokens", *tagged), item).select(item, "priority", *tagged, F.explode("tokens").alias("token"))
    worth = F.when(F.length("token") >= 3, long_bonus).when(F.length("token") == 2, short_bonus).otherwise(0.0)
    if noise := list(noise):
        worth = F.when(F.col("token").isin(noise), 0.0).otherwise(worth)
    shared = held.join(small_side(asked), "token").groupBy(query, item).agg(F.count("*").alias("overlap"), F.sum(worth).alias("bonus"), F.first("priority").alias("priority"), *[F.first("tags").alias("tags") for _ in tagged])
    score = F.log1p(F.col("overlap").cast("double")) + F.least(F.lit(cap), "bonus") + F.col("priority") * priority_weight
    if tagged:
        shared = shared.join(small_side(queries.select(query, F.col("text").alias("__text"))), query)
        score = score + tag_bonus(F.col("tags"), F.col("__text"), tag_weight)
    return shared.select(query, item, "overlap", F.round(score, digits).alias("score"))


class Asking:
    """Questions of a block, as places, by the values (tokens, terms) that they have."""

    def __init__(self, lists: Iterable[Iterable[str] | None]):
        import numpy as np

        of: dict[str, list[int]] = {}
        self.n = 0
        for values in lists:
            for value in dict.fromkeys(values or ()):
                if value:
                    of.setdefault(value, []).append(self.n)
            self.n += 1
        self.values = tuple(of)
        self.sizes = np.array([len(x) for x in of.values()], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.places = np.array([q for x in of.values() for q in x], np.int64)

    def met(self, lists):
        """Rows of an Arrow array of lists and places of the values that they hold, each pair once."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        codes, rows = pc.index_in(lists.flatten(), pa.array(self.values, pa.string())), pc.list_parent_indices(lists)
        some = pc.is_valid(codes)
        pairs = np.unique(rows.filter(some).to_numpy().astype(np.int64) * max(1, len(self.values)) + codes.filter(some).to_numpy())
        return np.divmod(pairs, max(1, len(self.values)))

    def tallied(self, rows, codes, n: int):
        """For each of n rows and each question, how many of the row's values (pairs of a row and the place of a value) the question has."""
        import numpy as np

        total, sizes = np.zeros(n * self.n), self.sizes[codes]
        ends = np.cumsum(sizes)
        cuts = np.unique([0, *np.searchsorted(ends, np.arange(PAIRS, ends[-1] if len(ends) else 0, PAIRS)), len(codes)])
        for at, end in zip(cuts, cuts[1:]):
            size = sizes[at:end]
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - self.starts[codes[at:end]], size)
            total += np.bincount(np.repeat(rows[at:end], size) * self.n + self.places[place], minlength=len(total))
        return total.reshape(n, self.n)


class Naming:
    """Which questions contain a value."""

    def __init__(self, texts: list[str]):
        self.texts, self.every, self.known = texts, "\n".join(texts), {}

    def __call__(self, value: str):
        import numpy as np

        if value not in self.known:
            if len(self.known) > 10_000:
                self.known.clear()
            self.known[value] = np.array([value in text for text in self.texts], float) if value and value in self.every else None
        return self.known[value]

    def added(self, total, lists: Iterable[Iterable[str] | None], worth: float) -> None:
        """Adds to total (rows x questions) what each value of a row's list is worth to the questions that contain it."""
        for row, values in enumerate(lists):
            for value in values or ():
                if value is not None and (named := self(value)) is not None:
                    total[row] += worth * named


class Best:
    """The `limit` items of each question with the highest keys so far, ties to the smaller item."""

    def __init__(self, questions: int, limit: int):
        import numpy as np

        self.limit, self.least, self.kept = limit, np.full(questions, -np.inf), [[] for _ in range(questions)]

    def add(self, keys, items: list, beside=None) -> None:
        """keys: rows x questions (-inf: no hit); items: those of the rows; beside: as keys, a number that is kept with them."""
        import numpy as np

        open_ = (keys >= self.least) & (keys > -np.inf)
        for q in np.flatnonzero(open_.any(0)):
            at = np.flatnonzero(open_[:, q])
            if len(at) > self.limit:
                at = at[keys[at, q] >= np.partition(keys[at, q], -self.limit)[-self.limit]]
            found = [(float(keys[i, q]), items[i], 0 if beside is None else int(beside[i, q])) for i in at]
            self.kept[q] = sorted([*self.kept[q], *found], key=lambda x: (-x[0], x[1] is None, x[1]))[: self.limit]
            if len(self.kept[q]) == self.limit:
                self.least[q] = self.kept[q][-1][0]


def asked_blocks(questions: DataFrame, query: str) -> list[list[dict]]:
    """The questions, a stated set, in blocks of about QUESTIONS."""
    blocks = max(1, -(-questions.count() // QUESTIONS))
    of_block = (questions.where(F.pmod(F.xxhash64(query), F.lit(blocks)) == n).collect() for n in range(blocks))
    return [[r.asDict() for r in rows] for rows in of_block if rows]


def text_ranked(
    queries: DataFrame, corpus: DataFrame, texts: dict[str, str], limit: int, query: str = "query_id", item: str = "item_id", kind: str | None = None, gap: str = T.LATIN_GAP, pattern: str = T.LATIN_TOKEN,
    long_bonus: float = 1.35, short_bonus: float = 0.9, cap: float = 4.5, priority_weight: float = 0.35, digits: int = 4, noise: Iterable[str] = (), tag_weight: float = 0.25,
) -> DataFrame:
    """query, item, overlap, score, rank: what ranked(lexical_scores(...), limit) gives where the corpus has texts in place of tokens.

    texts: text columns of the corpus by name; a question searches the one that its column `kind` names (None: there is one text). A null or empty text holds nothing. What lies between
    the matches of `gap` (RE2) are the tokens that `pattern` finds. Items have a priority that is not null.

    The questions, a stated set, come to the tasks in blocks. A text is split once where it lies, only the words that are asked for are looked at, and a task keeps `limit`
    items of each question: no text and no token is shuffled. Only items that share an id, which count as one, go through lexical_scores.
    """
    noise, tagged = set(noise), ["tags"] if "tags" in corpus.columns and "text" in queries.columns else []
    kinds = queries.schema[query].dataType.simpleString(), corpus.schema[item].dataType.simpleString()
    slim = queries.select(query, "tokens", *(["text"] if tagged else []), F.lit(next(iter(texts))).alias("kind") if kind is None else F.col(kind).alias("kind")).where(F.col("kind").isin(list(texts)))
    none = slim.sparkSession.createDataFrame([], f"{query} {kinds[0]}, {item} {kinds[1]}, overlap long, score double")
    blocks = asked_blocks(slim, query)
    if not blocks:
        return ranked(none, query, item, "score", limit)
    again = durable(corpus.groupBy(item).agg(F.count("*").alias("n")).where(f"n > 1 or {item} is null").select(item))
    repeated = not again.isEmpty()
    given = corpus.where(F.col(item).isNotNull()).join(again, item, "left_anti") if repeated else corpus
    given = given.select(item, "priority", *(tagged or [F.lit(None).cast("array<string>").alias("tags")]), *[text_or_empty(F.col(c)).alias(f"text_{i}") for i, c in enumerate(texts.values())])

    def against(block: list[dict]) -> DataFrame:
        def run(batches):
            import numpy as np
            import pyarrow as pa
            import pyarrow.compute as pc

            searches = []
            for i, name in enumerate(texts):
                rows = [r for r in block if r["kind"] == name]
                asking = Asking(r["tokens"] for r in rows)
                worth = np.array([0.0 if t in noise else long_bonus if len(t) >= 3 else short_bonus if len(t) == 2 else 0.0 for t in asking.values])
                searches.append((3 + i, [r[query] for r in rows], asking, worth, Naming([r.get("text") or "" for r in rows]), Best(len(rows), limit)))
            searches = [x for x in searches if x[1]]
            for batch in batches:
                for at in range(0, batch.num_rows, TEXTS):
                    part = batch.slice(at, TEXTS)
                    items, priority, tags = part.column(0).to_pylist(), part.column(1).to_numpy(zero_copy_only=False), part.column(2).to_pylist()
                    for column, _, asking, worth, naming, best in searches:
                        rows, codes = asking.met(pc.split_pattern_regex(part.column(column), gap))
                        overlap, bonus = np.zeros((part.num_rows, asking.n)), np.zeros((part.num_rows, asking.n))
                        for each in np.unique(worth):
                            some = worth[codes] == each
                            shared = asking.tallied(rows[some], codes[some], part.num_rows)
                            overlap += shared
                            bonus += each * shared
                        score = np.log1p(overlap) + np.minimum(cap, bonus) + (priority * priority_weight)[:, None]
                        if tagged:
                            naming.added(score, tags, tag_weight)
                        best.add(np.where(overlap > 0, np.floor(score * 10.0**digits + 0.5), -np.inf), items, overlap)
            for _, ids, _, _, _, best in searches:
                found = [{query: q, item: i, "overlap": n, "score": s / 10.0**digits} for q, kept in zip(ids, best.kept) for s, i, n in kept]
                if found:
                    yield pa.RecordBatch.from_pylist(found, pa.schema([(query, kinds_of[0]), (item, kinds_of[1]), ("overlap", pa.int64()), ("score", pa.float64())]))

        return given.mapInArrow(run, f"{query} {kinds[0]}, {item} {kinds[1]}, overlap long, score double")

    kinds_of = to_arrow_type(queries.schema[query].dataType), to_arrow_type(corpus.schema[item].dataType)
    parts = [against(block) for block in blocks]
    if repeated:
        shared = corpus.join(again, item, "left_semi").unionByName(corpus.where(F.col(item).isNull()))
        for name, c in texts.items():
            rows = shared.withColumn("tokens", T.tokens(F.col(c), pattern))
            parts.append(lexical_scores(slim.where(F.col("kind") == name), rows, query, item, long_bonus, short_bonus, cap, priority_weight, digits, noise, tag_weight))
    return ranked(reduce(lambda a, b: a.unionByName(b), parts), query, item, "score", limit)


def tag_bonus(tags: Column, question: Column, each: float) -> Column:
    """`each` for every tag that the question contains."""
    return each * F.size(F.filter(tags, lambda t: (t != "") & F.contains(question, t)))


def dense_scores(queries: DataFrame, corpus: DataFrame, query: str = "query_id", item: str = "item_id", digits: int = 6) -> DataFrame:
    """query, item, score: largest inner product over a query's vectors (arrays `vector`) with each item's vector.

    A stated set of queries against all rows of the corpus, which has one vector an item: nothing is shuffled here but the queries. For the best items of each query see dense_ranked.
    """
    asked = queries.groupBy(query).agg(F.collect_list("vector").alias("q"))  # the few vectors of one question
    best = F.array_max(F.transform("q", lambda q: T.dot(F.col("v"), q)))
    both = corpus.select(F.col(item), F.col("vector").alias("v")).crossJoin(small_side(asked))
    return both.select(query, item, F.round(best, digits).alias("score"))


def _vector_blocks(rows: DataFrame, item: str) -> DataFrame:
    """Rows of (item, vector) in blocks of up to VECTORS: ids, dims (-1: a vector that is null or holds a null) and the components as doubles, end to end."""
    given = rows.select(item, F.col("vector").cast("array<double>").alias("vector"))

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for at in range(0, batch.num_rows, VECTORS):
                ids, lists = (batch.slice(at, VECTORS).column(i) for i in range(2))
                whole = pc.if_else(pc.is_in(pa.array(range(len(lists))), pc.list_parent_indices(lists).filter(pc.is_null(pc.list_flatten(lists)))), None, lists)
                dims = pc.fill_null(pc.list_value_length(whole), -1).cast(pa.int32())
                data = pc.list_flatten(whole).to_numpy(zero_copy_only=False).tobytes()
                one = pa.array([0, len(ids)], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(one, ids), pa.ListArray.from_arrays(one, dims), pa.array([data], pa.binary())], names=["ids", "dims", "data"])

    return given.mapInArrow(run, f"ids array<{given.schema[item].dataType.simpleString()}>, dims array<int>, data binary")


def dense_ranked(queries: DataFrame, corpus: DataFrame, limit: int, query: str = "query_id", item: str = "item_id", digits: int = 6, but_own: bool = False) -> DataFrame:
    """query, item, score, rank: what ranked(dense_scores(...), limit) gives; but_own leaves out items with their query's own id (and null ids).

    All pairs are scored, in blocks: a block of items meets a block of query vectors as one matrix product, and a task keeps `limit` items a query vector. A product
    in another order of addition may differ in its last places, so it only tells which pairs can be among the best; those are added up in order, as dense_scores does, and
    rounded half up, before any is dropped. A task holds its blocks' scores and its best; the driver holds nothing.
    """
    spark = corpus.sparkSession
    kinds = queries.schema[query].dataType.simpleString(), corpus.schema[item].dataType.simpleString()
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    asked = _vector_blocks(queries, query).select(F.monotonically_increasing_id().alias("block"), F.col("ids").alias("q_ids"), F.col("dims").alias("q_dims"), F.col("data").alias("q_data"))
    both = _vector_blocks(corpus, item).repartition(tasks).crossJoin(small_side(asked, BROADCAST_ROWS // VECTORS)).select("ids", "dims", "data", "block", "q_ids", "q_dims", "q_data")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        best: dict = {}  # block of query vectors: their ids, and (vector, item, score) of the best so far
        least: dict = {}  # the score that an item has to reach

        def unpacked(ids, dims, data):
            dims, flat = dims.values.to_numpy(), np.frombuffer(data.as_py(), float)
            ends = np.cumsum(np.maximum(dims, 0))
            return ids.values, dims, {d: (at := np.flatnonzero(dims == d), flat[(ends[at] - d)[:, None] + np.arange(d)]) for d in np.unique(dims) if d >= 0}

        for batch in batches:
            for r in range(batch.num_rows):
                row = [batch.column(i)[r] for i in range(7)]
                ids, dims, held = unpacked(*row[:3])
                q_ids, q_dims, q_held = unpacked(*row[4:])
                block, n = row[3].as_py(), len(q_dims)
                limits = least.get(block, np.full(n, -np.inf))
                # Pairs without a score come last, as -inf; those whose score is no number first.
                rough, error = np.full((n, len(dims)), -np.inf), np.zeros((n, 1))
                with np.errstate(all="ignore"):
                    for d, (q_at, q) in q_held.items():
                        if d in held:
                            at, v = held[d]
                            rough[np.ix_(q_at, at)] = np.nan_to_num(q @ v.T, nan=np.inf, posinf=np.inf, neginf=-np.inf)
                            error[q_at, 0] = 4 * (d + 1) * np.finfo(float).eps * np.nan_to_num(np.sqrt((q * q).sum(1)) * np.sqrt((v * v).sum(1)).max(initial=0), nan=np.inf)
                    if but_own:
                        own = _codes(q_ids, ids)
                        own = (own[0][:, None] == own[1][None, :]) | (own[0] < 0)[:, None] | (own[1] < 0)[None, :]
                    else:
                        own = np.zeros((1, 1), bool)
                    open_ = np.isneginf(limits)
                    reach = limits.copy()
                    if open_.any() and len(dims) > limit:
                        of_open = np.where(own, -np.inf, rough)[open_]
                        reach[open_] = np.partition(of_open, len(dims) - limit, axis=1)[:, len(dims) - limit]
                    floor = reach[:, None] - (1.01 * 10.0**-digits + 2 * error)
                    some = ~(rough < floor) & ~own
                q_of, i_of = np.nonzero(some)
                scores = np.empty(len(q_of))
                for at in range(0, len(q_of), PAIRS):
                    scores[at : at + PAIRS] = _in_order(q_of[at : at + PAIRS], i_of[at : at + PAIRS], q_dims, dims, q_held, held)
                names = ids.take(pa.array(i_of))
                before = best.get(block)
                if before is not None:
                    q_of, scores, names = np.append(before[1], q_of), np.append(before[3], scores), pa.concat_arrays([before[2], names])
                keys = _round_half_up(scores, digits)
                empty = np.isnan(scores) & (np.signbit(scores))  # no score at all
                order = np.lexsort((_codes(names)[0], -np.where(np.isnan(keys), np.inf, keys), np.where(empty, 2, np.where(np.isnan(scores), 0, 1)), q_of))
                q_of, keys, empty = q_of[order], keys[order], empty[order]
                place = np.arange(len(q_of)) - np.searchsorted(q_of, q_of)
                kept = place < limit
                best[block] = q_ids, q_of[kept], names.take(pa.array(order[kept])), scores[order][kept]
                last = place == limit - 1
                bounds = np.full(n, -np.inf)
                bounds[q_of[last]] = np.where(empty[last], -np.inf, np.where(np.isnan(keys[last]), np.inf, keys[last]))
                least[block] = bounds
        for q_ids, q_of, names, scores in best.values():
            shown = pa.array(scores, pa.float64(), mask=np.isnan(scores) & np.signbit(scores))
            yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(q_of)), names, shown], names=[query, item, "score"])

    found = both.mapInArrow(run, f"{query} {kinds[0]}, {item} {kinds[1]}, score double")
    scores = found.groupBy(query, item).agg(F.round(F.max("score"), digits).alias("score"))  # a query may have several vectors
    return ranked(scores, query, item, "score", limit)


def _codes(*arrays):
    """Numbers in order of the values of Arrow arrays of one kind, a list for each array; -1 for null."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    every = pa.concat_arrays(arrays) if len(arrays) > 1 and arrays[0].type == arrays[1].type else pa.concat_arrays([a.cast(arrays[0].type) for a in arrays])
    if pa.types.is_integer(every.type) and not every.null_count and (not len(every) or pc.min(every).as_py() >= 0):
        codes = every.to_numpy()
    else:
        coded = every.dictionary_encode()
        rank = np.empty(len(coded.dictionary), np.int64)
        rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
        codes = np.full(len(every), -1, np.int64)
        filled = coded.indices.is_valid().to_numpy(zero_copy_only=False)
        codes[filled] = rank[coded.indices.drop_null().to_numpy()]
    return np.split(codes, np.cumsum([len(a) for a in arrays])[:-1])


def _in_order(q_of, i_of, q_dims, dims, q_held: dict, held: dict):
    """Inner products of pairs, added up from the first component to the last; -nan where a vector is missing or the lengths differ."""
    import numpy as np

    out = np.full(len(q_of), -np.nan)
    same = q_dims[q_of] == dims[i_of]
    for d in np.intersect1d(list(q_held), list(held)):
        (q_at, q), (at, v) = q_held[d], held[d]
        some = np.flatnonzero(same & (q_dims[q_of] == d))
        a, b = np.searchsorted(q_at, q_of[some]), np.searchsorted(at, i_of[some])
        total = np.zeros(len(some))
        with np.errstate(all="ignore"):
            for j in range(int(d)):
                total += q[a, j] * v[b, j]
        out[some] = np.where(np.isnan(total), np.nan, total)
    return out


def _round_half_up(values, digits: int):
    """As F.round, by the shortest decimal of a double; only what lies near a half is worked out in decimals."""
    from decimal import ROUND_HALF_UP, Context, Decimal

    import numpy as np

    scale = 10.0**digits
    with np.errstate(all="ignore"):
        size = np.abs(values) * scale
        out = np.copysign(np.floor(size + 0.5), values) / scale
        near = np.flatnonzero(np.isfinite(size) & ((np.abs(size - np.floor(size) - 0.5) < 1e-6) | (size > 1e9)))
    exact = Context(prec=400)
    for i in near:
        out[i] = float(Decimal(repr(float(values[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP, exact))
    return out


def best_per_item(hits: DataFrame, request: str, item: str = "item_id", score: str = "score", limit: int = 12) -> DataFrame:
    """Rankings of several queries of one request as one: the best score of each item, the `limit` best items of a request."""
    return ranked(hits.groupBy(request, item).agg(F.max(score).alias(score)), request, item, score, limit)


def first_with_hits(branches: list[DataFrame | None], query: str = "query_id") -> DataFrame:
    """For each question the hits of the first branch that has any (null: a branch that is not available), with the branch number."""
    usable = [(i, rows.withColumn("branch", F.lit(i))) for i, rows in enumerate(branches) if rows is not None]
    found = usable[0][1]
    for _, rows in usable[1:]:
        found = durable(found)  # a few hits a question: given as they are, and kept from the next branch
        found = found.unionByName(rows.join(found.select(query).distinct(), query, "left_anti"))
    return found


def branch_limit(limit: int) -> int:
    """Hits a branch contributes to a fusion of `limit`."""
    return max(4 * limit, 12)


def fused(branches: dict[str, DataFrame], query: str = "query_id", item: str = "item_id", k: int = 60, limit: int = 4) -> DataFrame:
    """Reciprocal rank fusion of ranked branches: sum of 1 / (k + rank); the branches an item came from are kept in order."""
    parts = [rows.select(query, item, "rank", F.lit(i).alias("branch"), F.lit(name).alias("name")) for i, (name, rows) in enumerate(branches.items())]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    sums = every.groupBy(query, item).agg(
        F.round(F.sum(1 / (k + F.col("rank"))), 6).alias("score"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("branch", "name"))), lambda x: x["name"]), "+").alias("branches")
    )
    return ranked(sums, query, item, "score", limit)


def expanded(hits: DataFrame, members: DataFrame, query: str = "query_id", item: str = "item_id", per_item: int = 2, in_all: int = 6) -> DataFrame:
    """Evidence of ranked hits: going down the ranks, the first `per_item` members not used before, `in_all` at most.

    hits: query, item, rank, score. members: item, members (array in order). A member that an item lists beyond its quota is
    still free for a later item, so this is a fold over the few ranked items of a query.
    """
    lists = hits.join(members, item).groupBy(query).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(item).alias("item"), "score", "members"))).alias("found"))
    used = "array<struct<rank:int,item:string,score:double,member:string>>"

    def take(state: Column, hit: Column) -> Column:
        free = F.filter(hit["members"], lambda m: ~F.exists(state, lambda s: s["member"] == m.cast("string")))
        room = F.greatest(F.least(F.lit(per_item), F.lit(in_all) - F.size(state)), F.lit(0))
        new = F.transform(F.slice(F.array_distinct(free), F.lit(1), room), lambda m: F.struct(hit["rank"].alias("rank"), hit["item"].cast("string").alias("item"), hit["score"].cast("double").alias("score"), m.cast("string").alias("member")))
        return F.concat(state, new)

    folded = lists.select(query, F.posexplode(F.aggregate("found", F.array().cast(used), take)).alias("place", "e"))
    return folded.select(query, (F.col("place") + 1).alias("place"), "e.item", "e.member", "e.score")


def excerpt(sentences: Column, terms: Column, around: int = 1) -> Column:
    """The first sentence with the first term that any has (terms longest first), and its neighbours; the first sentence if none."""
    def shown(given: Column, hit: Column) -> Column:
        place = F.array_position(F.transform(given["s"], lambda s: F.contains(s, hit)), F.lit(True))
        window = F.slice(given["s"], F.greatest(place - around, F.lit(1)).cast("int"), (F.least(place - 1, F.lit(around)) + around + 1).cast("int"))
        return F.when(hit.isNull(), F.get(given["s"], F.lit(0))).otherwise(F.array_join(window, " "))

    # An expression inside a lambda is worked out for each element, so what is looked through and what was found are bound to values first.
    bound = F.transform(F.array(F.struct(sentences.alias("s"), terms.alias("t"))), lambda x: F.struct(x.alias("x"), F.get(F.filter(x["t"], lambda t: F.exists(x["s"], lambda s: F.contains(s, t))), F.lit(0)).alias("hit")))
    return F.get(F.transform(bound, lambda y: shown(y["x"], y["hit"])), F.lit(0))


def matched(text: Column, terms: Iterable[str], limit: int = 6) -> Column:
    return F.slice(words_in(text, terms), 1, limit)


def reranked(hits: DataFrame, scores: DataFrame | None, query: str = "query_id", item: str = "item_id", keep: int = 4) -> DataFrame:
    """The `keep` hits that an external scorer places first (scores: query, item, model_score), with score 1 - 0.1 * place; the first hits without one."""
    if scores is None:
        return hits.where(F.col("rank") <= keep)
    order = Window.partitionBy(query).orderBy(F.col("model_score").desc_nulls_last(), "rank")
    placed = hits.join(scores, [query, item], "left").withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)
    return placed.withColumns({"rank": F.col("place"), "score": F.round(1 - 0.1 * (F.col("place") - 1), 6)}).drop("place", "model_score")


def evaluated(hits: DataFrame, truth: DataFrame, groups: list[str], query: str = "query_id", item: str = "item_id") -> DataFrame:
    """Hit rate and mean reciprocal rank, for every group and (group null) overall. truth: query, item, groups."""
    first = truth.join(hits.select(query, item, "rank"), [query, item], "left").groupBy(query, *groups).agg(F.min("rank").alias("rank"))
    return first.rollup(*groups).agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("rank").isNotNull().cast("double")), 6).alias("hit_rate"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr")
    )


def evaluation_rows(hits: DataFrame, truth: DataFrame, query: str = "query_id", item: str = "item_id", shown: int = 4) -> DataFrame:
    """query, expected, hit, rank (-1: a miss), reciprocal_rank and top (the first `shown` items) of every question of truth (query, item: what is expected, once a question)."""
    listed = hits.where(F.col("rank") <= shown).groupBy(query).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(item).alias("i")))), lambda x: x["i"]).alias("top"))
    found = truth.select(query, F.col(item).alias("expected")).join(hits.select(query, F.col(item).alias("expected"), "rank"), [query, "expected"], "left")
    rows = found.groupBy(query, "expected").agg(F.min("rank").alias("rank")).join(listed, query, "left")
    told = rows.select(query, "expected", F.col("rank").isNotNull().alias("hit"), F.coalesce("rank", F.lit(-1)).cast("int").alias("rank"), F.round(F.coalesce(1 / F.col("rank"), F.lit(0.0)), 6).alias("reciprocal_rank"), "top")
    return told.withColumn("top", F.coalesce("top", F.array().cast(told.schema["top"].dataType)))


def misses(rows: DataFrame, group: str, first: int = 10, query: str = "query_id") -> DataFrame:
    """Of evaluation_rows with a group column: the first misses of each group, by query."""
    return rows.where("not hit").withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(query))).where(F.col("place") <= first)
