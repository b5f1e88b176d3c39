"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are ordered by length (Euclidean norm, descending) and cut into buckets of neighbouring lengths. The longest bucket
answers every query first; its k-th best score is a query's starting threshold. In any other bucket a candidate can reach
the threshold only if its cosine with the query is at least local = threshold / (|query| * longest candidate of the bucket).
From that local threshold each (query, bucket) chooses: local > 1, the bucket is skipped; local >= COORDINATE, coordinate
pruning, i.e. only candidates whose normalised coordinates lie in the feasible interval of the query's largest coordinates; else
length pruning, the prefix of the bucket whose lengths can still reach the threshold. What remains is verified by integer
products, and the k best of all buckets are merged.

Scale. Vectors travel in packed blocks: a bucket is one row of `bucket_rows` vectors, queries go in blocks of `query_rows`. A
query block is sent only to the buckets its weakest query cannot skip (a prefix of the length order), joined by bucket number, so
work is spread over (block, bucket) pairs and no group is collected. The driver sees one norm per bucket, MAX_BUCKETS doubles at
most. Blocks are written to the shared folder once.

Edge cases. Vectors that are null, empty, or hold null or non-finite components, rows without an id and queries whose
dimension no candidate has take no part. Fewer candidates than k: all are returned. Equal scores go to the smaller id. Zero vectors
and negative thresholds prune nothing. Repeated ids: every row is a query and a candidate of its own, known by its place in the table; only a query's own
row is no candidate of it, and queries that share an id have k results each. Products
are added as doubles while they fit 53 bits, else as integers of any size. A scaled component beyond 2**62 counts as 2**62, a score
beyond the range of long as the end of that range. Very long vectors: a bucket holds bucket_rows of them. Empty table: no rows.
Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

MAX_BUCKETS = 100_000
#: Scaled components count up to this size.
LARGEST = 1 << 62
#: Local cosine from which coordinates prune better than lengths.
COORDINATE = 0.5
#: Query blocks that meet one copy of a bucket.
SHARE = 64
#: Coordinates that are looked at.
FOCUS = 3

_BLOCK = "block long, dim int, high double, ids binary, rows binary, vectors binary"


def _pack(block: int, kept: list[tuple[int, int, np.ndarray]]) -> tuple:
    """kept: id, row and vector."""
    ids, rows, vectors = np.array([x[0] for x in kept]), np.array([x[1] for x in kept]), np.stack([x[2] for x in kept])
    norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1).max())
    small = np.abs(vectors).max(initial=0) < 2**31
    return block, vectors.shape[1], float(norm), ids.astype("<i8").tobytes(), rows.astype("<i8").tobytes(), vectors.astype("<i4" if small else "<i8").tobytes()


def _unpack(row: dict, ids: str = "ids", vectors: str = "vectors") -> tuple[np.ndarray, np.ndarray]:
    """ids and integer vectors; components take 4 bytes, or 8 in blocks with large ones."""
    of = np.frombuffer(row[ids], "<i8")
    return of, np.frombuffer(row[vectors], "<i4" if len(row[vectors]) == 4 * len(of) * row["dim"] else "<i8").reshape(-1, row["dim"])


def _batch(rows: list[tuple], schema: pa.Schema):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


_BLOCK_ARROW = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("high", pa.float64()), ("ids", pa.binary()), ("rows", pa.binary()), ("vectors", pa.binary())])
_HITS_ARROW = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, row (a number of its own), dim, v (array of floor(scale * x)) and norm of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    rows = rows.where((F.size("v") > 0) & F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    whole = lambda x: F.when(F.abs(x) < LARGEST / scale, F.floor(x * scale)).otherwise(F.lit(LARGEST) * F.signum(x).cast("long"))
    rows = rows.withColumn("v", F.transform("v", whole))
    return rows.select("id", F.monotonically_increasing_id().alias("row"), F.size("v").alias("dim"), "v", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("norm"))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """rows, already in order within partitions, packed in blocks of `size`; block numbers are per partition."""

    def run(batches):
        held: dict[int, list] = {}
        made = 0
        for batch in batches:
            for i, row, dim, v in zip(*(batch.column(n).to_pylist() for n in range(3)), batch.column(3)):
                kept = held.setdefault(dim, [])
                kept.append((i, row, v.values.to_numpy()))
                if len(kept) == size:
                    yield _batch([_pack(made, kept)], _BLOCK_ARROW)
                    held[dim], made = [], made + 1
        for kept in held.values():
            if kept:
                yield _batch([_pack(made, kept)], _BLOCK_ARROW)
                made += 1

    return rows.select("id", "row", "dim", "v").mapInArrow(run, _BLOCK)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then smallest id."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= edge)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _products(vectors: np.ndarray, floats: np.ndarray, query: np.ndarray, bound: float) -> np.ndarray:
    """Inner products as int64; bound: no sum of products is beyond it."""
    if bound < 2**53:
        return (floats @ query.astype(np.float64)).astype(np.int64)
    if bound < 2**62:
        return vectors.astype(np.int64) @ query.astype(np.int64)
    return np.clip(vectors.astype(object) @ query.astype(object), -(2**63), 2**63 - 1).astype(np.int64)


class Bucket:
    """One bucket: vectors by falling length, with their directions."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray):
        floats = vectors.astype(np.float64)
        norms = np.sqrt((floats**2).sum(axis=1))
        order = np.argsort(-norms, kind="stable")
        self.ids, self.rows, self.vectors, self.floats, self.norms = ids[order], rows[order], vectors[order], floats[order], norms[order]
        self.directions = self.floats / np.maximum(self.norms, 1e-300)[:, None]
        self.largest = float(np.abs(self.floats).max(initial=0))

    def search(self, query_row: int, query: np.ndarray, threshold: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the k best that are at least the threshold (-inf: no threshold yet)."""
        whole, query = query, query.astype(np.float64)
        length = float(np.sqrt((query**2).sum()))
        bound = self.largest * float(np.abs(query).max(initial=0)) * len(query)
        reach = length * (self.norms[0] if len(self.norms) else 0.0)
        if threshold > 0 and reach < threshold * (1 - 1e-12):
            return self.ids[:0], np.empty(0, np.int64)
        local = threshold / reach if threshold > 0 else -1.0
        if local >= COORDINATE:
            local = min(local, 1.0) - 1e-9
            q = query / length
            kept = np.ones(len(self.ids), bool)
            for f in np.argsort(-np.abs(q))[:FOCUS]:
                spread = np.sqrt(max(0.0, (1 - local * local) * (1 - q[f] * q[f])))
                x = self.directions[:, f]
                # The half-space of cosines from local on leaves this interval; beyond a pole it is open.
                low = -1.0 if -q[f] >= local else q[f] * local - spread
                high = 1.0 if q[f] >= local else q[f] * local + spread
                kept &= (x >= low - 1e-9) & (x <= high + 1e-9)
            some = np.flatnonzero(kept)
        elif threshold > 0:
            some = np.arange(np.searchsorted(-self.norms, -(threshold / length) * (1 - 1e-12), side="right"))
        else:
            some = np.arange(len(self.ids))
        some = some[self.rows[some] != query_row]
        scores = _products(self.vectors[some], self.floats[some], whole, bound)
        if threshold > float("-inf"):
            good = scores >= threshold
            some, scores = some[good], scores[good]
        best = _best(self.ids[some], scores, k)
        return self.ids[some][best], scores[best]


def _search(pairs: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score from rows of a bucket and a query block with thresholds."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, vectors = _unpack(row)
                bucket = Bucket(ids, np.frombuffer(row["rows"], "<i8"), vectors)
                q_ids, q = _unpack(row, "q_ids", "q_vectors")
                limits = np.frombuffer(row["limits"], "<f8") if row["limits"] else np.full(len(q_ids), -np.inf)
                rows = []
                for i, at, query, limit in zip(q_ids, np.frombuffer(row["q_rows"], "<i8"), q, limits):
                    ids, scores = bucket.search(at, query, limit, k)
                    rows += [(int(at), int(i), int(a), int(b)) for a, b in zip(ids, scores)]
                yield _batch(rows, _HITS_ARROW)

    return pairs.select("dim", "ids", "rows", "vectors", "q_ids", "q_rows", "q_vectors", "limits").mapInArrow(run, "query_row long, query_id long, vec_id long, score long")


def _top(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def _with_limits(blocks: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """Query blocks with the starting thresholds of their queries, and the least length that may matter to any of them."""
    worst = first.where(F.col("rank") == k).select("query_row", F.col("score").alias("limit"))
    rows = blocks.select("block", F.posexplode("q_list").alias("pos", "query_row"))
    limits = rows.join(worst, "query_row", "left").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("pos", "limit"))).alias("limits"))  # query_rows values a block
    both = blocks.join(limits, "block")

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                limit = np.array([-np.inf if x["limit"] is None else x["limit"] for x in row["limits"]], "<f8")
                _, q = _unpack(row, "q_ids", "q_vectors")
                lengths = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
                need = np.where(limit > 0, limit / np.maximum(lengths, 1e-300), -1.0).min(initial=np.inf)
                out.append((row["block"], row["dim"], row["q_ids"], row["q_rows"], row["q_vectors"], limit.tobytes(), float(need)))
            yield _batch(out, pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("q_ids", pa.binary()), ("q_rows", pa.binary()), ("q_vectors", pa.binary()), ("limits", pa.binary()), ("need", pa.float64())]))

    return both.select("block", "dim", "q_ids", "q_rows", "q_vectors", "limits").mapInArrow(run, "block long, dim int, q_ids binary, q_rows binary, q_vectors binary, limits binary, need double")


def exact_top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", bucket_rows: int = 2048, query_rows: int = 256
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row for which is_query (a condition on `id`) holds, its k best other rows."""
    rows = durable(quantized(vectors, id_col, vector_col, scale))
    n = rows.count()
    bucket_rows = max(bucket_rows, -(-n // MAX_BUCKETS))
    parts = max(1, -(-n // (bucket_rows * 4)))
    by_length = rows.repartitionByRange(parts, F.desc("norm"), F.col("id")).sortWithinPartitions(F.desc("norm"), "id")
    made = durable(_blocks(by_length, bucket_rows).withColumn("part", F.spark_partition_id()))
    # Buckets are numbered by falling length; one short row a bucket comes to the driver.
    order = sorted(made.select("part", "block", "high").collect(), key=lambda r: (-r["high"], r["part"], r["block"]))
    if not order:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    number = rows.sparkSession.createDataFrame([(r["part"], r["block"], i) for i, r in enumerate(order)], "part int, block long, bucket long")
    buckets = made.join(F.broadcast(number), ["part", "block"]).select("bucket", "dim", "ids", "rows", "vectors", "high")

    asked = rows.where(is_query)
    spread = asked.repartition(max(1, parts // 4), "id").sortWithinPartitions("norm", "id")
    q = _blocks(spread, query_rows).withColumn("block", F.monotonically_increasing_id())
    unpacked = F.udf(lambda raw: np.frombuffer(raw, "<i8").tolist(), "array<long>")
    q = durable(q.select("block", "dim", F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), F.col("vectors").alias("q_vectors"), unpacked("rows").alias("q_list")))

    # The first bucket is one block of bucket_rows vectors: it goes to all query blocks.
    longest = F.broadcast(buckets.where("bucket = 0").withColumnRenamed("dim", "dim2"))
    seed = q.withColumn("bucket", F.lit(0).cast("long")).withColumn("limits", F.lit(None).cast("binary")).join(longest, "bucket").where("dim = dim2")
    first = durable(_top(_search(seed, k), k))
    limited = _with_limits(q, first, k)
    # High norms fall with the bucket number, so the buckets a block needs are a prefix.
    highs = np.array([r["high"] for r in order])

    @F.pandas_udf("long")
    def last_bucket(need):
        import pandas as pd

        return pd.Series(np.searchsorted(-highs, -need.to_numpy() * (1 - 1e-12), side="right") - 1)

    sent = limited.withColumn("last", last_bucket("need")).where("last >= 1").withColumn("bucket", F.explode(F.sequence(F.lit(1).cast("long"), F.col("last"))))
    # Each bucket is copied for SHARE of the query blocks that need it, so that no task meets all queries.
    salts = max(1, -(-q.count() // SHARE))
    sent = durable(sent.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int")))
    copies = sent.select("bucket", "salt").distinct().join(buckets.withColumnRenamed("dim", "dim2"), "bucket")
    rest = _search(sent.join(copies, ["bucket", "salt"]).where("dim = dim2"), k)
    return _top(first.select("query_row", "query_id", "vec_id", "score").union(rest), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
