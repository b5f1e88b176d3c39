"""Near-duplicate documents by min-max hashing.

Each document becomes the set of its distinct k-word shingles. Under each of `permutations` linear
permutations both the minimum and the maximum are retained, so a signature of 2 * permutations values costs
permutations hash evaluations. Values are cut into bands; documents that agree on a band are candidates, and
every link is confirmed on the full sets.

Scale. Documents with equal sets first fall together into classes (a partial aggregation on a 128-bit set key),
so groups of copies, however large, cost one representative. A band bucket of representatives is not compared pair by
pair: its first and last member are the pivots, which are compared with all others and leave it; buckets whose members are
still in more than one component go into the next of ROUNDS rounds, with pivots from their largest component. As pivots
follow one order in all buckets, a document meets few different ones. In what is open after that, members outside the largest
component of a cluster are compared with the cluster in blocks of BLOCK_SHINGLES, inside tasks, and only links come out. So no
link that could join two components is missed, and a large group of near copies never becomes all its pairs; only members
that stay unlinked although they share buckets are compared with each other one by one. Sets are built once, for candidates
only. Intermediate tables are compressed files, deleted when they are superseded.

Chance of missing a link at similarity 0.8 with the defaults (40 bands of 5 values): (1 - 0.8**5)**40, about 1e-7. Shingles are
64-bit hashes, and equal sets are told by their size and a 128-bit key.

Edge cases. Null text, or text without words, has an empty set: linked with nothing, its own component. Fewer
words than k: the whole sequence is the one shingle. Rows that share an id are documents of their own, linked by their texts
alone; repeated rows get equal results but for `chosen`. A null id is returned with a null component, kept and chosen, and
takes no part in linking. A very long text is one set, held whole by the task that builds or compares it (8 bytes a
distinct shingle). Empty table: empty result. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Candidates up to this many (some 50 MB) are sent to all executors when texts are looked up; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Rounds of pivots before the members that remain outside are compared in blocks.
ROUNDS = 2
#: Shingles in a block (1 MB), about.
BLOCK_SHINGLES = 1 << 17
#: Edges that one task replaces by stars (some 200 MB at work).
EDGES = 1 << 21
#: Words whose hashes a Python worker remembers.
MEMO_WORDS = 250_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX2
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes | None, k: int, memo: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a UTF-8 text; A-Z lower-cased, words split at ASCII white space."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.array([memo[w] for w in words], dtype=np.uint64)
    n = max(1, len(h) - k + 1)
    out = np.full(n, min(k, len(h)), np.uint64)
    for j in range(min(k, len(h))):
        out = _mixed(out * _MIX + h[j : j + n])
    return np.unique(out)


class MinMaxSigner:
    """Band keys of a set under `permutations` linear permutations of 32-bit hashes, with minimum and maximum of each."""

    def __init__(self, permutations: int, rows: int, seed: int):
        if permutations % rows:
            raise ValueError("permutations must be a multiple of rows")
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 2**31, permutations, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 2**32, permutations, dtype=np.uint32)
        self.rows = rows
        self.bands = 2 * (permutations // rows)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        low, high = None, None
        for i in range(0, len(x), 4096):
            values = x[i : i + 4096, None] * self.a + self.b
            lo, hi = values.min(axis=0), values.max(axis=0)
            low = lo if low is None else np.minimum(low, lo)
            high = hi if high is None else np.maximum(high, hi)
        return np.concatenate([low, high])

    def band_keys(self, hashes: np.ndarray) -> np.ndarray:
        values = self.signature(hashes).astype(np.uint64).reshape(self.bands, self.rows)
        key = np.arange(1, self.bands + 1, dtype=np.uint64) * _MIX
        for j in range(self.rows):
            key = _mixed(key * _MIX + values[:, j])
        return key.view(np.int64)


_KEY = ["n", "k1", "k2"]
_SIGNED = "row long, id long, digest long, n long, k1 long, k2 long, bands array<long>"
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _signed(docs: DataFrame, k: int, permutations: int, rows: int, seed: int, least: int) -> DataFrame:
    """row, id, digest, n, k1, k2 (set key) and bands (null for sets too small to have a link to another set) of id, digest, text."""

    def run(batches):
        memo, signer = _WordHashes(), MinMaxSigner(permutations, rows, seed)
        for batch in batches:
            n, k1, k2, bands = [], [], [], []
            for value in batch.column(3):
                s = shingle_set(value.as_py(), k, memo)
                n.append(len(s))
                k1.append(int(np.add.reduce(_mixed(s * _MIX)).view(np.int64)) if len(s) else 0)
                k2.append(int(np.add.reduce(_mixed(s ^ _MIX2)).view(np.int64)) if len(s) else 0)
                bands.append(signer.band_keys(s) if len(s) >= least else None)
            made = [pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *made], names=["row", "id", "digest", *_KEY, "bands"])

    return docs.select(F.monotonically_increasing_id().alias("row"), "id", "digest", "text").mapInArrow(run, _SIGNED)


def _sets(docs: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """rep, n and shingles (array of hashes) of the candidates (rep, id, digest); repeated rows come out repeatedly."""
    few = candidates.count() <= BROADCAST_IDS
    wanted = docs.join(F.broadcast(candidates) if few else candidates, ["id", "digest"]).select("rep", "text")

    def run(batches):
        memo = _WordHashes()
        for batch in batches:
            sets = [shingle_set(value.as_py(), k, memo).view(np.int64) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int32()), pa.array(sets, pa.list_(pa.int64()))], names=["rep", "n", "shingles"])

    return wanted.mapInArrow(run, "rep long, n int, shingles array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    left, right = (sets.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("shingles").alias(f"s{x}")) for x in "ab")
    sized = pairs.join(left, "a").join(right, "b").where((100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na")))
    both = sized.select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("common"))
    return both.where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def _linked_blocks(scratch: Scratch, open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) across the components of open buckets (bucket, rep, part).

    Buckets that share members form a cluster. The members outside a cluster's largest component are compared with all of the cluster,
    block by block: a row is a block of them and a block of the cluster, dealt by (cluster, block), and only links come out.
    """
    low = scratch.table(open_.groupBy("bucket").agg(F.min("rep").alias("first")))
    clusters = components(scratch, open_.join(low, "bucket").where("rep <> first").select(F.col("rep").alias("a"), F.col("first").alias("b")))
    reps = open_.select("rep", "part").distinct().join(clusters, F.col("rep") == F.col("node"), "left").select("rep", "part", F.coalesce("root", "rep").alias("cluster"))
    members = scratch.table(reps.join(sets, "rep"))
    sizes = members.groupBy("cluster", "part").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
    main = F.max(F.struct("size", "shingles", "part"))
    shape = sizes.groupBy("cluster").agg(main.alias("x"), F.sum("shingles").alias("all")).select("cluster", F.col("x.part").alias("main"), "all", (F.col("all") - F.col("x.shingles")).alias("beside"))
    number = lambda c: F.greatest(F.ceil(F.col(c) / BLOCK_SHINGLES), F.lit(1)).cast("int")
    shape = scratch.table(shape.select("cluster", "main", number("all").alias("blocks"), number("beside").alias("left_blocks")))
    ready = members.join(shape, "cluster")
    of = lambda n: F.pmod(F.xxhash64("rep", F.lit(5)), F.col(n)).cast("int")
    pack = F.collect_list(F.struct("rep", "part", "shingles"))  # about BLOCK_SHINGLES
    right = scratch.table(ready.groupBy("cluster", of("blocks").alias("block")).agg(pack.alias("right")))
    left = scratch.table(ready.where("part <> main").groupBy("cluster", "blocks", of("left_blocks").alias("left_block")).agg(pack.alias("left")))
    pairs = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(right, ["cluster", "block"]).select("left", "right")

    def run(batches):
        for batch in batches:
            a, b = [], []
            for left, right in zip(batch.column(0), batch.column(1)):
                values = right.values.field("shingles")
                shingles = values.values.to_numpy()[values.offsets[0].as_py() : values.offsets[-1].as_py()]
                sizes = np.diff(values.offsets.to_numpy())
                order = np.argsort(shingles, kind="stable")
                shingles, owners = shingles[order], np.repeat(np.arange(len(sizes)), sizes)[order]
                reps, parts = right.values.field("rep").to_numpy(), right.values.field("part").to_numpy()
                for member in left:
                    mine = member["shingles"].values.to_numpy()
                    lo, hi = np.searchsorted(shingles, mine, "left"), np.searchsorted(shingles, mine, "right")
                    n = hi - lo
                    at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    common = np.bincount(owners[at], minlength=len(sizes))
                    linked = np.flatnonzero((100 * common >= percent * (len(mine) + sizes - common)) & (parts != member["part"].as_py()))
                    a += [member["rep"].as_py()] * len(linked)
                    b += reps[linked].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_PAIR)

    found = scratch.table(pairs.mapInArrow(run, "a long, b long"))
    scratch.drop(low, clusters, members, shape, left, right)
    return found


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that are not the smallest of their component, and that smallest one, of the edges (a, b)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        lu, lv = label[u], label[v]
        apart = lu != lv
        if not apart.any():
            break
        lu, lv = lu[apart], lv[apart]
        np.minimum.at(label, np.maximum(lu, lv), np.minimum(lu, lv))  # labels are roots here: each hooks to a smaller one
        while not np.array_equal(label, nearer := label[label]):
            label = nearer
    inner = label != np.arange(len(nodes))
    return nodes[inner], nodes[label[inner]]


def _contracted(edges: DataFrame) -> DataFrame:
    """node, root: within every partition the edges (first and second column) are replaced by a forest of stars."""

    def run(batches):
        columns = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
        if columns:
            nodes, roots = forest(*(np.concatenate(c) for c in zip(*columns)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], names=["node", "root"])

    return edges.mapInArrow(run, "node long, root long")


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """node, root for every node of the links (a, b) but the roots: root is the smallest node that it reaches.

    Every task replaces its edges, EDGES at most, by stars; then large-star and small-star steps join the stars of different
    tasks, until nothing changes. Rounds grow with the logarithm of the longest path. A hub is on the long side of a join with
    one row a node, which AQE can split; nothing is collected but one count and checksum a round.
    """
    edges = scratch.table(_contracted(links))
    seen = None
    while True:
        tasks = -(-edges.count() // EDGES)
        before, edges = edges, scratch.table(_contracted(edges.coalesce(max(1, tasks))))
        scratch.drop(before)
        if tasks <= 1:  # the stars of a single task are final
            return edges
        check = edges.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if check == seen:
            return edges
        seen = check
        both = edges.select(F.col("node").alias("u"), F.col("root").alias("v")).union(edges.select(F.col("root").alias("u"), F.col("node").alias("v")))
        low = scratch.table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = scratch.table(both.join(low, "u").where("v > u").select(F.col("v").alias("node"), F.col("m").alias("root")))
        low2 = scratch.table(large.groupBy("node").agg(F.min("root").alias("m")))
        small = large.join(low2, "node").where("root <> m").select(F.col("root").alias("node"), F.col("m").alias("root")).union(low2.select("node", F.col("m").alias("root")))
        before, edges = edges, scratch.table(small.distinct())
        scratch.drop(before, low, large, low2)


def _links_of_buckets(scratch: Scratch, open_: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """node, root: the components of representatives that share buckets (bucket, rep, part)."""
    if open_.isEmpty():
        return scratch.table(open_.select(F.col("rep").alias("node"), F.col("part").alias("root")))
    candidates = scratch.table(open_.select("rep").distinct().join(classes.select("rep", "id", "digest"), "rep"))
    sets = scratch.table(_sets(docs, candidates, k))
    checked: list[DataFrame] = []
    labels = None
    for turn in range(ROUNDS):
        main = open_
        if turn:  # pivots come from the largest component of a bucket
            sizes = open_.groupBy("bucket", "part").agg(F.count("*").alias("size"))
            largest = scratch.table(sizes.groupBy("bucket").agg(F.max(F.struct("size", "part")).alias("x")).select("bucket", F.col("x.part").alias("part")))
            main = open_.join(largest, ["bucket", "part"], "left_semi")
        pivots = scratch.table(main.groupBy("bucket").agg(F.min("rep").alias("first"), F.max("rep").alias("last"), F.min("part").alias("main")))
        met = open_.join(pivots, "bucket")
        pairs = met.where("part <> main").select("rep", F.explode(F.array("first", "last")).alias("pivot")).where("rep <> pivot")
        pairs = pairs.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
        for known in checked:
            pairs = pairs.join(known, ["a", "b"], "left_anti")
        checked.append(scratch.table(pairs))
        found = _confirmed(checked[-1], sets, percent)
        if labels is not None:
            found = found.union(labels.select(F.col("node").alias("a"), F.col("root").alias("b")))
        before, labels = labels, components(scratch, found)
        # All pairs with the pivots are settled, so they leave; buckets that still hold more than one component stay open.
        rest = met.where("rep <> first and rep <> last").select("bucket", "rep")
        rest = scratch.table(rest.join(labels, F.col("rep") == F.col("node"), "left").select("bucket", "rep", F.coalesce("root", "rep").alias("part")))
        mixed = scratch.table(rest.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("bucket"))
        superseded, open_ = open_, scratch.table(rest.join(mixed, "bucket", "left_semi"))
        scratch.drop(before, superseded, rest, mixed, pivots, *([largest] if turn else []))
        if open_.isEmpty():
            break
    else:
        found = _linked_blocks(scratch, open_, sets, percent)
        before, labels = labels, components(scratch, found.union(labels.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        scratch.drop(before, found)
    scratch.drop(candidates, sets, open_, *checked)
    return labels


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, permutations: int = 100, rows: int = 5, seed: int = 7
) -> DataFrame:
    """One row per document: id, digest (xxhash64 of the text), n (set size), component (smallest id reachable over links), kept (id = component) and chosen.

    Two documents are linked if 100 * intersection >= percent * union of their k-word shingle sets. Of the rows of a component one alone
    is `chosen`: one of those with the smallest id.
    """
    text = F.col(text_col).cast("string")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("digest"), text.cast("binary").alias("text"))
    # Sets of a and of b > a shingles have similarity a / b at most, so sets below this size only link with equal sets.
    least = next(a for a in range(1, 101) if 100 * a >= percent * (a + 1)) if percent < 100 else 2**31
    scratch = Scratch(docs.sparkSession, "near-dedup")
    signed = scratch.table(_signed(docs, k, permutations, rows, seed, least))
    known = signed.where("id is not null and n > 0")
    first = F.min(F.struct("id", "row", "digest"))
    classes = known.groupBy(*_KEY).agg(first.alias("of"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    classes = scratch.table(classes.select(*_KEY, F.col("of.row").alias("rep"), F.col("of.id").alias("id"), F.col("of.digest").alias("digest"), "copies", "bands"))

    banded = classes.where("bands is not null").select("rep", F.explode("bands").alias("bucket"))
    full = scratch.table(banded.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1").select("bucket"))
    open_ = scratch.table(banded.join(full, "bucket", "left_semi").select("bucket", "rep", F.col("rep").alias("part")))
    labels = _links_of_buckets(scratch, open_, docs, classes, k, percent)

    # Classes of one document without links keep their own id and need no row here.
    linked = labels.select("node", "root").union(labels.select(F.col("root").alias("node"), "root").distinct())
    named = classes.join(linked, classes.rep == linked.node, "left").where("copies > 1 or root is not null").select(*_KEY, "id", "rep", F.coalesce("root", "rep").alias("root"))
    grouped = scratch.table(named)
    best = scratch.table(grouped.groupBy("root").agg(F.min(F.struct("id", "rep")).alias("of")).select("root", F.col("of.id").alias("component"), F.col("of.rep").alias("best")))
    named = scratch.table(grouped.join(best, "root").select(*_KEY, "component", "best"))
    scratch.drop(classes, full, labels, grouped, best)
    own = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    out = signed.select("row", "id", "digest", *_KEY).join(named, _KEY, "left").withColumn("component", own)
    return out.select("id", "digest", "n", "component", F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"), (F.col("id").isNull() | F.coalesce(F.col("row") == F.col("best"), F.lit(True))).alias("chosen"))
