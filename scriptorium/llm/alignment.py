"""Alignment of two tokenizers over a corpus: which ids of one end where ids of the other end, and how often.

Both tokenizers spell a text in bytes (a blank before it). Where a token of A and a token of B end at the same byte the text is
cut into groups, and the two tokens that end there are linked. How often a pair (a, b) is linked in the whole corpus ranks the
A ids that may stand for a B id.

Inverted pair bitmaps. Documents are tokenized once, in blocks of at most 65,536 documents or BLOCK links (a document is never
cut). For each pair a block writes the documents that hold it as compressed bitmaps, one a multiplicity plane: plane k has the
documents whose number of links has bit k. A bitmap is a sorted list of 16-bit places, or bits where that is shorter. A pair's
document count is the popcount of its planes after an OR, its link count the popcounts weighted by 2^k, both added up over
blocks. The postings then take the scores back: walking a block's bitmaps adds each pair's count to the documents it names.

Scale. Texts are read once and never shuffled; what is kept of them is written to the shared folder. Shuffled are one
row per pair and block for the counts. Counts go to all executors up to BROADCAST_PAIRS pairs; beyond that they meet the postings
by a shuffle on the pair, which has one row a block and plane, and postings are gathered by block. A block's state is two numbers per
document. The ids of A that meet one id of B are at most A's vocabulary.

Edge cases. Texts that are null, empty or not spelled byte for byte by both tokenizers (after the blank) have no tokens: zeros and
an empty digest. Added and control tokens are not recognised: their strings are plain text. Repeated rows and null ids are
documents of their own. Very long texts are one document, whole. Empty table: no rows. Further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable
from .packing import BYTE_LEVEL_PATTERN

#: Links and documents of a block.
BLOCK, BLOCK_DOCUMENTS = 4 << 20, 1 << 16
#: Pairs whose counts may be sent to all executors (some 60 MB).
BROADCAST_PAIRS = 1_000_000
#: Ids of either vocabulary are below 2^ID_BITS.
ID_BITS = 24
#: Tokens that are written out at once.
SLICE = 1 << 20

_ROWS = "block long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair long, plane int, dense boolean, docs binary"
_ROWS_ARROW = pa.schema(
    [("block", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64())]
    + [("groups_sha256", pa.string()), ("pair", pa.int64()), ("plane", pa.int32()), ("dense", pa.bool_()), ("docs", pa.binary())]
)

_loaded: dict[tuple[str, str], "Spelling"] = {}


class Spelling:
    """Both tokenizers, the bytes of their ids, and their ids written out with what may follow them."""

    def __init__(self, ranks_path: str, model_path: str):
        import sentencepiece
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.a = tiktoken.Encoding("plain", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_a[rank] = token
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.b = model.encode
        self.bytes_b = [bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode() for i in range(model.get_piece_size()) for piece in [model.id_to_piece(i)]]
        self.length_a, self.length_b = (np.array([len(x) for x in known]) for known in (self.bytes_a, self.bytes_b))
        self.written = [b"%d%s" % (i, end) for n, ends in ((len(self.bytes_a), b",|"), (len(self.bytes_b), b",;")) for i in range(n) for end in (ends[:1], ends[1:])]

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A and B; none if the text is empty or one of them spells it otherwise."""
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        if not text:
            return none
        whole = " " + text
        a, b = self.a(whole).astype(np.int64), self.b(text)
        want = whole.encode()
        if b"".join(map(self.bytes_b.__getitem__, b)) != want or b"".join(map(self.bytes_a.__getitem__, a.tolist())) != want:
            return none
        return a, np.array(b, np.int64)

    def links(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in a and in b of the tokens that end together; no token is empty, so ends are distinct and each end is one link."""
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        at = np.searchsorted(ends_a, ends_b)
        both = np.flatnonzero(ends_a[np.minimum(at, len(a) - 1)] == ends_b) if len(a) else at
        return at[both], both

    def groups_sha256(self, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> str:
        """Digest of the groups, written a1,a2|b1;a3|b2,b3."""
        if not len(a):
            return ""
        sizes_a, sizes_b = np.diff(in_a, prepend=-1), np.diff(in_b, prepend=-1)
        code_a, code_b = 2 * a, 2 * (b + len(self.bytes_a))
        code_a[in_a] += 1
        code_b[in_b] += 1
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.repeat(np.cumsum(sizes_b) - sizes_b, sizes_a)] = code_a
        order[np.arange(len(b)) + np.repeat(np.cumsum(sizes_a), sizes_b)] = code_b
        digest = hashlib.sha256()
        for at in range(0, len(order), SLICE):
            part = b"".join(map(self.written.__getitem__, order[at : at + SLICE].tolist()))
            digest.update(part if at + SLICE < len(order) else part[:-1])
        return digest.hexdigest()


def spelling(ranks_path: str, model_path: str) -> Spelling:
    """One of each a Python worker is kept."""
    if (ranks_path, model_path) not in _loaded:
        _loaded[ranks_path, model_path] = Spelling(ranks_path, model_path)
    return _loaded[ranks_path, model_path]


def _batch(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns.get(f.name), pa.Array) else pa.array(columns.get(f.name, [None] * n), f.type) for f in _ROWS_ARROW], schema=_ROWS_ARROW)


def posting_batches(block: int, keys: np.ndarray, n_docs: int):
    """Bitmaps of a block, by pair and plane. keys: a pair and the place of a document in the block (low 16 bits), once a link."""
    keys, times = np.unique(keys, return_counts=True)
    planes = np.arange(int(times.max(initial=0)).bit_length())
    at, plane = np.nonzero((times[:, None] >> planes) & 1)
    order = np.lexsort((plane, keys[at] >> np.uint64(16)))  # stable: places stay ascending
    at, plane = at[order], plane[order]
    pair, place = (keys[at] >> np.uint64(16)).astype(np.int64), (keys[at] & np.uint64(0xFFFF)).astype("<u2")
    starts = np.flatnonzero((np.diff(pair, prepend=-1) != 0) | (np.diff(plane, prepend=-1) != 0))
    ends = np.append(starts[1:], len(pair)) if len(starts) else starts
    n_bytes = -(-n_docs // 8)
    dense = 2 * (ends - starts) > n_bytes

    def bits(places: np.ndarray) -> bytes:
        flags = np.zeros(8 * n_bytes, bool)
        flags[places] = True
        return np.packbits(flags, bitorder="little").tobytes()

    raw = [bits(place[s:e]) if d else place[s:e].tobytes() for s, e, d in zip(starts.tolist(), ends.tolist(), dense.tolist())]
    for i in range(0, len(starts), 50_000):
        some = slice(i, i + 50_000)
        yield _batch(block=np.full(len(raw[some]), block), pair=pair[starts[some]], plane=plane[starts[some]].astype(np.int32), dense=dense[some], docs=raw[some])


def places(docs: bytes, dense: bool) -> np.ndarray:
    """Places of the documents of a bitmap."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(docs, np.uint8), bitorder="little")) if dense else np.frombuffer(docs, "<u2")


def popcount(bitmaps: list[tuple[bytes, bool]]) -> int:
    """Number of documents in an OR of bitmaps."""
    if len(bitmaps) == 1:
        docs, dense = bitmaps[0]
        return int(np.bitwise_count(np.frombuffer(docs, np.uint8)).sum()) if dense else len(docs) // 2
    merged = np.zeros(BLOCK_DOCUMENTS // 8, np.uint8)
    for docs, dense in bitmaps:
        if dense:
            merged[: len(docs)] |= np.frombuffer(docs, np.uint8)
        else:
            p = np.frombuffer(docs, "<u2")
            np.bitwise_or.at(merged, p >> 3, (1 << (p & 7)).astype(np.uint8))
    return int(np.bitwise_count(merged).sum())


def aligned(docs: DataFrame, ranks_path: str, model_path: str, id_col: str = "doc_id", text_col: str = "text", block: int | None = None) -> DataFrame:
    """Rows of documents (place, doc_id, counts, digest) and rows of bitmaps (pair, plane, docs) by block, written to the shared folder."""
    block_links = block or BLOCK

    def run(batches):
        know, number = spelling(ranks_path, model_path), TaskContext.get().partitionId() << 32
        rows, keys, held = [], [], 0

        def flush():
            if rows:
                doc, *counts, digest = zip(*rows)
                yield _batch(block=np.full(len(rows), number), place=np.arange(len(rows), dtype=np.int32), doc_id=pa.array(doc, pa.int64()), **dict(zip(("n_a", "n_b", "n_groups", "n_links"), counts)), groups_sha256=digest)
                yield from posting_batches(number, np.concatenate(keys), len(rows))

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                a, b = know.tokens(text.as_py())
                in_a, in_b = know.links(a, b)
                pair = (a[in_a].astype(np.uint64) << np.uint64(ID_BITS)) | b[in_b].astype(np.uint64)
                keys.append((pair << np.uint64(16)) | np.uint64(len(rows)))
                rows.append((doc.as_py(), len(a), len(b), len(in_b), len(in_b), know.groups_sha256(a, b, in_a, in_b)))
                held += len(in_b)
                if held >= block_links or len(rows) == BLOCK_DOCUMENTS:
                    yield from flush()
                    number, rows, keys, held = number + 1, [], [], 0
        yield from flush()

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return durable(slim.mapInArrow(run, _ROWS))


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, a, b, docs, links and best (no other A id has more links with this B id) from the bitmaps of aligned()."""

    def count(batches):
        key, held, links = None, [], 0
        for batch in batches:
            out = []
            for block, pair, plane, dense, docs in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (block, pair) != key:
                    if held:
                        out.append((key[1], popcount(held), links))
                    key, held, links = (block, pair), [], 0
                held.append((docs, dense))
                links += popcount(held[-1:]) << plane
            yield made(out)
        yield made([(key[1], popcount(held), links)] if held else [])

    def made(out):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else [[]] * 3)], names=["pair", "docs", "links"])

    counts = rows.where("pair is not null").select("block", "pair", "plane", "dense", "docs").mapInArrow(count, "pair long, docs long, links long").groupBy("pair").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links"))
    ids = counts.withColumns({"a": F.shiftright("pair", ID_BITS), "b": F.col("pair").bitwiseAND(F.lit((1 << ID_BITS) - 1))})
    return ids.withColumn("best", F.col("links") == F.max("links").over(Window.partitionBy("b")))  # at most A's vocabulary a window


def scored(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. Both inputs are written tables."""
    scores = counts.select("pair", "links", "best")
    wanted = rows.select(*[f.name for f in _ROWS_ARROW])
    if scores.count() <= BROADCAST_PAIRS:
        both = wanted.join(F.broadcast(scores), "pair", "left")  # a map: blocks stay together and in order
    else:
        met = wanted.where("pair is not null").join(scores, "pair")
        both = wanted.where("pair is null").withColumns({"links": F.lit(None).cast("long"), "best": F.lit(None).cast("boolean")}).unionByName(met)
        both = both.repartition("block").sortWithinPartitions("block", F.col("place").asc_nulls_last())
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    kinds = [pa.int64()] * 5 + [pa.string()] + [pa.int64()] * 2

    def run(batches):
        block, docs, best, total = None, [], None, None

        def flush():
            if docs:
                columns = [*zip(*docs), best[: len(docs)], total[: len(docs)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[*kept, "n_best", "count_sum"])

        for batch in batches:
            for at, pair, plane, dense, bitmap, links, is_best, *doc in zip(*(batch.column(i).to_pylist() for i in range(13))):
                if at != block:
                    yield from flush()
                    block, docs, best, total = at, [], np.zeros(BLOCK_DOCUMENTS, np.int64), np.zeros(BLOCK_DOCUMENTS, np.int64)
                if pair is None:
                    docs.append(doc)
                else:
                    found = places(bitmap, dense)
                    total[found] += links << plane
                    if is_best:
                        best[found] += 1 << plane
        yield from flush()

    given = both.select("block", "pair", "plane", "dense", "docs", "links", "best", *kept)
    return given.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")


def alignment(docs: DataFrame, ranks_path: str, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Align, count, score; see the module."""
    rows = aligned(docs, ranks_path, model_path, id_col, text_col)
    return scored(rows, durable(pair_counts(rows)))
