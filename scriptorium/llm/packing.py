"""Packing documents into fixed-length token sequences by concatenating and cutting.

Documents are tokenized once, into a table in the shared folder whose partitions and row order are then fixed. The
first pass adds up the tokens of each partition and prefix-sums those totals, one row a partition; the second pass
walks each partition from its global offset and cuts windows of `length` ids. A document that crosses a window or
partition boundary is described by several pieces, so neighbouring partitions share a sequence through their boundary
records and only the very last sequence of the whole corpus is padded.

Nothing is shuffled but one total a partition. Ids are kept as 16-bit numbers while the vocabulary allows it.

Edge cases. The literal of an added token (<|endoftext|>) in a text is that token's id, as the tokenizer has it. Null text
counts as empty: only the end id. A null document id stays null. Repeated rows are packed as often as they occur. Empty table:
no pieces. Further columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import json
import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

#: Fixed value: the pre-tokenizing pattern of the byte-level vocabulary, in its form without backtracking.
BYTE_LEVEL_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

#: Bytes of ids that a task gathers before it hands them on.
FLUSH = 4 << 20

_encoders: dict[tuple[str, str], object] = {}


def byte_level_encoder(ranks_path: str, pattern: str = BYTE_LEVEL_PATTERN):
    """A text -> ids function over a file of base64 token and rank lines; one a Python worker is kept.

    The added tokens of the tokenizer's JSON file beside it (same name) are ids of their own wherever a text holds them.
    """
    import tiktoken

    if (ranks_path, pattern) not in _encoders:
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        added = added_tokens(os.path.splitext(ranks_path)[0] + ".json")
        ranks = {token: rank for token, rank in ranks.items() if rank not in added.values()}
        encoding = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
        _encoders[ranks_path, pattern] = functools.partial(encoding.encode, allowed_special="all", disallowed_special=()) if added else encoding.encode_ordinary
    return _encoders[ranks_path, pattern]


def added_tokens(json_path: str) -> dict[str, int]:
    """Literal and id of the added tokens of a tokenizer file. None without such a file."""
    if not os.path.exists(json_path):
        return {}
    with open(json_path, encoding="utf-8") as f:
        found = json.load(f).get("added_tokens") or []
    # What the encoder does not do is refused, not left out.
    odd = [t["content"] for t in found if t.get("lstrip") or t.get("rstrip") or t.get("single_word")]
    if odd:
        raise ValueError(f"added tokens that strip or match whole words: {odd}")
    return {t["content"]: int(t["id"]) for t in found}


def tokenized(docs: DataFrame, ranks_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", pattern: str = BYTE_LEVEL_PATTERN, wide: bool = False) -> DataFrame:
    """doc_id, part, n and ids (little-endian 16-bit ids, 32-bit if wide, then end_id), written to the shared folder."""
    kind = "<u4" if wide else "<u2"

    def run(batches):
        encode, part, end = byte_level_encoder(ranks_path, pattern), TaskContext.get().partitionId(), [end_id]
        size = np.dtype(kind).itemsize

        def made(docs, ids):
            return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array([part] * len(ids), pa.int32()), pa.array([len(x) // size for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "part", "n", "ids"])

        for batch in batches:
            docs, ids, held = [], [], 0
            for doc, text in zip(batch.column(0), batch.column(1)):
                docs.append(doc.as_py())
                ids.append(np.array(encode(text.as_py() or "") + end, dtype=kind).tobytes())
                held += len(ids[-1])
                if held > FLUSH:
                    yield made(docs, ids)
                    docs, ids, held = [], [], 0
            yield made(docs, ids)
            pa.default_memory_pool().release_unused()

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return durable(slim.mapInArrow(run, "doc_id long, part int, n long, ids binary"))


def concat_and_cut(tokens: DataFrame, length: int = 2048, wide: bool = False) -> DataFrame:
    """Pieces of tokenized(): doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    kind = "<u4" if wide else "<u2"

    def run(batches):
        part, at = None, 0
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], names=names)
        for batch in batches:
            rows, held = [], 0
            for doc, p, first, raw in zip(batch.column(0), batch.column(1), batch.column(2), batch.column(3)):
                if p.as_py() != part:
                    part, at = p.as_py(), first.as_py()
                ids = np.frombuffer(raw.as_buffer(), dtype=kind)
                start, n, doc = 0, len(ids), doc.as_py()
                while start < n:
                    sequence, offset = divmod(at, length)
                    size = min(n - start, length - offset)
                    rows.append((doc, start, size, ids[start : start + size].astype("<u4").tobytes(), n, sequence, offset))
                    start, at, held = start + size, at + size, held + 4 * size
                    if held > FLUSH:
                        yield made(rows)
                        rows, held = [], 0
            yield made(rows)
            pa.default_memory_pool().release_unused()

    # One row a partition of the tokens: the bound of what is sent to all executors.
    placed = tokens.join(F.broadcast(base), "part").select("doc_id", "part", "base", "ids")
    return placed.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def pack(docs: DataFrame, ranks_path: str, end_id: int = 1, length: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize, concatenate and cut; see the module."""
    return concat_and_cut(tokenized(docs, ranks_path, end_id, id_col, text_col), length)
