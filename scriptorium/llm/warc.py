"""WARC archives: written with an index first, read back by coalesced byte ranges.

Writing. Records with equal payloads of at least `least` bytes are stored once: the one with the smallest page id is a response,
the others are revisits that refer to it. Every task writes its rows to one archive in the shared folder, a gzip member per
record, under a name of its own (a retried task writes a new file), and returns one index row per record: file, offset,
length, url, digest. The index is a written table; archives of failed attempts are in no index.

Reading. Selected index rows are dealt by file and stretch of file, sorted by offset, and neighbouring ranges are read
together: gaps up to GAP bytes are read over, a read ends at READ bytes. Each member is parsed as it lies in the
archive, its payload digest is checked against the header, and what is returned comes from the record.

Scale. Only digests are shuffled, and per digest the smallest id is aggregated; digests that repeat are sent to all executors, or,
beyond BROADCAST_DIGESTS of them, payloads are shuffled once by digest and a salt, so that a hot payload is spread. Payloads are
never collected; a task holds one read and one record. A very long page is one record, held whole.

Edge cases. Null html is an empty payload; null url is written as urn:page:<id>. Control characters and blanks in a url are
escaped. A null page id is written and read as null; it never refers to another page and is never referred to. Rows that repeat the page id of a response
are responses too. Empty table: no archives, empty index. Further columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, shared_folder

SALTS = 32
#: Repeated digests that may be sent to all executors (some 50 MB); more meet the payloads by a shuffle.
BROADCAST_DIGESTS = 500_000
#: Bytes of archives that a task reads back, about.
TASK = 64 << 20
GAP, READ, STRETCH = 64 << 10, 8 << 20, 32 << 20

_INDEX = "file string, offset long, length long, url string, payload_digest string, page_id long, record_type string"
_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _store(uri: str):
    """File system and path of a folder or file that executors reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "", 1))


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, record_type: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no payload."""
    head = [
        ("WARC-Type", record_type),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Target-URI", quote(url, safe="".join(map(chr, range(33, 127)))) if url is not None else f"urn:page:{'' if page_id is None else page_id}"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Payload-Length", str(size)),
    ]
    if record_type == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    body = b"" if record_type == "revisit" else payload
    head += [("Content-Type", "text/html"), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of a record; its payload digest is worked out anew for a response."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    page = lambda name: int(x) if (x := fields.get(name, "<urn:page:>")[10:-1]) else None
    body = rest[: int(fields["Content-Length"])]
    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["WARC-Payload-Length"])
    if fields["WARC-Type"] == "response":
        if hashlib.sha256(body).hexdigest() != digest or len(body) != size:
            raise ValueError("payload digest differs from the header")
    return {"page_id": page("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": page("WARC-Refers-To"), "payload": body}


def with_record_type(pages: DataFrame, id_col: str, html_col: str, url_col: str, least: int) -> DataFrame:
    """page_id, url, payload, digest, size, record_type and refers_to."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    first = rows.where((F.col("size") >= least) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    first = durable(first)
    if first.count() <= BROADCAST_DIGESTS:
        both = rows.join(F.broadcast(first), "digest", "left")
    else:
        salted = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"], "left").drop("salt")
    again = F.col("first").isNotNull() & (F.col("page_id") != F.col("first"))
    return both.withColumns({"record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("first"))}).drop("first")


def write_archives(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", least: int = 100, level: int = 3, folder: str | None = None) -> DataFrame:
    """Writes the archives and returns their index, a written table."""
    folder = folder or f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    rows = with_record_type(pages, id_col, html_col, url_col, least)

    def run(batches):
        out = uri = None
        at = 0
        for batch in batches:
            if out is None:
                store, path = _store(folder)
                name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                store.create_dir(path, recursive=True)
                out, uri = store.open_output_stream(f"{path}/{name}", compression=None), f"{folder}/{name}"
            index = []
            for row in zip(*(batch.column(i) for i in range(7))):
                page_id, url, digest, size, kind, refers_to = (row[i].as_py() for i in (0, 1, 3, 4, 5, 6))
                raw = gzip.compress(record_bytes(page_id, url, row[2].as_py(), digest, size, kind, refers_to), level, mtime=0)
                out.write(raw)
                index.append((uri, at, len(raw), url, digest, page_id, kind))
                at += len(raw)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index) if index else [[]] * 7, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()))], names=["file", "offset", "length", "url", "payload_digest", "page_id", "record_type"])
        if out is not None:
            out.close()

    return durable(rows.select("page_id", "url", "payload", "digest", "size", "record_type", "refers_to").mapInArrow(run, _INDEX))


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records that the index rows name, as they lie in the archives."""
    placed = index.select("file", "offset", "length").withColumn("stretch", F.floor(F.col("offset") / STRETCH))
    spark = index.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, (placed.agg(F.sum("length")).first()[0] or 0) // TASK + 1)
    dealt = placed.repartition(tasks, "file", "stretch").sortWithinPartitions("file", "offset")

    def ranges(rows):
        """Neighbouring (file, offset, length) rows that one read covers."""
        held = []
        for row in rows:
            end = held[-1][1] + held[-1][2] if held else 0
            if held and (row[0] != held[0][0] or row[1] - end > GAP or row[1] + row[2] - held[0][1] > READ):
                yield held
                held = []
            held.append(row)
        if held:
            yield held

    def run(batches):
        opened, source = None, None
        rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(3))))
        out, held = [], 0
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array([x[n] for x in out], t) for n, t in zip(names, kinds)], names=names)
        for group in ranges(rows):
            if group[0][0] != opened:
                store, path = _store(group[0][0])
                source, opened = store.open_input_file(path), group[0][0]
            first, end = group[0][1], max(r[1] + r[2] for r in group)
            source.seek(first)
            data = memoryview(source.read(end - first))
            for _, offset, length in group:
                record = parse_record(zlib.decompress(data[offset - first : offset - first + length], wbits=31))
                if not with_payload:
                    record["payload"] = None
                held += len(record["payload"] or b"")
                out.append(record)
                if held > READ or len(out) >= 10_000:
                    yield batch_of()
                    out, held = [], 0
        if out:
            yield batch_of()

    return dealt.select("file", "offset", "length").mapInArrow(run, _RECORD)


def selected(index: DataFrame, condition: Column) -> DataFrame:
    """Index rows of the records wanted."""
    return index.where(condition)
