"""WARC archives with revisit records in place of repeated payloads.

Headers (page id, size, SHA-1 of the payload) are shuffled by digest; of equal payloads of at least
``least`` bytes the one with the largest page id becomes the response and the others revisits that refer
to it. The table of repeated digests reaches the payloads by broadcast while it is small enough; beyond,
payloads are shuffled once, by digest and salt. Each record is a gzip member of its own,
as is usual for WARC files, with headers written afresh. Readers inflate one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import as_bytes, small_batches
from .workspace import Workspace, attempt_name, open_fs

#: Rows of repeated digests (about 60 bytes each) that a broadcast may hold.
BROADCAST_ROWS = 200_000
#: Parts that the rows of a digest are dealt to where payloads are shuffled.
_SALTS = 16
_FILE_BYTES = 64 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORDS = "record_id string, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to_id string"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _field(value: str) -> str:
    """A header's value on one line: control characters and spaces percent-coded."""
    return quote(value, safe="!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    http = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload)]
    block = b"\r\n".join(http) + b"\r\n\r\n" + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_field(url)}")
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, payload behind the HTTP header)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:60]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def members(file, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of an open file, inflated one at a time."""
    data, inflate, out = b"", zlib.decompressobj(31), []
    while True:
        if not data:
            data = file.read(chunk)
            if not data:
                if out:
                    raise ValueError("the archive ends within a record")
                return
        out.append(inflate.decompress(data))
        data = inflate.unused_data
        if inflate.eof:
            yield b"".join(out)
            out, inflate = [], zlib.decompressobj(31)


def resolve_revisits(pages: DataFrame, least: int = 1000, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """pages (page_id, url, html) with payload (binary), digest, revisit and refers_to.

    A null html is an empty payload. Rows that repeat the response's page_id are responses too; where
    all page ids of a digest are null, all its rows are responses.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")).withColumn("digest", F.sha1("payload"))
    heads = rows.where(F.octet_length("payload") >= least).select("digest", "page_id")
    repeated = heads.groupBy("digest").agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("n")).where("n > 1 and winner is not null").select("digest", "winner")
    repeated = Workspace(pages.sparkSession, "digests").table(repeated)
    # Measured, not assumed: beyond the bound payloads are shuffled once, salted, as a digest may hold a third of them.
    small = repeated.limit(broadcast_rows + 1).count() <= broadcast_rows
    if small:
        joined = rows.join(F.broadcast(repeated), "digest", "left")
    else:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(_SALTS)))
        every = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))))
        joined = salted.join(every.hint("merge"), ["digest", "salt"], "left").drop("salt")
    revisit = F.coalesce(F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner")), F.lit(False))
    return joined.select("page_id", "url", "payload", "digest", revisit.alias("revisit"), F.when(revisit, F.col("winner")).alias("refers_to"))


def write_archives(resolved: DataFrame, work: Workspace, date: str | None = None) -> DataFrame:
    """Write .warc.gz files of bounded size to the shared folder; returns their manifest."""
    folder = work.folder("warc")
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, size, n, done = None, "", 0, 0, []
        for batch in small_batches(batches, "payload"):
            pages, urls, digests, revisits, refs = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("page_id", "url", "digest", "revisit", "refers_to"))
            for page, url, payload, digest, revisit, ref in zip(pages, urls, as_bytes(batch.column(batch.schema.get_field_index("payload"))), digests, revisits, refs):
                if out is None:
                    fs, top = open_fs(folder)
                    fs.create_dir(top, recursive=True)
                    path, size, n = attempt_name("pages", ".warc.gz"), 0, 0
                    out = fs.open_output_stream(f"{top}/{path}", compression=None)
                pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = pack.compress(make_record(page, url, payload, digest, ref, revisit, date)) + pack.flush()
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= _FILE_BYTES:
                    out.close()
                    out = None
                    done.append((f"{folder}/{path}", n))
        if out is not None:
            out.close()
            done.append((f"{folder}/{path}", n))
        if done:
            yield pa.RecordBatch.from_pydict({"path": [p for p, _ in done], "n_records": pa.array([n for _, n in done], pa.int64())})

    return work.table(resolved.mapInArrow(write, "path string, n_records long"), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """A row for each record; a response's payload is held against its digest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _RECORDS.split(", ")]
        for path in (p for b in batches for p in b.column(0).to_pylist()):
            fs, at = open_fs(path)
            rows = []
            with fs.open_input_stream(at, compression=None) as file:
                for raw in members(file):
                    f, payload = parse_record(raw)
                    digest = base64.b32decode(f["warc-payload-digest"].partition(":")[2]).hex()
                    kind = f["warc-type"]
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{path}: {f['warc-record-id']} doesn't match its digest")
                    page = f.get("warc-page-id")
                    rows.append((f["warc-record-id"], kind, int(page) if page else None, f.get("warc-target-uri"), len(payload) if kind == "response" else None, digest, f.get("warc-refers-to")))
                    if len(rows) == 5000:
                        yield _batch(names, rows)
                        rows = []
            if rows:
                yield _batch(names, rows)

    # An explicit count, as Spark would join tasks with so little input into one.
    spark = manifest.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return manifest.select("path").repartition(tasks, F.col("path")).mapInArrow(read, _RECORDS)


def _batch(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    long = {"page_id", "payload_bytes"}
    return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64() if k in long else pa.string()) for k, v in zip(names, zip(*rows))})


def resolved_records(records: DataFrame) -> DataFrame:
    """Revisits joined to the responses they refer to, for size and page id of the payload.

    Repeated pages give a response more than once under one record id, so ids are made distinct first;
    the revisits of one response may be many, and the join can split them."""
    responses = records.where("record_type = 'response'").groupBy("record_id").agg(F.first("page_id").alias("o_page"), F.first("payload_bytes").alias("o_bytes"))
    revisits = records.where("record_type = 'revisit'").join(responses.withColumnRenamed("record_id", "refers_to_id"), "refers_to_id", "left")
    whole = revisits.select("page_id", F.col("o_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("o_page").alias("refers_to"))
    own = records.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return own.unionByName(whole)


def revisit_report(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Archive pages, read the archives back, and give a row per record."""
    work = Workspace(pages.sparkSession, "warc")
    records = work.table(read_archives(write_archives(resolve_revisits(pages, least), work)), "records")
    return resolved_records(records)
