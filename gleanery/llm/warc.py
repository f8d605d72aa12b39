"""WARC archives, written with an index and read back by byte ranges."""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import ship, written
from gleanery.session import scratch_path

#: Payloads of fewer bytes are always stored.
REVISIT_FROM = 1000
#: Bytes of payload that an archive holds at about most.
ARCHIVE_BYTES = 64 << 20
#: Records whose ranges are this close in one archive are read at once, up to a read's limit.
GAP, READ = 64 << 10, 8 << 20
DATE = "1970-01-01T00:00:00Z"

INDEX = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"


def decisions(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to``, distinct.

    Of equal payloads (same SHA-1 and length) of at least ``revisit_from`` bytes
    the one with the largest id is the response that the others revisit.
    """
    html = F.coalesce("html", F.lit(""))
    facts = written(pages.select("page_id", F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html).alias("payload_digest")), "payloads").distinct()
    many = facts.filter(F.col("payload_bytes") >= revisit_from).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    joined = facts.join(many, ["payload_digest", "payload_bytes"], "left")
    refers = F.when(F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    return joined.select("page_id", "payload_bytes", "payload_digest", F.when(refers.isNull(), "response").otherwise("revisit").alias("record_type"), refers.alias("refers_to"))


def record(row: dict) -> bytes:
    """One record, compressed by itself."""
    payload = row["html"] if row["record_type"] == "response" else b""
    uri = (row["url"] or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <urn:page:{row['page_id']}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}",
        f"X-Payload-Length: {row['payload_bytes']}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(payload)}",
    ]
    if row["refers_to"] is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{row['refers_to']}>"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n", 1, mtime=0)


def parse(data: bytes) -> dict:
    """A record's fields and payload; raises ValueError where they disagree."""
    plain = gzip.decompress(data)
    head, _, rest = plain.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    field = dict(x.split(": ", 1) for x in lines[1:])
    n = int(field["Content-Length"])
    payload, tail = rest[:n], rest[n:]
    if lines[0] != "WARC/1.1" or tail != b"\r\n\r\n":
        raise ValueError(f"not a record: {lines[0]!r}")

    def ident(name: str) -> int | None:
        number = field[name][len("<urn:page:") : -1] if name in field else "None"
        return None if number == "None" else int(number)

    out = {
        "page_id": ident("WARC-Record-ID"), "url": field["WARC-Target-URI"], "record_type": field["WARC-Type"], "payload_digest": field["WARC-Payload-Digest"].removeprefix("sha1:"),
        "payload_bytes": int(field["X-Payload-Length"]), "refers_to": ident("WARC-Refers-To"), "payload": payload,
    }
    if out["record_type"] == "response" and (len(payload) != out["payload_bytes"] or hashlib.sha1(payload).hexdigest() != out["payload_digest"]):
        raise ValueError(f"the payload of page {out['page_id']} differs from its digest")
    return out


def write_archives(pages: DataFrame, folder: str, *, revisit_from: int = REVISIT_FROM, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row to ``.warc.gz`` files in ``folder``; the index, one row per record.

    ``folder`` is any file system that pyarrow opens.  A task writes archives
    under names of its own and an index row only after its archive is closed,
    so an archive of a lost task is never referred to.  The index is written
    to the shared folder; its rows are ``page_id, url, payload_bytes,
    payload_digest, record_type, refers_to, archive, offset, length``.

    NULL html is an empty payload, a NULL url an empty one.  Repeated rows are
    written each.  A NULL page id is smaller than any other.  Rows with one id
    and one payload are no revisits of each other.
    """
    ship()
    known = decisions(pages, revisit_from)
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("html"), F.sha1(F.coalesce("html", F.lit(""))).alias("_sha"))
    k = known.withColumnsRenamed({"page_id": "_id"})
    rows = rows.join(k, rows["page_id"].eqNullSafe(k["_id"]) & (rows["_sha"] == k["payload_digest"])).select("page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        out, index, name, at = None, [], "", 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pylist(index, INDEX_ARROW)

        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, index, at = system.open_output_stream(f"{base}/{name}", compression=None), [], 0
                data = record(row)
                out.write(data)
                index.append({c: row[c] for c in names} | {"archive": name, "offset": at, "length": len(data)})
                at += len(data)
                if at >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    INDEX_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
    make_folder(pages.sparkSession, folder)
    return written(rows.mapInArrow(run, INDEX), "warc-index")


def make_folder(spark: SparkSession, folder: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)


def read_records(index: DataFrame, folder: str, *, gap: int = GAP, most: int = READ, with_payload: bool = False) -> DataFrame:
    """The records that ``index`` selects, read from their archives and checked.

    ``index`` has ``archive, offset, length`` (any selection of rows).  Rows are
    sorted by archive and offset; ranges less than ``gap`` bytes apart are one
    read of at most ``most`` bytes, or one record.  A row whose archive is
    NULL gives nothing; a row that occurs twice is read once and given twice.
    """
    ship()
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        name, source, group = "", None, []

        def fetch() -> pa.RecordBatch:
            start, end = group[0][0], max(at + n for at, n in group)
            data = source.read_at(end - start, start)
            found = [parse(data[at - start : at - start + n]) for at, n in group]
            kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], kinds[c]) for c in wanted], wanted)

        for batch in batches:
            for archive, at, n in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
                if group and (archive != name or at - max(p + m for p, m in group[-1:]) > gap or at + n - group[0][0] > most):
                    yield fetch()
                    group = []
                if archive != name:
                    name, source = archive, system.open_input_file(f"{base}/{archive}")
                group.append((at, n))
        if group:
            yield fetch()

    wanted = [*columns, *["payload"] * with_payload]
    ranges = index.filter(F.col("archive").isNotNull()).select("archive", "offset", "length")
    # neighbouring ranges share a task; a large archive may be several tasks' work
    part = F.floor(F.col("offset") / READ)
    ordered = ranges.repartition("archive", part).sortWithinPartitions("archive", "offset")
    made = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return ordered.mapInArrow(run, made)


def located(folder: str) -> str:
    """``folder`` as an address that pyarrow opens."""
    if folder.startswith("/"):
        return f"file://{folder}"
    return f"file:///{folder[6:].lstrip('/')}" if folder.startswith("file:/") else folder


def archived(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read every record back."""
    folder = located(scratch_path(pages.sparkSession, "warc"))
    return read_records(write_archives(pages, folder, **options), folder)
