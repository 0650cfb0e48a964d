"""WARC archives: a writer with one gzip member a record, and a splittable reader.

The reader's tasks take byte ranges of the files.  A task scans its range for the gzip magic, validates a candidate by
decoding its header (the member must inflate to ``WARC/1.``), and owns the records that start inside its range, reading on
beyond the end of it where a record does.  Members carry a CRC-32, which is verified.

Files are read and written through ``pyarrow.fs``, so any store that it knows will do.  A task writes to a name of its own attempt and
moves the file when it is whole; a repeated task writes the same file again.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.shared import cut, work_dir

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a file that a task scans, and that it reads at once.
RANGE_BYTES, READ_BYTES = 8 << 20, 1 << 20
#: Payloads below this many bytes are never revisits.
LEAST_SHARED = 100
#: Rows of the table of shared payloads that is broadcast; a larger one is joined by shuffle.
BROADCAST_DIGESTS = 500_000
DATE = "2024-01-01T00:00:00Z"


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


# -- writing -----------------------------------------------------------------------------------------------


def revisits(pages: DataFrame, page_id: str, html: str, url: str) -> DataFrame:
    """page_id, url, html, digest, refers_to: which page of equal payloads is the response (refers_to null), and which others revisit it.

    Only digests are shuffled; of each group that shares a payload, one row with its smallest page_id is joined back.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("html"), F.sha2(payload, 256).alias("digest"))
    shared = rows.where(F.octet_length("html") >= LEAST_SHARED).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    shared = cut(shared.where("n > 1").select(F.col("digest").alias("of"), "first"))
    shared = F.broadcast(shared) if shared.count() <= BROADCAST_DIGESTS else shared
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(shared, rows["digest"] == shared["of"], "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = http + (payload if refers_to is None else b"")
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write rows of ``revisits`` as one archive a partition; return path, bytes and records of the files."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _opened(folder)
        files.create_dir(root, recursive=True)
        name = f"{root}/pages-{TaskContext.get().partitionId():06d}.warc.gz"
        own, n = f"{name}.{uuid.uuid4().hex}.tmp", 0
        with files.open_output_stream(own, compression=None) as out:
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    for row in batch.slice(start, 256).to_pylist():
                        out.write(gzip.compress(_record(row["page_id"], row["url"], row["html"].encode(), row["digest"], row["refers_to"]), 6, mtime=0))
                        n += 1
        size = files.get_file_info(own).size
        if n:
            files.move(own, name)
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name.rpartition('/')[2]}"], "bytes": [size], "records": [n]})
        else:
            files.delete_file(own)

    return cut(records.mapInArrow(run, "path string, bytes long, records long"))


# -- reading -----------------------------------------------------------------------------------------------


def archives(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes of the files that a path or pattern names; their content is not read."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"))


class _Member:
    """One gzip member read from a file, as far as it is asked for."""

    def __init__(self, file, at: int):
        self.file, self.at, self.inflate, self.text = file, at, zlib.decompressobj(31), io.BytesIO()

    def more(self) -> bool:
        """Inflate one more block; False at the end of the member or of the file."""
        if self.inflate.eof:
            return False
        self.file.seek(self.at)
        block = self.file.read(READ_BYTES if self.text.tell() else 4096)
        self.at += len(block)
        self.text.write(self.inflate.decompress(block))
        return bool(block)

    def starts_record(self) -> bool:
        try:
            while self.text.tell() < 7 and self.more():
                pass
        except zlib.error:
            return False
        return self.text.getvalue()[:7] == b"WARC/1."

    def whole(self) -> bytes:
        while self.more():
            pass
        if not self.inflate.eof:
            raise ValueError("a record ends before its gzip member does")
        return self.text.getvalue()

    @property
    def end(self) -> int:
        return self.at - len(self.inflate.unused_data)


def members(file, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the records that start in [start, stop)."""
    at = start
    while at < stop:
        file.seek(at)
        window = file.read(min(READ_BYTES, stop - at) + len(MAGIC) - 1)
        if (found := window.find(MAGIC)) < 0:
            at += max(1, len(window) - len(MAGIC) + 1)
            continue
        at += found
        if at >= stop:
            return
        member = _Member(file, at)
        if member.starts_record():
            content = member.whole()
            yield at, content
            at = member.end
        else:
            at += 1


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def parse(content: bytes) -> dict:
    """The fields of one record that ``read_records`` returns."""
    head, _, rest = content.partition(b"\r\n\r\n")
    warc = _fields(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n") if warc.get("content-type", "").startswith("application/http") else (b"", b"", block)
    fields = _fields(http)
    revisit = warc.get("warc-type") == "revisit"
    stated = warc.get("warc-payload-digest", "").rpartition(":")[2] or None
    digest = stated if revisit else hashlib.sha256(payload).hexdigest()
    return {
        "record_type": warc.get("warc-type"), "record_id": warc.get("warc-record-id"), "refers_to": warc.get("warc-refers-to"), "target_uri": warc.get("warc-target-uri"),
        "payload_bytes": int(fields.get("content-length", 0)) if revisit else len(payload), "payload_digest": digest, "stated_digest": stated, "payload": None if revisit else payload,
    }


RECORD = "path string, offset long, record_type string, record_id string, refers_to string, target_uri string, payload_bytes long, payload_digest string, stated_digest string, payload binary"


def read_records(files: DataFrame, payload: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of the archives in ``files`` (path, bytes), each once, whatever the ranges; see RECORD for the columns.

    ``payload_bytes`` and ``payload_digest`` are of the full payload: of a response as read, of a revisit as its headers state them.
    Empty files and files without records give no rows; other bytes between members are passed over; a damaged member is an error.
    """
    ranges = files.where("bytes > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    wanted = [f.split()[0] for f in RECORD.split(", ") if payload or not f.startswith("payload binary")]
    types = pa.schema([(f.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]]) for f in RECORD.split(", ")])
    types = pa.schema([types.field(w) for w in wanted])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, name = _opened(row["path"])
                with files.open_input_file(name) as file:
                    held, size = [], 0
                    for offset, content in members(file, row["start"], min(file.size(), row["start"] + range_bytes)):
                        record = {"path": row["path"], "offset": offset} | parse(content)
                        held.append({w: record[w] for w in wanted})
                        size += len(content) if payload else 200
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, types)
                            held, size = [], 0
                    yield pa.RecordBatch.from_pylist(held, types)

    # Ranges are few and heavy: each gets a task as far as there are slots.
    spread = ranges.repartition(max(1, files.sparkSession.sparkContext.defaultParallelism), "path", "start")
    return spread.mapInArrow(run, ", ".join(f for f in RECORD.split(", ") if f.split()[0] in wanted))


def round_trip(pages: DataFrame, page_id: str, html: str, url: str) -> DataFrame:
    """Write all pages as archives in the shared folder, read them back, and return page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html counts as empty.  A repeated smallest page_id is a response each time; a null page_id is never the smallest, unless all of the group's are null: then all are
    responses.  A null url leaves out the header.  An empty table gives no rows.
    """
    spark = pages.sparkSession
    files = write_archives(revisits(pages, page_id, html, url), f"{work_dir(spark)}/warc")
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    as_id = lambda c: F.when(number(c) != "", number(c).cast("long"))
    return read_records(files, payload=False).select(
        as_id(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", as_id(F.col("refers_to")).alias("refers_to")
    )
