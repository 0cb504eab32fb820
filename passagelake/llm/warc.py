"""WARC archives of web pages: written with revisits, indexed, and read by byte range.

Payloads are hashed, and of each digest that several pages of ``least_bytes`` or more share,
the smallest page id is written in full and the others as revisits of it. Every task writes
one archive, each record a gzip member of its own, and returns the index: file,
offset, length, URL and digest of each record. Reading starts from the index: the selected
records are sorted by file and offset, neighbours are joined into one range read, and the
members inside it unpacked.

Cases: a null html is an empty payload; a null URL is empty. Null page ids are never a smallest one unless all
are null. Rows that repeat the smallest page id and its payload are all responses. An empty
table writes nothing.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, partitions, save, shared_folder, text_of
from .files import Staged, open_store

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = (
    "file string, offset long, length long, url string, digest string, record_type string, page_id long"
)
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
#: of the file, records that begin in the same piece are read by one task
PIECE = 16 << 20
#: a gap of at most so many bytes is read over, and a range ends beyond so many
GAP, RANGE = 64 << 10, 4 << 20


def with_first_pages(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """``page_id, url, html, digest`` and ``first_id``, the page that holds the payload in
    full where that is another one."""
    hashed = pages.select(
        F.col("page_id").cast("long").alias("page_id"), text_of("url").alias("url"),
        text_of("html").cast("binary").alias("html"),
    ).withColumn("digest", F.sha2("html", 256))
    long_enough = F.octet_length("html") >= least_bytes
    shared = save(
        hashed.where(long_enough).groupBy("digest")
        .agg(F.count("*").alias("n"), F.min("page_id").alias("first_id"))
        .where("n > 1 and first_id is not null").select("digest", "first_id"),
        "shared-payloads",
    )
    joined = attach(hashed, shared, ["digest"], width=F.lit(120))
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id"))
    return joined.withColumn("first_id", F.when(long_enough & other, F.col("first_id")))


def _line(value: str) -> str:
    """A header's value on one line."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if set("\r\n") & set(value) else value


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id, url: str, html: bytes, digest: str, first_id) -> bytes:
    """One WARC record, packed as a gzip member."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(html)}\r\n\r\n"
    ).encode()
    block = http + (html if first_id is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first_id is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if first_id is not None:
        head += [f"WARC-Refers-To: {_urn(first_id)}", f"WARC-Profile: {PROFILE}"]
    whole = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(whole, compresslevel=6, mtime=0)


def parse(whole: bytes) -> dict:
    """Page id, type, URL, digest, payload and its full length, and what a revisit refers to."""
    head, _, rest = whole.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))

    def page(urn: str | None):
        name = urn and urn.removeprefix("<urn:page:").removesuffix(">")
        return None if name in (None, "none") else int(name)

    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
    return {
        "page_id": page(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest,
        "record_type": fields["WARC-Type"], "refers_to": page(fields.get("WARC-Refers-To")),
        "url": fields["WARC-Target-URI"], "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 100) -> DataFrame:
    """Write the archives; returns their index as a table."""
    rows = with_first_pages(pages, least_bytes).select("page_id", "url", "html", "digest", "first_id")

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        name = f"pages-{TaskContext.get().partitionId():05d}.warc.gz"
        out = None
        names = [x.split()[0] for x in INDEX.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            index: list[tuple] = []
            columns = [batch.column(i) for i in range(5)]
            for k in range(batch.num_rows):
                page_id, url, html, digest, first_id = (c[k].as_py() for c in columns)
                out = out or Staged(folder, name)
                data = record(page_id, url, html, digest, first_id)
                kind = "response" if first_id is None else "revisit"
                index.append((name, out.at, len(data), url, digest, kind, page_id))
                out.write(data)
            if index:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index), kinds)], names=names)
        if out is not None:
            out.commit()

    return save(rows.mapInArrow(write, INDEX), "warc-index")


def ranges(records: list[tuple[int, int]]):
    """``(start, stop, first, last)``: byte ranges that cover sorted ``(offset, length)`` pairs."""
    first = 0
    while first < len(records):
        start, last = records[first][0], first
        stop = start + records[first][1]
        while last + 1 < len(records) and records[last + 1][0] - stop <= GAP and stop - start < RANGE:
            last += 1
            stop = max(stop, records[last][0] + records[last][1])
        yield start, stop, first, last + 1
        first = last + 1


def read_archives(selected: DataFrame, folder: str) -> DataFrame:
    """The records that a selection of the index names."""
    spark: SparkSession = selected.sparkSession
    ordered = (
        selected.select("file", "offset", "length", F.expr(f"offset div {PIECE}").alias("piece"))
        .repartition(partitions(spark), "file", "piece").sortWithinPartitions("file", "offset")
        .select("file", "offset", "length")
    )

    def read(batches):
        import pyarrow as pa

        store, root = open_store(folder)
        schema = pa.schema([
            ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
            ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary()),
        ])
        for batch in batches:
            by_file: dict[str, list[tuple[int, int]]] = {}
            for name, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                by_file.setdefault(name, []).append((offset, length))
            for name, records in by_file.items():
                with store.open_input_file(f"{root}/{name}") as source:
                    for start, stop, first, last in ranges(records):
                        source.seek(start)
                        buffer = source.read(stop - start)
                        found = [
                            parse(zlib.decompress(buffer[at - start : at - start + size], 31))
                            for at, size in records[first:last]
                        ]
                        yield pa.RecordBatch.from_pylist(found, schema=schema)

    return ordered.mapInArrow(read, READ)


def archive_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
