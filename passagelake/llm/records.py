"""Token ids in files of length-delimited binary records, with an index beside each file.

A record is one document::

    length   8 bytes   of the data, little-endian
    check    4 bytes   masked CRC-32 of the length
    data     document ids as 2-byte (vocabularies of 65,536 at most) or 4-byte integers
    check    4 bytes   masked CRC-32 of the data

The mask turns the sum right by 15 bits and adds a constant, so that a sum over data which
hold sums themselves stays telling. (The polynomial is that of zlib, which every Python
has.) ``part-00007.rec`` goes with ``part-00007.idx``: the offset of each record as 8 bytes,
so any record is read with one seek, in any order.

Documents are range-partitioned by id and sorted, each range becomes one file, and the
counts of the files' ids give every document its place in the whole.

Cases: a null or empty text is a document of the end id alone. Documents with a null id
come first; rows that repeat an id are neighbours, ordered by their text, and each is a record. An
empty table gives no file.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, save, shared_folder, text_of
from .files import Staged, open_store
from .tokens import encoder, spaced

MASK_DELTA = 0xA282EAD8
WRITTEN = "part int, first_id long, n_records long, n_ids long"
READ = "doc_id long, part int, row long, in_part long, n_tokens long, ids binary"
#: bytes of data read at a time, or one record
READ_AHEAD = 4 << 20


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    length = struct.pack("<Q", len(data))
    return b"".join(
        (length, struct.pack("<I", masked_crc(length)), data, struct.pack("<I", masked_crc(data)))
    )


def unframe(buffer: bytes, at: int = 0) -> tuple[bytes, int]:
    """The data of the record at ``at``, and where the next one begins; checks both sums."""
    head = buffer[at : at + 8]
    (length,) = struct.unpack("<Q", head)
    if struct.unpack_from("<I", buffer, at + 8)[0] != masked_crc(head):
        raise ValueError(f"damaged length at {at}")
    data = buffer[at + 12 : at + 12 + length]
    if len(data) < length or struct.unpack_from("<I", buffer, at + 12 + length)[0] != masked_crc(data):
        raise ValueError(f"damaged record at {at}")
    return data, at + 16 + length


def _names(part: int) -> tuple[str, str]:
    return f"part-{part:05d}.rec", f"part-{part:05d}.idx"


def write_records(
    docs: DataFrame, folder: str, vocabulary: str, end_id: int = 1, wide: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Write the files; returns one row for each: ``part, first_id, n_records, n_ids``."""
    kind = "<u4" if wide else "<u2"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    ordered = rows.repartitionByRange(
        partitions(docs.sparkSession), F.col("id").asc_nulls_first(), F.xxhash64("text")
    ).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode = encoder(vocabulary, spaced).encode
        out = index = first = None
        n_records = n_ids = 0
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for start, stop in slices_of(texts):
                flat, bounds = encode(texts.slice(start, stop - start))
                if not wide and len(flat) and int(flat.max()) >= 1 << 16:
                    raise ValueError("ids of more than 2 bytes: write them wide")
                for k in range(stop - start):
                    if out is None:
                        out, index = (Staged(folder, x) for x in _names(part))
                        first = ids[start + k].as_py()
                    document = np.empty(bounds[k + 1] - bounds[k] + 1, kind)
                    document[:-1] = flat[bounds[k] : bounds[k + 1]]
                    document[-1] = end_id
                    index.write(struct.pack("<Q", out.at))
                    own = ids[start + k].as_py()
                    out.write(frame(struct.pack("<q", NO_ID if own is None else own) + document.tobytes()))
                    n_records += 1
                    n_ids += len(document)
        if out is not None:
            out.commit()
            index.commit()
            yield pa.RecordBatch.from_pylist(
                [{"part": part, "first_id": first, "n_records": n_records, "n_ids": n_ids}],
                schema=pa.schema([("part", pa.int32()), ("first_id", pa.int64()), ("n_records", pa.int64()), ("n_ids", pa.int64())]),
            )

    return save(ordered.mapInArrow(write, WRITTEN), "record-files")


#: stands for a null id, which sorts first
NO_ID = -(2**63)


def slices_of(texts, characters: int = 2 << 20):
    """Ranges of an Arrow text column of about so many bytes, or one text."""
    import pyarrow.compute as pc

    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    start = size = 0
    for i, n in enumerate(lengths):
        if i > start and size + n > characters:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)


def _blocks(store, path: str, offsets: np.ndarray, size: int):
    """``(first record, records)`` of a file read front to back, some records at a time."""
    with store.open_input_file(path) as source:
        at = 0
        ends = np.append(offsets[1:], size)
        while at < len(offsets):
            stop = max(at + 1, int(np.searchsorted(ends, offsets[at] + READ_AHEAD, side="right")))
            source.seek(int(offsets[at]))
            buffer = source.read(int(ends[stop - 1] - offsets[at]))
            found, place = [], 0
            for _ in range(at, stop):
                data, place = unframe(buffer, place)
                found.append(data)
            yield at, found
            at = stop


def read_records(spark: SparkSession, folder: str, files: DataFrame, wide: bool = False) -> DataFrame:
    """``doc_id, start, row, n_tokens, ids`` (little-endian 4-byte integers) of every record.

    ``start`` counts the ids of all records before, over all files in their order.
    """
    kind = "<u4" if wide else "<u2"

    def read(batches):
        import pyarrow as pa

        store, root = open_store(folder)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                name, index = (f"{root}/{x}" for x in _names(part))
                with store.open_input_file(index) as source:
                    offsets = np.frombuffer(source.read(), "<u8").astype(np.int64)
                size = store.get_file_info(name).size
                before = 0
                for row, found in _blocks(store, name, offsets, size):
                    rows = {k: [] for k in ("doc_id", "part", "row", "in_part", "n_tokens", "ids")}
                    for k, data in enumerate(found):
                        (own,) = struct.unpack_from("<q", data)
                        ids = np.frombuffer(data, kind, offset=8)
                        rows["doc_id"].append(None if own == NO_ID else own)
                        rows["part"].append(part)
                        rows["row"].append(row + k)
                        rows["in_part"].append(before)
                        rows["n_tokens"].append(len(ids))
                        rows["ids"].append(ids.astype("<u4").tobytes())
                        before += len(ids)
                    yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([
                        ("doc_id", pa.int64()), ("part", pa.int32()), ("row", pa.int64()),
                        ("in_part", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]))

    # one row a file: few enough for one task to add up what lies before each
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("before"))
    spread = files.select("part").repartition(partitions(spark), "part")
    return (
        spread.mapInArrow(read, READ).join(F.broadcast(starts), "part")
        .select("doc_id", (F.col("before") + F.col("in_part")).alias("start"), "part", "row", "n_tokens", "ids")
    )


def read_selected(folder: str, part: int, rows: list[int], wide: bool = False) -> list[tuple[int | None, np.ndarray]]:
    """Records of one file by their place in it, in the order asked for (a shuffled read)."""
    store, root = open_store(folder)
    name, index = (f"{root}/{x}" for x in _names(part))
    with store.open_input_file(index) as source:
        offsets = np.frombuffer(source.read(), "<u8").astype(np.int64)
    ends = np.append(offsets[1:], store.get_file_info(name).size)
    found = []
    with store.open_input_file(name) as source:
        for row in rows:
            source.seek(int(offsets[row]))
            data, _ = unframe(source.read(int(ends[row] - offsets[row])))
            (own,) = struct.unpack_from("<q", data)
            found.append((None if own == NO_ID else own, np.frombuffer(data, "<u4" if wide else "<u2", offset=8)))
    return found


def record_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
