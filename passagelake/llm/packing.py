"""Documents packed into sequences in the order of a space-filling curve.

Each document's tokens are counted into a hashed vector, which a fixed random projection
takes to a few dimensions; its cell's place on the Hilbert curve through them is its key.
Documents are range-sorted by key, so like ones are neighbours, and laid end to end along the
curve. Every ``length`` ids one sequence ends and the next begins: a document that crosses is
cut, and only the last sequence of all is short.

Ids are encoded once and written in place; what is sorted and summed is one narrow row a
document, and a document's place then meets its ids again.

Cases: a null or empty text is the end id alone. Ids may be null; every row is a document of
its own, also if it repeats another. Equal keys are ordered by id, then by text. An empty table has no pieces.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, keyed, partitions, save
from .records import slices_of
from .tokens import encoder, space_led

HASHED, DIMENSIONS, BITS, SEED = 256, 4, 15, 20240601


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row's cell (``bits`` bits in each dimension).

    Skilling, "Programming the Hilbert curve" (2004): undo the rotations from the
    highest bit down, Gray-code across the dimensions, and interleave the bits.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def projected_cells(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The cell of each document: hashed token counts, scaled to length 1, projected."""
    n = len(bounds) - 1
    mixed = flat.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bucket = (mixed >> np.uint64(32)).astype(np.int64) % HASHED
    sign = np.where((mixed >> np.uint64(63)) == 0, 1.0, -1.0)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    vectors = np.bincount(owner * HASHED + bucket, weights=sign, minlength=n * HASHED).reshape(n, HASHED)
    norm = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
    vectors /= np.where(norm == 0, 1, norm)
    axes = np.random.default_rng(SEED).standard_normal((HASHED, DIMENSIONS))
    spread = 0.5 * (1 + np.tanh(vectors @ axes))
    return np.minimum((spread * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def encoded(docs: DataFrame, vocabulary: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """A written table: ``_n`` (row), ``_id, _tie, doc_id, n_tokens, curve`` and the ids as 2-byte integers."""
    rows = keyed(docs, id_col, text_col).select("_id", "_tie", F.col(f"_row.{id_col}").cast("long").alias("doc_id"), "_text")
    id_type = rows.schema["_id"].dataType.simpleString()

    def encode(batches):
        import pyarrow as pa

        look_up = encoder(vocabulary, space_led).encode
        for batch in batches:
            texts = batch.column(3)
            for start, stop in slices_of(texts):
                flat, bounds = look_up(texts.slice(start, stop - start))
                if len(flat) and int(flat.max()) >= 1 << 16:
                    raise ValueError("ids of more than 2 bytes")
                ids = [
                    np.append(flat[bounds[k] : bounds[k + 1]], end_id).astype("<u2").tobytes()
                    for k in range(stop - start)
                ]
                keys = hilbert_key(projected_cells(flat, bounds), BITS)
                head = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays(
                    [*(head.column(i) for i in range(3)), pa.array(np.diff(bounds) + 1), pa.array(keys), pa.array(ids, pa.binary())],
                    names=["_id", "_tie", "doc_id", "n_tokens", "curve", "ids"],
                )

    schema = f"_id {id_type}, _tie long, doc_id long, n_tokens long, curve long, ids binary"
    return save(
        rows.mapInArrow(encode, schema).withColumn("_n", F.monotonically_increasing_id()), "encoded"
    )


def places(table: DataFrame) -> DataFrame:
    """``_n, place``: the ids before each document along the curve."""
    order = ["curve", "_id", "_tie", "_n"]
    ranged = save(
        table.select(*order, "n_tokens").repartitionByRange(partitions(table.sparkSession), *order)
        .withColumn("part", F.spark_partition_id()),
        "curve",
    )
    totals = ranged.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row a partition
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.select("_n", "part", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("within"))
    return summed.join(F.broadcast(starts), "part").select("_n", (F.col("before") + F.col("within")).alias("place"))


def pack(
    docs: DataFrame, vocabulary: str, length: int = 1024, end_id: int = 0,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The pieces: ``doc_id, start, length, doc_tokens, sequence_id, offset`` and their ids.

    ``start`` counts the document's ids before the piece, ``offset`` those of its sequence;
    ``ids`` are little-endian 4-byte integers.
    """
    table = encoded(docs, vocabulary, end_id, id_col, text_col)
    placed = attach(
        table.select("_n", "doc_id", "n_tokens", "ids"), save(places(table), "places"), ["_n"], "inner", F.lit(40)
    ).select("doc_id", "n_tokens", "place", "ids")

    def cut(batches):
        import pyarrow as pa

        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        kinds = [pa.int64()] * 6 + [pa.binary()]
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            held = 0
            columns = [batch.column(i) for i in range(4)]
            for k in range(batch.num_rows):
                own, n, place = (columns[i][k].as_py() for i in range(3))
                ids = np.frombuffer(columns[3][k].as_buffer(), "<u2")
                at = 0
                while at < n:
                    sequence, offset = divmod(place + at, length)
                    size = min(length - offset, n - at)
                    piece = ids[at : at + size].astype("<u4").tobytes()
                    for column, value in zip(rows, (own, at, size, n, sequence, offset, piece)):
                        column.append(value)
                    at += size
                    held += len(piece)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names=names)
                        rows, held = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names=names)

    return placed.mapInArrow(
        cut, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, n_ids, ids``: the pieces of each sequence joined (4-byte integers)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), parts.alias("p")).select(
        "sequence_id", "n_ids", F.unhex(F.array_join("p.ids", "")).alias("ids")
    )
