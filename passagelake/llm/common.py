"""What the operators share: row keys, saved tables, joins against a side of checked size."""

from __future__ import annotations

import ctypes
import gc
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workspace import save, shared_folder

__all__ = [
    "ASCII_SPACE", "attach", "folded_bytes", "keyed", "partitions", "save", "shared_folder",
    "table", "text_of", "worker_cache",
]

#: the white space of the contracts: space and U+0009 to U+000D
ASCII_SPACE = " \t\n\x0b\f\r"

#: the largest side, in rows and in estimated bytes, that is sent to every executor
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 48 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_row`` (the whole input row), ``_id``, ``_tie`` and ``_text``.

    ``_id`` and ``_tie`` name a row: the id (an integer, or else text; null is the smallest)
    and a 64-bit hash of its text that tells rows of one id apart. Rows equal in both are copies of
    one another and always share their result, so a join on the two loses and adds none.
    The input's own columns sit in ``_row``, where no name of theirs can clash with an
    operator's.
    """
    whole = isinstance(docs.schema[id_col].dataType, T.IntegralType)
    kind, least = ("long", F.lit(-(2**63))) if whole else ("string", F.lit(""))
    return docs.select(
        F.struct("*").alias("_row"),
        F.col(id_col).alias("_id"),
        text_of(text_col).alias("_text"),
    ).select(
        "_row",
        F.coalesce(F.col("_id").cast(kind), least).alias("_id"),
        F.xxhash64("_text", F.isnull("_id")).alias("_tie"),
        "_text",
    )


def folded_bytes(text: Column) -> Column:
    """One character per UTF-8 byte, A-Z lower-cased: equal exactly where the texts are
    equal but for the case of A-Z.

    Lower-casing also moves the bytes C0 to DE by 32, which stays one-to-one: bytes
    80 to BF are left alone, so the length of each sequence is kept, and no two lead bytes
    of one length meet.
    """
    return F.lower(F.decode(text.cast("binary"), "ISO-8859-1"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def attach(
    large: DataFrame, small: DataFrame, on: list[str], how: str = "left", width: Column | None = None
) -> DataFrame:
    """Join rows of ``large`` with a written table that has each key once at most.

    The table is broadcast if its rows and bytes (``width`` a row) are within the limits;
    beyond them both sides are shuffled, and adaptive execution splits hot keys of ``large``.
    """
    size = small.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.lit(64) if width is None else width), F.lit(0)).alias("b")
    ).first()
    if size["n"] <= BROADCAST_ROWS and size["b"] <= BROADCAST_BYTES:
        small = F.broadcast(small)
    return large.join(small, on, how)


def worker_cache(purpose: str) -> dict:
    """What a Python worker keeps from one task to the next (tokenizers, tables).

    A worker serves one purpose after another; what it kept for the last one is given back.
    """
    cache = sys.__dict__.setdefault("_worker_cache", {})
    if cache.get("purpose") != purpose:
        cache.clear()
        cache["purpose"] = purpose
        gc.collect()
        try:  # glibc keeps freed memory unless it is asked
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):
            pass
    return cache
