"""File source: a folder of documents as a DataFrame of uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lx

BINARY_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def _as_uploads(files: DataFrame, max_bytes: int) -> DataFrame:
    """Files as uploads; those over the limit appear without their content.

    The size filters reach the source, which then never opens an oversized file.
    """
    def rows(part: DataFrame, content) -> DataFrame:
        return part.select(
            F.element_at(F.split("path", "/"), -1).alias("filename"),
            content.alias("content"),
            F.col("length").alias("size_bytes"),
            F.col("path").alias("stored_path"),
            F.col("path").alias("position"),
        )

    fits = rows(files.where(F.col("length") <= max_bytes), F.col("content"))
    large = rows(files.where(F.col("length") > max_bytes), F.lit(None).cast("binary"))
    return fits.unionByName(large)


def _any_case(extension: str) -> str:
    """A glob for an extension in capitals, small letters or both."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in extension)


def read_uploads(spark: SparkSession, folder: str, max_bytes: int = 25 << 20) -> DataFrame:
    """All supported files below ``folder``; file by file failures surface at ingest."""
    names = ",".join("*" + _any_case(e) for e in lx.SUPPORTED_EXTENSIONS)
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "{" + names + "}")
        .option("recursiveFileLookup", "true")
        .load(folder)
    )
    return _as_uploads(files, max_bytes)


def stream_uploads(
    spark: SparkSession, folder: str, max_bytes: int = 25 << 20, files_per_batch: int = 1000
) -> DataFrame:
    """The same folder as a stream: files that arrive later come in later batches."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
    )
    return _as_uploads(files, max_bytes)
