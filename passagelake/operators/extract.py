"""Files to paragraph blocks, by kind of file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.containers import NO_DOCX_TEXT, NO_PDF_TEXT, UNPACKED, unpack
from ..sources.plain import decode_text
from .chunk import BLOCKS, text_blocks

PLAIN = (".txt", ".md")
PACKED = (".pdf", ".docx")
EMPTY_FILE = "The file is empty."
NO_TEXT = "No text could be extracted from the document."


def unsupported(extension: Column) -> Column:
    """Why a file of this kind cannot be extracted, or null."""
    return (
        F.when(extension.isin(*PLAIN, *PACKED), F.lit(None).cast("string"))
        .when(
            extension == ".doc",
            F.lit("Legacy .doc files are not supported - save as .docx first."),
        )
        .otherwise(
            F.concat(
                F.lit("Unsupported file type '"), extension, F.lit("'. Use PDF, TXT or DOCX.")
            )
        )
    )


def plain_blocks(files: DataFrame) -> DataFrame:
    texts = files.where(F.col("extension").isin(*PLAIN)).select(
        "doc_id", decode_text(F.col("content")).alias("_text")
    )
    blocks = texts.select("doc_id", text_blocks(F.col("_text")).alias("blocks"))
    return blocks.select(
        "doc_id", "blocks", F.when(F.size("blocks") == 0, F.lit(EMPTY_FILE)).alias("error")
    )


def packed_blocks(files: DataFrame) -> DataFrame:
    parts = (
        files.where(F.col("extension").isin(*PACKED))
        .select("doc_id", "extension", "content")
        .mapInPandas(unpack, UNPACKED)
    )

    def block(page, text):
        return F.struct(page.cast("int").alias("page"), text.alias("text"))

    none = F.lit(None).cast("int")
    pages = F.flatten(
        F.transform(
            "pages", lambda body, i: F.transform(T.paragraphs(body), lambda p: block(i + 1, p))
        )
    )
    paragraphs = F.transform("paragraphs", lambda p: block(none, T.clean(p)))
    rows = F.transform(
        "rows",
        lambda cells: block(
            none,
            F.array_join(F.filter(F.transform(cells, T.clean), lambda c: c != ""), " | "),
        ),
    )
    blocks = F.filter(
        F.coalesce(pages, F.concat(paragraphs, rows), F.array()).cast(BLOCKS),
        lambda b: b.text != "",
    )
    found = parts.select("doc_id", blocks.alias("blocks"), "problem", F.col("pages").isNotNull().alias("pdf"))
    empty = F.when(F.col("pdf"), F.lit(NO_PDF_TEXT)).otherwise(F.lit(NO_DOCX_TEXT))
    return found.select(
        "doc_id",
        "blocks",
        F.coalesce("problem", F.when(F.size("blocks") == 0, empty)).alias("error"),
    )


def extract(files: DataFrame, packed: bool = True) -> DataFrame:
    """``doc_id, blocks, error`` for files (doc_id, extension, content).

    ``packed=False`` spares the Python stage when no PDF or DOCX is among the files.
    """
    found = plain_blocks(files)
    return found.unionByName(packed_blocks(files)) if packed else found
