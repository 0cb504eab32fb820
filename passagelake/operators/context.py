"""Widen hits with their neighbours, merge touching ranges and build source blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import lexicon as lx
from ..functions import text as T
from ..workspace import join_small, save, spread

BLOCK = (
    "struct<n:int,doc_id:string,filename:string,page:int,text:string,score:double,"
    "chunk_ids:array<string>>"
)


def merged_ranges(selected: DataFrame, window: int) -> DataFrame:
    """``query_id, doc_id, first, last, score, chunk_ids, doc_rank``.

    Each hit covers ``window`` chunks on both sides; ranges of one document that overlap
    or touch become one, scored by its best hit.
    """
    in_document = Window.partitionBy("query_id", "doc_id").orderBy("ordinal")
    first = F.greatest(F.lit(0), F.col("ordinal") - window)
    # With a constant window the last hit's range always ends furthest.
    apart = first > F.lag(F.col("ordinal") + window).over(in_document) + 1
    flagged = selected.select(
        "*", first.alias("first"), F.coalesce(apart.cast("int"), F.lit(0)).alias("apart")
    )
    grouped = flagged.withColumn("range", F.sum("apart").over(in_document)).withColumn(
        "doc_rank", F.min("pick").over(Window.partitionBy("query_id", "doc_id"))
    )
    return grouped.groupBy("query_id", "doc_id", "range").agg(
        F.min("first").alias("first"),
        (F.max("ordinal") + window).alias("last"),
        F.max("score").alias("score"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("ordinal", "chunk_id"))), lambda c: c.chunk_id
        ).alias("chunk_ids"),
        F.first("doc_rank").alias("doc_rank"),
    ).drop("range")


def range_pieces(ranges: DataFrame, chunks: DataFrame, settings: Settings) -> DataFrame:
    """Every chunk inside a range: the range join as an equi-join on its ordinals."""
    wanted = ranges.select(
        "query_id", "doc_id", "first", F.explode(F.sequence("first", "last")).alias("ordinal")
    )
    columns = chunks.select("doc_id", "ordinal", "page", "text")
    return join_small(columns, wanted, ["doc_id", "ordinal"], "ordinal", settings)


def context_blocks(
    selected: DataFrame,
    chunks: DataFrame,
    documents: DataFrame,
    settings: Settings,
) -> DataFrame:
    """``query_id, blocks``: numbered context of each question, best block first.

    ``selected`` is the output of :func:`diversify`, at most ``top_k`` hits per question,
    so a question's pieces are few whatever the corpus holds.
    """
    ranges = save(merged_ranges(selected, settings.neighbour_window), "ranges")
    pieces = range_pieces(ranges, chunks, settings)
    texts = spread(pieces, "query_id").groupBy("query_id", "doc_id", "first").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "page", "text"))).alias("pieces")
    )
    body = F.left(T.join_without_overlap(F.col("pieces.text")), F.lit(lx.MAX_BLOCK_CHARS))
    named = join_small(
        documents.select("doc_id", "filename"),
        ranges.select("query_id", "doc_id", "first", "score", "chunk_ids", "doc_rank"),
        ["doc_id"],
        "doc_id",
        settings,
    )
    blocks = texts.select(
        "query_id", "doc_id", "first",
        F.get("pieces", F.lit(0)).page.alias("page"),
        body.alias("text"),
    ).join(named, ["query_id", "doc_id", "first"])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_rank", "first")
    numbered = blocks.withColumn("n", F.row_number().over(order))
    block = F.struct("n", "doc_id", "filename", "page", "text", "score", "chunk_ids")
    return numbered.groupBy("query_id").agg(
        F.array_sort(F.collect_list(block.cast(BLOCK))).alias("blocks")
    )


def sources(blocks: Column, cited: Column) -> Column:
    """Source cards: what a reader is shown about each block."""
    return F.transform(
        blocks,
        lambda b: F.struct(
            b.n.alias("n"),
            b.doc_id.alias("document_id"),
            b.filename.alias("filename"),
            b.page.alias("page"),
            T.snippet(b.text).alias("snippet"),
            F.round(b.score, 4).alias("score"),
            F.array_contains(cited, b.n).alias("cited"),
        ),
    )
