"""Reciprocal rank fusion of a lexical and a dense ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx


def fuse(lexical: DataFrame, dense: DataFrame, limit: int) -> DataFrame:
    """``query_id, chunk_id, doc_id, ordinal, score, rank``.

    Inputs hold at most ``limit`` rows per question. Equal sums keep lexical order, then
    dense order. A question without dense hits keeps its lexical scores.
    """
    columns = ["query_id", "chunk_id", "doc_id", "score", "rank"]
    both = lexical.select(*columns, F.lit(True).alias("lexical")).unionByName(
        dense.select(*columns, F.lit(False).alias("lexical"))
    )
    lexical_rank = F.when(F.col("lexical"), F.col("rank"))
    dense_rank = F.when(~F.col("lexical"), F.col("rank"))
    per_chunk = both.groupBy("query_id", "chunk_id").agg(
        F.first("doc_id").alias("doc_id"),
        F.sum(1.0 / (lx.RRF_K + F.col("rank"))).alias("fused"),
        F.max(F.when(F.col("lexical"), F.col("score"))).alias("lexical_score"),
        F.max(lexical_rank).alias("lexical_rank"),
        F.max(dense_rank).alias("dense_rank"),
    )
    any_dense = F.max(F.col("dense_rank").isNotNull()).over(Window.partitionBy("query_id"))
    scored = per_chunk.withColumn(
        "score", F.when(any_dense, F.col("fused")).otherwise(F.col("lexical_score"))
    )
    order = Window.partitionBy("query_id").orderBy(
        F.desc("score"), F.asc_nulls_last("lexical_rank"), F.asc("dense_rank")
    )
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    ordinal = F.element_at(F.split("chunk_id", ":"), -1).cast("int")
    return ranked.select(
        "query_id", "chunk_id", "doc_id", ordinal.alias("ordinal"), "score", "rank"
    )
