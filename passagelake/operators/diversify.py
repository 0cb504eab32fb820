"""Maximal marginal relevance over the candidates of each question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import bind
from ..workspace import spread

_POOL = (
    "array<struct<rank:int,chunk_id:string,doc_id:string,ordinal:int,score:double,"
    "terms:array<string>,redundancy:double>>"
)


def diversify(candidates: DataFrame, top_k: int, lambda_: float = 0.7) -> DataFrame:
    """Pick ``top_k`` candidates that are relevant yet unlike those already picked.

    ``candidates`` holds query_id, rank, chunk_id, doc_id, ordinal, score and the
    chunk's distinct ``terms``. There are never more than the candidate limit per
    question, so a question's pool is one small array and the picking a fold over it.
    Returns the candidates with ``pick`` from 1.
    """
    member = F.struct(
        F.col("rank").cast("int").alias("rank"),
        "chunk_id", "doc_id", "ordinal", "score", "terms",
        F.lit(0.0).alias("redundancy"),
    )
    pools = spread(candidates, "query_id").groupBy("query_id").agg(
        F.array_sort(F.collect_list(member)).cast(_POOL).alias("pool"),
        F.max("score").alias("_max"),
    ).select("query_id", "pool", F.when(F.col("_max") == 0, 1.0).otherwise(F.col("_max")).alias("_best"))

    def value(c):
        return F.lit(lambda_) * (c.score / F.col("_best")) - F.lit(1.0 - lambda_) * c.redundancy

    def pick(acc, _):
        leader = F.array_max(
            F.transform(acc.pool, lambda c, i: F.struct(value(c).alias("v"), (-i).alias("i")))
        )

        def take(chosen):
            rest = F.transform(
                F.filter(acc.pool, lambda c: c.rank != chosen.rank),
                lambda c: c.withField(
                    "redundancy", F.greatest(c.redundancy, T.jaccard(c.terms, chosen.terms))
                ),
            )
            return F.struct(
                rest.cast(_POOL).alias("pool"),
                F.concat(acc.picked, F.array(chosen)).cast(_POOL).alias("picked"),
            )

        return bind(F.get(acc.pool, -leader.i), take)

    start = F.struct(
        F.col("pool"), F.array().cast(_POOL).alias("picked")
    )
    picked = F.aggregate(
        F.sequence(F.lit(1), F.lit(top_k)), start, pick, lambda acc: acc.picked
    )
    chosen = pools.select(
        "query_id",
        F.when(F.size("pool") <= top_k, F.col("pool")).otherwise(picked).alias("picked"),
    )
    return chosen.select(
        "query_id", F.posexplode_outer("picked").alias("pick", "c")
    ).where(F.col("c").isNotNull()).select(
        "query_id",
        (F.col("pick") + 1).alias("pick"),
        "c.chunk_id", "c.doc_id", "c.ordinal", "c.score",
    )
