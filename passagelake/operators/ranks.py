"""Exact order statistics of groups of any size, without sorting a group in one task.

A mergeable sketch of every group brackets each wanted rank between two values, with a proven error
of one in ``ACCURACY`` of the group. One narrow pass then counts what lies below the bracket and how
often each value inside it occurs, combined before the shuffle; only the values inside, some
thousandths of a group at most and each value once, are put in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: the sketch is off by one in so many rows of a group at most
ACCURACY = 10_000


def nearest_ranks(rows: DataFrame, group: str, value: str, shares: list[float]) -> DataFrame:
    """``group, share, n, value``: the value at place ``floor(share * n)``, counted from zero, of each
    group in ascending order (the last one if that lies behind it). Nulls are not counted; groups
    without a value have no row. A null group is a group."""
    known = rows.select(F.col(group).alias("_g"), F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    margin = 2.0 / ACCURACY
    bounds = [max(0.0, s - margin) for s in shares] + [min(1.0, s + margin) for s in shares]
    sketched = known.groupBy("_g").agg(
        F.count("*").alias("n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"),
        F.percentile_approx("_v", bounds, ACCURACY).alias("_b"),
    )
    k = len(shares)
    brackets = sketched.select(
        "_g", "n",
        F.inline(
            F.array(*(
                F.struct(
                    F.lit(s).alias("share"),
                    F.least(F.floor(F.lit(s) * F.col("n")), F.col("n") - 1).alias("_place"),
                    # at the ends the sketch need not reach the extremes
                    F.when(F.lit(s <= 2 * margin), F.col("_least")).otherwise(F.col("_b")[i]).alias("_low"),
                    F.when(F.lit(s >= 1 - 2 * margin), F.col("_most")).otherwise(F.col("_b")[k + i]).alias("_high"),
                )
                for i, s in enumerate(shares)
            ))
        ),
    )
    met = known.join(brackets, known["_g"].eqNullSafe(brackets["_g"])).drop(brackets["_g"])
    inside = met.where(F.col("_v") <= F.col("_high")).groupBy(
        "_g", "share", "n", "_place", F.when(F.col("_v") >= F.col("_low"), F.col("_v")).alias("_v")
    ).agg(F.count("*").alias("_c"))  # a null value holds the count of all that lie below
    order = Window.partitionBy("_g", "share").orderBy(F.asc_nulls_first("_v"))
    upto = F.sum("_c").over(order)
    return (
        inside.withColumn("_upto", upto)
        .where((F.col("_upto") > F.col("_place")) & (F.col("_upto") - F.col("_c") <= F.col("_place")))
        .select(F.col("_g").alias(group), "share", "n", F.col("_v").alias(value))
    )
