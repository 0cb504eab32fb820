"""Where intermediate tables live, and joins against a side of checked size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings

_CONF = "spark.checkpoint.dir"
_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session, where driver and executors share one disk, may do without
    the setting; there a fresh temporary folder takes its place.
    """
    folder = spark.conf.get(_CONF, None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError(f"Set {_CONF} to a folder that all executors can reach.")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="passagelake-")
    return _local_folders[context.applicationId]


def save(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back.

    A table rather than a cache, so it survives lost executors, can be read column by
    column, and has a size the optimizer knows when it picks a join.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/work/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """One partition per core's worth of keys, for rows that are few but costly.

    Left to itself Spark would merge small partitions and leave the work to one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


#: how much wider rows may be in memory than in a file, and the narrowest row
_UNPACKED, _NARROW = 16, 16


def fits_broadcast(df: DataFrame, settings: Settings) -> bool:
    """Whether a written table is small enough, in rows and in bytes, to broadcast.

    The optimizer knows the size of the files. Where that is far below the limits nothing
    is counted; otherwise the rows are.
    """
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) * _UNPACKED
    if known <= min(settings.broadcast_mb << 20, settings.broadcast_rows * _NARROW):
        return True
    width = F.octet_length(F.to_json(F.struct(*df.columns)))
    size = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    return size["n"] <= settings.broadcast_rows and size["b"] <= settings.broadcast_mb << 20


def join_small(
    large: DataFrame, small: DataFrame, on: list[str], spread: str, settings: Settings
) -> DataFrame:
    """Inner equi-join of a large frame with a side that is usually small.

    Within the size limit the small side is broadcast. Beyond it both sides shuffle,
    with rows of the large side salted by the ``spread`` column, so that one hot key
    is shared by ``settings.salts`` tasks.
    """
    if fits_broadcast(small, settings):
        return large.join(F.broadcast(small), on)
    salts = settings.salts
    salted_large = large.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted_large.join(copies, [*on, "_salt"]).drop("_salt")


def lookup(
    left: DataFrame, right: DataFrame, on: list[str], spread_by: str, settings: Settings,
    how: str = "left",
) -> DataFrame:
    """Join that keeps working when a few keys hold a large share of ``left``.

    Keys with more than ``settings.hot_rows`` rows are found by an aggregate (there can be
    no more of them than rows / hot_rows). Their rows are split over as many tasks as
    that size asks for, and only their matches in ``right`` are copied.
    """
    counted = left.groupBy(*on).agg(F.count("*").alias("_n")).where(
        F.col("_n") > settings.hot_rows
    )
    pieces = F.ceil(F.col("_n") / F.lit(settings.hot_rows)).cast("int")
    hot = save(counted.select(*on, pieces.alias("_pieces")), "hot-keys")
    if hot.isEmpty():
        return left.join(right, on, how)
    few = F.broadcast(hot)
    share = F.coalesce("_pieces", F.lit(1))
    salted = left.join(few, on, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(spread_by), share).cast("int")
    )
    copies = right.join(few, on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), share - 1))
    )
    return salted.drop("_pieces").join(copies.drop("_pieces"), [*on, "_salt"], how).drop("_salt")


def prune_buckets(
    large: DataFrame, column: str, small: DataFrame, bucket_of, buckets: int
) -> DataFrame:
    """Read only the partition directories that rows of ``small`` can match.

    The list that reaches the driver has at most ``buckets`` small numbers.
    """
    hit = [r[0] for r in small.select(bucket_of).distinct().collect()]
    return large if len(hit) >= buckets else large.where(F.col(column).isin(hit))
