"""Accepting uploads: names, kinds, sizes, content hashes and duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import lexicon as lx
from ..functions import text as T
from .extract import EMPTY_FILE


def rejection(extension: Column, size: Column, settings: Settings) -> Column:
    """Why an upload is refused, or null. Kind comes before emptiness before size."""
    supported = ", ".join(lx.SUPPORTED_EXTENSIONS)
    shown = F.when(extension == "", F.lit("(none)")).otherwise(extension)
    return (
        F.when(
            ~extension.isin(*lx.SUPPORTED_EXTENSIONS),
            F.concat(
                F.lit("Unsupported file type '"), shown, F.lit(f"'. Supported: {supported}.")
            ),
        )
        .when(size == 0, F.lit(EMPTY_FILE))
        .when(
            size > settings.max_upload_bytes,
            F.format_string(
                f"File is %.1f MB; the limit is {settings.max_upload_mb} MB.",
                size / F.lit(1048576.0),
            ),
        )
    )


def checked_uploads(uploads: DataFrame, settings: Settings) -> DataFrame:
    """Add safe ``filename``, ``extension``, ``size_bytes``, ``sha256``, ``rejected``.

    A source that knows the size of files too big to load says so in ``size_bytes``.
    """
    others = [c for c in uploads.columns if c not in ("filename", "content", "size_bytes")]
    size = F.coalesce(F.octet_length("content"), F.lit(0)).cast("long")
    if "size_bytes" in uploads.columns:
        size = F.coalesce("size_bytes", size)
    named = uploads.select(
        *others,
        T.safe_filename(F.col("filename")).alias("filename"),
        "content",
        size.alias("size_bytes"),
    )
    sized = named.select(
        "*",
        T.extension(F.col("filename")).alias("extension"),
    )
    return sized.select(
        "*",
        F.sha2("content", 256).alias("sha256"),
        rejection(F.col("extension"), F.col("size_bytes"), settings).alias("rejected"),
    )


def first_of_each(rows: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """``key..., value`` of the first row per key.

    An aggregate, not a window: copies are reduced before the shuffle, so a key that
    holds a third of all rows costs no more than any other.
    """
    return rows.groupBy(*key).agg(F.min(F.struct(order, value)).alias("_first")).select(
        *key, F.col(f"_first.{value}").alias(value), F.col(f"_first.{order}").alias(order)
    )


def question_problem(question: Column, top_k: Column | None = None) -> Column:
    """Why a question is refused before it is looked at, or null."""
    problem = (
        F.when(F.coalesce(F.length(question), F.lit(0)) == 0, F.lit("question is missing"))
        .when(F.length(question) > lx.MAX_QUESTION_CHARS, F.lit(lx.TOO_LONG_QUESTION))
        .when(T.strip(question) == "", F.lit("Question must not be empty."))
    )
    if top_k is not None:
        problem = problem.when(~top_k.between(1, lx.MAX_TOP_K), F.lit(lx.WRONG_TOP_K))
    return problem


def turn_problem(role: Column, content: Column) -> Column:
    """Why a conversation turn is refused, or null."""
    return F.when(
        ~F.coalesce(role, F.lit("")).isin("user", "assistant"), F.lit("role is unknown")
    ).when(F.length(content) > lx.MAX_TURN_CHARS, F.lit(lx.TOO_LONG_TURN))
