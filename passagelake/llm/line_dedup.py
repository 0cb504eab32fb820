"""Lines that repeat across documents, found by hash and dropped by bitmap.

Every line becomes a 128-bit hash of its key with its document and position. The hashes
are range-partitioned and sorted by document and position within, so one pass sees each
hash's occurrences in order: the first of every document, and the first of all. Only those
that must go come back, as one sparse bitmap per document; texts are never shuffled.

The range key also holds a slice of the document, so a line that a third of all documents
share is a run of many slices, which the ranges split; what the tasks found of it meets
as one count each.

Cases: a null text is empty, and an empty text is one empty line. Lines whose key is
shorter than ``min_chars`` always stay. Every row is a document, also if its id is null or repeated; rows equal
in id and text count as often as they stand there and get the same result, once each. Texts of any length
are split whole. The input's own columns come back in ``_row``, where their names clash with none. An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE, attach, folded_bytes, keyed, partitions, save

KEY = ["_id", "_tie"]
HASH = ["_h1", "_h2"]
#: parts into which the documents of one hash may be split between ranges
SLICES = 64
BITS = 64


def _code_points(folded: Column) -> Column:
    """Code points of folded text: its bytes but for those that continue a sequence."""
    return F.char_length(F.regexp_replace(folded, "[\\x80-\\xBF]", ""))


def line_hashes(keyed_docs: DataFrame, min_chars: int) -> DataFrame:
    """``_h1, _h2`` (of the line's key), document and position, of every line with a key."""
    lines = F.split(folded_bytes(F.col("_text")), "\n", -1)
    return (
        keyed_docs.select(*KEY, F.posexplode(lines).alias("_pos", "_line"))
        .select(*KEY, "_pos", F.trim("_line", F.lit(ASCII_SPACE)).alias("_key"))
        .where(_code_points(F.col("_key")) >= min_chars if min_chars > 1 else F.col("_key") != "")
        .select(F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2"), *KEY, "_pos")
    )


def frequent_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """Hashes found in ``min_docs`` documents or more, with their first occurrence."""
    ranged = lines.withColumn("_slice", F.pmod(F.xxhash64(*KEY), F.lit(SLICES))).repartitionByRange(
        partitions(lines.sparkSession), *HASH, "_slice"
    )
    # the ranges already keep each (hash, slice) together: the window sorts, it does not shuffle
    run = Window.partitionBy(*HASH, "_slice", *KEY).orderBy("_pos")
    # equal rows hold the line at the same first place, once for each row
    heads = ranged.withColumn("_start", F.min("_pos").over(run)).where(F.col("_pos") == F.col("_start"))
    return (
        heads.groupBy(*HASH)
        .agg(F.count("*").alias("_docs"), F.min(F.struct(*KEY, "_pos")).alias("_first"))
        .where(F.col("_docs") >= min_docs)
    )


def line_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    min_docs: int = 10, min_chars: int = 1, keep: str = "none",
) -> DataFrame:
    """``_id, _tie, dropped``: for every document that loses lines, its sparse bitmap.

    ``dropped`` lists ``(word, bits)``; bit ``b`` of word ``w`` is set where line ``64 w + b``
    goes. Words without such lines are left out, and so are documents without any. A line
    goes if ``min_docs`` documents hold its key; with ``keep="first"`` the first of them,
    by document and position, keeps its first one.
    """
    if keep not in ("none", "first"):
        raise ValueError(f"keep must be 'none' or 'first', not {keep!r}")
    lines = save(line_hashes(keyed(docs, id_col, text_col), min_chars), "lines")
    frequent = save(frequent_lines(lines, min_docs), "frequent-lines")
    drops = attach(lines, frequent, HASH, "inner")
    if keep == "first":
        drops = drops.where(F.struct(*KEY, "_pos") != F.col("_first"))
    bit = F.expr(f"shiftleft(1L, _pos % {BITS})")
    return (
        drops.groupBy(*KEY, F.expr(f"_pos div {BITS}").cast("int").alias("word"))
        .agg(F.bit_or(bit).alias("bits"))
        .groupBy(*KEY)
        .agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("dropped"))
    )


def kept_lines(lines: Column, dropped: Column) -> Column:
    """The lines whose bit is not set in a sparse bitmap."""
    words = F.map_from_entries(dropped)
    last = F.ceil(F.size(lines) / F.lit(BITS)).cast("int") - 1
    dense = F.transform(
        F.sequence(F.lit(0), last), lambda w: F.coalesce(F.try_element_at(words, w), F.lit(0).cast("long"))
    )

    def stays(bound):
        return F.filter(
            bound["lines"],
            lambda _, i: F.expr("0L") == F.getbit(
                F.get(bound["dense"], F.floor(i / F.lit(BITS)).cast("int")), i % F.lit(BITS)
            ),
        )

    # bound to one element, so that neither array is computed again for each line
    return F.get(F.transform(F.array(F.struct(lines.alias("lines"), dense.alias("dense"))), stays), 0)


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    min_docs: int = 10, min_chars: int = 1, keep: str = "none",
) -> DataFrame:
    """``_row`` (the input row), ``_id``, ``n_lines``, ``n_dropped`` and ``kept`` (the remaining text)."""
    bitmaps = save(line_bitmaps(docs, id_col, text_col, min_docs, min_chars, keep), "line-bitmaps")
    width = F.size("dropped") * 16 + 96
    joined = attach(keyed(docs, id_col, text_col), bitmaps, KEY, width=width)
    lines = F.split("_text", "\n", -1)
    marked = joined.select(
        "_row", "_id", "_text", F.size(lines).cast("long").alias("n_lines"),
        F.when(F.col("dropped").isNotNull(), kept_lines(lines, F.col("dropped"))).alias("_kept"),
    )
    return marked.select(
        "_row", "_id", "n_lines",
        F.when(F.col("_kept").isNull(), 0).otherwise(F.col("n_lines") - F.size("_kept")).cast("long").alias("n_dropped"),
        F.coalesce(F.array_join("_kept", "\n"), F.col("_text")).alias("kept"),
    )
