"""Documents that hold passages of a benchmark.

The n-grams of the benchmark become a set of hashes, broadcast while it is small (it is
measured). A scan hashes every window of every document in place and keeps the windows
whose hash is in the set; those hits are then verified word by word against the texts, and
the hit words counted, cut out, or their documents dropped. Only hits are ever shuffled.

Cases: a null or empty text has no words and no hits; a benchmark text without words has
no window. Rows equal in id and text share their result; a null id is an id like any other.
An item id that is null counts as "". Benchmark rows that repeat change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, folded_bytes, keyed, save, text_of

KEY = ["_id", "_tie"]
#: fixed: what stands between words, on lower-cased text
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: fixed: the same on text as it is
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RAW_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(folded_bytes(text), SEPARATORS, -1), "")


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, not once for each element that needs it."""
    return F.get(F.transform(F.array(value), use), 0)


def window_hashes(words: Column, length: int) -> Column:
    """The hash of the words ``i .. i + length - 1`` for every ``i`` that has them all."""

    def hashes(w):
        starts = F.sequence(F.lit(0), F.size(w) - F.lit(length))
        each = F.transform(starts, lambda i: F.xxhash64(*(F.get(w, i + F.lit(k)) for k in range(length))))
        return F.when(F.size(w) >= length, each).otherwise(F.array().cast("array<bigint>"))

    return _bound(words, hashes)


def benchmark_windows(items: DataFrame, n: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``length, hash, gram, items``: each different window once, with the items that hold it."""
    each = items.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words_of(text_of(text_col)).alias("w")
    ).select("item", "w", F.least(F.size("w"), F.lit(n)).alias("length")).where(F.col("length") > 0)
    starts = F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)
    grams = each.select("item", "length", "w", F.explode(starts).alias("start")).select(
        "item", "length", F.slice("w", F.col("start"), F.col("length")).alias("gram")
    )
    hashed = F.lit(None).cast("bigint")
    for k in range(1, n + 1):
        hashed = F.when(F.col("length") == k, F.xxhash64(*(F.get("gram", F.lit(i)) for i in range(k)))).otherwise(hashed)
    return grams.groupBy("length", "gram").agg(F.collect_set("item").alias("items")).withColumn("hash", hashed)


def scan(
    docs: DataFrame, items: DataFrame, n: int = 13,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``_row, _id, _text, n_words, hit_words, items`` for every document.

    ``hit_words`` holds the indexes of the words inside any occurrence of a window, in
    ascending order; ``items`` the ids of the items with such a window, sorted as text.
    """
    documents = keyed(docs, id_col, text_col)
    windows = save(benchmark_windows(items, n), "benchmark-windows")
    grams = windows.select("length", "hash", "gram", "items")
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # n of them at most
    width = F.lit(64) + 24 * F.size("gram") + 24 * F.size("items")
    if not lengths:
        found = documents.select(*KEY, F.lit(None).cast("array<struct<pos:int,gram:array<string>,items:array<string>>>").alias("found")).where("false")
    else:
        words = documents.select(*KEY, words_of(F.col("_text")).alias("_w"))
        hits = None
        for length in lengths:
            part = words.select(*KEY, F.posexplode(window_hashes(F.col("_w"), length)).alias("pos", "hash"))
            known = grams.where(F.col("length") == length).drop("length")
            part = attach(part, known, ["hash"], "inner", width)
            hits = part if hits is None else hits.unionByName(part)
        found = save(
            hits.groupBy(*KEY).agg(F.collect_set(F.struct("pos", "gram", "items")).alias("found")), "benchmark-hits"
        )
    # only suspects are read again and meet their hits; all others keep to their place
    suspects = attach(documents.select(*KEY, "_text"), found.select(*KEY), KEY, "left_semi")
    split = suspects.dropDuplicates(KEY).join(found, KEY).select(*KEY, "found", words_of(F.col("_text")).alias("_w"))

    def verified(w):
        return F.filter("found", lambda c: F.slice(w, c["pos"] + 1, F.size(c["gram"])) == c["gram"])

    spans = F.flatten(F.transform("_ok", lambda c: F.sequence(c["pos"], c["pos"] + F.size(c["gram"]) - 1)))
    checked = split.select(*KEY, _bound(F.col("_w"), verified).alias("_ok")).where(F.size("_ok") > 0).select(
        *KEY,
        F.sort_array(F.array_distinct(spans)).alias("hit_words"),
        F.sort_array(F.array_distinct(F.flatten(F.transform("_ok", lambda c: c["items"])))).alias("items"),
    )
    counted = documents.select("_row", *KEY, "_text", F.size(words_of(F.col("_text"))).cast("long").alias("n_words"))
    size = F.lit(96) + 4 * F.size("hit_words") + 24 * F.size("items")
    return attach(counted, save(checked, "verified-hits"), KEY, width=size).select(
        "_row", "_id", "_text", "n_words",
        F.coalesce("hit_words", F.array().cast("array<int>")).alias("hit_words"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def contaminated(share: int = 20) -> Column:
    """Whether the hit words are one in ``share`` of a scanned document's words, or more."""
    hits = F.size("hit_words").cast("long")
    return (hits > 0) & (share * hits >= F.col("n_words"))


def without_spans(text: Column, hit_words: Column) -> Column:
    """The text without its hit words and what stands before each of them."""
    units = F.regexp_extract_all(text, F.lit(f"({RAW_SEPARATORS}{RAW_WORD})"), 1)
    tail = F.regexp_extract(text, f"({RAW_SEPARATORS})$", 1)
    last = F.size(hit_words)

    def keep(bound):
        gaps = F.transform(
            F.sequence(F.lit(0), last),
            lambda k: F.struct(
                F.coalesce(F.get(hit_words, k - 1) + 1, F.lit(0)).alias("start"),
                F.coalesce(F.get(hit_words, k), F.size(bound)).alias("end"),
            ),
        )
        runs = F.filter(gaps, lambda g: g["end"] > g["start"])
        return F.flatten(F.transform(runs, lambda g: F.slice(bound, g["start"] + 1, g["end"] - g["start"])))

    return F.when(last == 0, text).otherwise(F.concat(F.array_join(_bound(units, keep), ""), tail))


def decontaminate(
    docs: DataFrame, items: DataFrame, n: int = 13, mode: str = "drop", share: int = 20,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that are not contaminated (``mode="drop"``), or all of them with
    the hit words cut from ``text_col`` (``mode="cut"``). Columns stay as they are."""
    scanned = scan(docs, items, n, id_col, text_col)
    if mode == "drop":
        return scanned.where(~contaminated(share)).select("_row.*")
    if mode != "cut":
        raise ValueError(f"mode must be 'drop' or 'cut', not {mode!r}")
    cut = F.when(
        F.col(f"_row.{text_col}").isNotNull(), without_spans(F.col("_text"), F.col("hit_words"))
    )
    return scanned.select(F.col("_row").withField(text_col, cut).alias("_row")).select("_row.*")
