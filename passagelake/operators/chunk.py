"""Pack sentences into overlapping chunks.

All steps work on arrays inside one document's row, so chunking any number of
documents is a single map without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import bind

BLOCKS = "array<struct<page:int,text:string>>"


def text_blocks(raw: Column) -> Column:
    """Paragraph blocks of a text file; form feeds, where present, number the pages."""
    paged = raw.contains("\f")
    pages = F.split(raw, "\f", -1)
    return F.flatten(
        F.transform(
            pages,
            lambda body, i: F.transform(
                T.paragraphs(body),
                lambda p: F.struct(
                    F.when(paged, i + 1).cast("int").alias("page"), p.alias("text")
                ),
            ),
        )
    ).cast(BLOCKS)


def sentence_units(blocks: Column, hard_limit: int) -> Column:
    """``array<struct<page, text, n>>``: sentences, the longest ones sliced."""
    def unit(page, body, n):
        return F.struct(page.alias("page"), body.alias("text"), n.cast("int").alias("n"))

    def slices(page, sentence):
        def cut(word_list):
            starts = F.sequence(F.lit(0), F.size(word_list) - 1, F.lit(hard_limit))
            return F.when(
                F.size(word_list) <= hard_limit,
                F.array(unit(page, sentence, F.size(word_list))),
            ).otherwise(
                F.transform(
                    starts,
                    lambda s: unit(
                        page,
                        F.array_join(F.slice(word_list, s + 1, F.lit(hard_limit)), " "),
                        F.least(F.lit(hard_limit), F.size(word_list) - s),
                    ),
                )
            )

        return bind(T.words(sentence), cut)

    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.flatten(F.transform(T.sentences(b.text), lambda s: slices(b.page, s))),
        )
    )


def chunk_cuts(counts: Column, target: int, overlap: int, smallest: int) -> Column:
    """``array<struct<first, stop, n>>``: unit ranges of the chunks, from unit sizes.

    A chunk is closed before the unit that would take it past the target, once it has
    the smallest allowed size. The next one starts with the longest run of whole units
    at its end that fits the overlap.
    """
    cut_type = "array<struct<first:int,stop:int,n:int>>"

    def carried(first, i):
        nothing = F.struct(i.alias("first"), F.lit(0).alias("n"), F.lit(True).alias("open"))
        if overlap == 0:
            return nothing
        # every unit has a word, so no more than `overlap` units can be carried
        back = F.sequence(i - 1, F.greatest(first, i - overlap), F.lit(-1))

        def extend(tail, k):
            fits = tail.open & (tail.n + F.get(counts, k) <= overlap)
            return F.struct(
                F.when(fits, k).otherwise(tail.first).alias("first"),
                F.when(fits, tail.n + F.get(counts, k)).otherwise(tail.n).alias("n"),
                fits.alias("open"),
            )

        return F.aggregate(back, nothing, extend)

    def state(first, n, cuts):
        return F.struct(first.alias("first"), n.alias("n"), cuts.alias("cuts"))

    def cut(first, stop, n):
        return F.array(F.struct(first.alias("first"), stop.alias("stop"), n.alias("n")))

    def step(acc, i):
        size = F.get(counts, i)
        full = (i > acc.first) & (acc.n + size > target) & (acc.n >= smallest)
        return F.when(
            full,
            bind(
                carried(acc.first, i),
                lambda tail: state(
                    tail.first,
                    tail.n + size,
                    F.concat(acc.cuts, cut(acc.first, i, acc.n)),
                ),
            ),
        ).otherwise(state(acc.first, acc.n + size, acc.cuts))

    start = F.struct(
        F.lit(0).alias("first"),
        F.lit(0).alias("n"),
        F.array().cast(cut_type).alias("cuts"),
    )
    total = F.size(counts)
    return F.when(total == 0, F.array().cast(cut_type)).otherwise(
        F.aggregate(
            F.sequence(F.lit(0), total - 1),
            start,
            step,
            lambda acc: F.concat(acc.cuts, cut(acc.first, total, acc.n)),
        )
    )


def with_chunks(df: DataFrame, target_words: int = 180, overlap_words: int = 45) -> DataFrame:
    """Replace the ``blocks`` column by ``chunks array<struct<ordinal,page,text,n_words>>``."""
    target = max(40, target_words)
    overlap = max(0, min(overlap_words, target // 2))
    smallest = max(20, target // 3)
    others = [c for c in df.columns if c != "blocks"]
    units = df.select(*others, sentence_units(F.col("blocks"), int(target * 1.5)).alias("_units"))
    sized = units.select("*", F.transform("_units", lambda u: u.n).alias("_sizes"))
    cuts = sized.select(
        *others, "_units", chunk_cuts(F.col("_sizes"), target, overlap, smallest).alias("_cuts")
    )
    chunk = F.transform(
        "_cuts",
        lambda c, k: F.struct(
            k.alias("ordinal"),
            F.get(F.col("_units"), c.first).page.alias("page"),
            F.array_join(
                F.transform(
                    F.slice("_units", c.first + 1, c.stop - c.first), lambda u: u.text
                ),
                " ",
            ).alias("text"),
            c.n.alias("n_words"),
        ),
    )
    return cuts.select(*others, chunk.alias("chunks"))


def chunk_rows(df: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """One row per chunk of a frame with ``doc_id`` and ``chunks``; ``carry`` names columns to keep.

    The outer form keeps the optimizer from inferring ``size(chunks) > 0``, a filter it
    would push below the chunking and so run the whole computation a second time.
    """
    kept = carry or []
    rows = df.select("doc_id", *kept, F.inline_outer("chunks")).where(F.col("ordinal").isNotNull())
    return rows.select(
        F.concat_ws(":", "doc_id", F.col("ordinal").cast("string")).alias("chunk_id"),
        "doc_id", *kept, "ordinal", "page", "text", "n_words",
    )
