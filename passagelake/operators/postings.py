"""Forward and inverted index: term counts, postings, vocabulary, gram prefixes."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as T
from .blockmax import ranked


def bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def analysed(chunks: DataFrame) -> DataFrame:
    """Add ``length`` and ``counts array<struct<term,tf>>``: the forward index.

    The same as :func:`.text.tokens` and :func:`.text.term_counts`. Texts are folded by Spark; each
    word that a worker meets is stemmed once.
    """
    counted = F.arrow_udf(_counted, FOUND)
    found = chunks.select("*", counted(T.fold(F.col("text"))).alias("_found"))
    return found.select(*chunks.columns, "_found.length", "_found.counts")


FOUND = "struct<length:int,counts:array<struct<term:string,tf:int>>>"
#: words whose terms a worker remembers
KNOWN_WORDS = 200_000


class _Terms(dict):
    """The term of each word, None for stop words."""

    def __missing__(self, word: str) -> str | None:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        term = self[word] = None if word in _STOPWORDS else _stem(word)
        return term


_STOPWORDS = frozenset(lx.STOPWORDS)
_terms = _Terms()


def _stem(word: str) -> str:
    """As :func:`.text.stem`."""
    if len(word) > lx.UNSTEMMED_LENGTH:
        for suffix, replacement, shortest in lx.SUFFIX_RULES:
            kept = len(word) - len(suffix)
            if kept + len(replacement) >= shortest and word.endswith(suffix):
                return word[:kept] + replacement
    return word


def _counted(folded):
    """Number of tokens and counts by term of an Arrow array of folded texts."""
    import pyarrow as pa

    words, term_of = re.compile(lx.TOKEN_PATTERN).findall, _terms.__getitem__
    lengths, ends, terms, counts = [], [0], [], []
    for text in folded.to_pylist():
        if text is None:
            lengths.append(None)
        else:
            found = Counter(map(term_of, words(text)))
            found.pop(None, None)
            lengths.append(found.total())
            ordered = sorted(found)
            terms += ordered
            counts += map(found.__getitem__, ordered)
        ends.append(len(terms))
    pairs = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(counts, pa.int32())], ["term", "tf"])
    nothing = pa.array([n is None for n in lengths])
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs, mask=nothing if None in lengths else None)
    return pa.StructArray.from_arrays([pa.array(lengths, pa.int32()), lists], ["length", "counts"])


def document_frequency(postings_: DataFrame, rows: Column | None = None) -> DataFrame:
    """``term, df`` from one row a posting, or from blocks of ``rows`` postings each."""
    return postings_.groupBy("term").agg((F.count("*") if rows is None else rows).alias("df"))


def corpus_totals(chunks: DataFrame) -> DataFrame:
    """Chunk count and token total over chunks that hold at least one token."""
    return chunks.where("length > 0").agg(
        F.count("*").alias("n_chunks"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("total_len"),
    )


# -- fuzzy matching: prefix filtering over character grams ---------------------------
#
# Two gram sets with similarity >= t share a gram among the first
# |x| - ceil(t*|x|) + 1 grams of each, under any common order of grams. Ordering by
# rarity keeps the shared grams rare, so a gram that half of the vocabulary has is
# hardly ever joined on, and no neighbour is lost.


def gram_order(vocabulary: DataFrame) -> DataFrame:
    """How many terms hold each gram. Tokens use 38 characters, so with the padding mark
    there can be no more than 39^3 grams of three (plus the few shorter ones)."""
    return (
        vocabulary.select(F.explode_outer(T.char_ngrams(F.col("term"))).alias("gram"))
        .groupBy("gram")
        .agg(F.count("*").alias("holders"))
    )


def prefix_length(n: Column) -> Column:
    required = F.ceil(n * F.lit(lx.FUZZY_MIN_SIMILARITY) - F.lit(1e-9))
    return (n - required + 1).cast("int")


def gram_prefixes(terms: DataFrame, order: DataFrame) -> DataFrame:
    """``term, n_grams, grams, prefix, signature`` with grams from rarest to most common.

    The signature sets one of 64 bits per gram, a cheap bound on how many grams two terms
    can share. ``order``, a written table, is bounded by the gram alphabet, see :func:`gram_order`; it
    goes to the tasks, so a term's grams are put in order within its row. No term comes twice.
    """
    held = order.select("gram", "holders").toArrow()
    holders = dict(zip(held["gram"].to_pylist(), held["holders"].to_pylist()))
    sent = terms.sparkSession.sparkContext.broadcast(holders)
    rarest_first = F.arrow_udf(lambda grams: _rarest_first(grams, sent.value), "array<string>")

    def with_bit(bits, gram):
        place = F.pmod(F.xxhash64(gram), F.lit(64)).cast("int")
        return bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))

    found = terms.select("term", T.char_ngrams(F.col("term")).alias("_grams")).select(
        "term", "_grams", rarest_first("_grams").alias("grams")
    )
    return found.select(
        "term",
        F.size("grams").alias("n_grams"),
        "grams",
        F.slice("grams", F.lit(1), prefix_length(F.size("grams"))).alias("prefix"),
        F.aggregate("_grams", F.lit(0).cast("long"), with_bit).alias("signature"),
    )


def _rarest_first(grams, holders: dict[str, int]):
    """Every list of grams by its number of holders, then by name."""
    import numpy as np
    import pyarrow as pa

    flat, sizes = grams.flatten(), grams.value_lengths().to_numpy()
    names, place = ranked(flat)
    rank = np.empty(len(names), np.int64)
    rank[np.argsort([holders.get(n, 0) for n in names.to_pylist()], kind="stable")] = np.arange(len(names))
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(row * max(len(names), 1) + rank[place])
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), flat.take(pa.array(order)))


def by_prefix_gram(prefixes: DataFrame) -> DataFrame:
    return prefixes.select(F.explode_outer("prefix").alias("gram"), "*")


