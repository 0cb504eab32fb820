"""Lexical ranking: query terms, fuzzy expansion, BM25 with a match floor, top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import lexicon as lx
from ..functions import text as T
from ..workspace import fits_broadcast, join_small, prune_buckets, save
from .postings import bucket, by_prefix_gram, gram_prefixes, prefix_length


def question_terms(questions: DataFrame) -> DataFrame:
    """``query_id, pos, term``: distinct terms of each question in order."""
    return questions.select(
        "query_id",
        F.posexplode_outer(F.array_distinct(T.tokens(F.col("question")))).alias("pos", "term"),
    ).where(F.col("term").isNotNull())


def fuzzy_neighbours(
    terms: DataFrame, grams: DataFrame, order: DataFrame, settings: Settings
) -> DataFrame:
    """``q_term, term, similarity``: every vocabulary term similar enough to a query term.

    Of grams that lie in buckets only the buckets are read that the terms' grams fall into.
    """
    wanted = by_prefix_gram(gram_prefixes(terms, order)).select(
        "gram",
        F.col("term").alias("q_term"),
        F.col("n_grams").alias("q_n"),
        F.col("grams").alias("q_grams"),
        F.col("prefix").alias("q_prefix"),
        F.col("signature").alias("q_signature"),
    )
    if "gram_bucket" in grams.columns:
        wanted = save(wanted, "wanted-grams")
        buckets = settings.term_buckets
        grams = prune_buckets(grams, "gram_bucket", wanted, bucket("gram", buckets), buckets)
    n, q_n = F.col("n_grams"), F.col("q_n")
    # Two signatures share a bit for each shared gram, short of the bits that collide
    # inside one of the terms. Most pairs fall here, on integers alone.
    floor = lx.FUZZY_MIN_SIMILARITY
    needed = (q_n + n) * F.lit(floor / (1 + floor)) - F.lit(1e-9)
    slack = F.least(n - F.bit_count("signature"), q_n - F.bit_count("q_signature"))
    most_shared = slack + F.bit_count(
        F.col("signature").bitwiseAND(F.col("q_signature"))
    )
    shared = F.size(F.array_intersect("q_grams", "grams"))
    similarity = shared.cast("double") / (q_n + n - shared)
    # A pair may meet on several grams; it counts where it first could, which makes
    # the pairs distinct without another shuffle. Grams lie in order, so the first are the prefix.
    prefix = F.slice("grams", F.lit(1), prefix_length(n))
    first_meeting = F.get(F.array_intersect("q_prefix", prefix), F.lit(0))
    held = grams.select("gram", "term", "n_grams", "grams", "signature")
    return (
        join_small(held, wanted, ["gram"], "term", settings)
        .where(F.col("term") != F.col("q_term"))
        .where((most_shared >= needed) & (F.least(n, q_n) >= needed))
        .where(F.col("gram") == first_meeting)
        .select("q_term", "term", similarity.alias("similarity"))
        .where(F.col("similarity") >= lx.FUZZY_MIN_SIMILARITY)
        .distinct()
    )


def best_neighbours(neighbours: DataFrame) -> DataFrame:
    rank = F.row_number().over(
        Window.partitionBy("q_term").orderBy(F.desc("similarity"), F.desc("term"))
    )
    return (
        neighbours.withColumn("_rank", rank)
        .where(F.col("_rank") <= lx.FUZZY_MAX_EXPANSIONS)
        .drop("_rank")
    )


def known_terms(
    vocabulary: DataFrame, terms: DataFrame, settings: Settings, grows: bool = False
) -> DataFrame:
    """``terms`` (written, no row twice) with the ``df`` of those the corpus holds.

    ``vocabulary`` may have a row of a term for each segment, also to subtract. Only the buckets
    of the terms are read, and only their rows are summed. Terms whose number ``grows`` with the
    vocabulary are shuffled: the driver builds what is broadcast, and neither holds them all.
    """
    if "term_bucket" in vocabulary.columns:
        buckets = settings.term_buckets
        vocabulary = prune_buckets(vocabulary, "term_bucket", terms, bucket("term", buckets), buckets)
    rows = vocabulary.select("term", "df")
    if grows:
        met = rows.join(terms.hint("merge"), "term")
    else:
        met = join_small(rows, terms, ["term"], "term", settings)
    return met.groupBy(*terms.columns).agg(F.sum("df").alias("df")).where("df > 0")


def expand_terms(
    terms: DataFrame,
    vocabulary: DataFrame,
    grams: DataFrame,
    order: DataFrame,
    settings: Settings,
) -> DataFrame:
    """``q_term, term, weight, df`` for distinct query ``terms``: the term itself where
    the corpus has it, and always its nearest neighbours in spelling."""
    exact = known_terms(vocabulary, terms, settings).select(
        F.col("term").alias("q_term"), "term", F.lit(1.0).alias("weight"), "df"
    )
    similar = save(fuzzy_neighbours(terms, grams, order, settings), "neighbours")
    near = best_neighbours(known_terms(vocabulary, similar, settings, grows=True)).select(
        "q_term", "term", (F.lit(lx.FUZZY_WEIGHT) * F.col("similarity")).alias("weight"), "df"
    )
    return exact.unionByName(near)


def term_weights(
    query_terms: DataFrame, expansions: DataFrame, n_chunks: int
) -> DataFrame:
    """``query_id, pos, term, weight_idf, n_groups``: what each posting will be worth.

    Document frequency and corpus size always describe the whole corpus, whatever the
    scope of a question.
    """
    total = F.lit(float(n_chunks))
    idf = F.log(1.0 + (total - F.col("df") + 0.5) / (F.col("df") + 0.5))
    matched = query_terms.withColumnRenamed("term", "q_term").join(expansions, "q_term")
    groups = matched.groupBy("query_id").agg(F.count_distinct("pos").alias("n_groups"))
    return matched.join(groups, "query_id").select(
        "query_id", "pos", "term", (F.col("weight") * idf).alias("weight_idf"), "n_groups"
    )


def saturation(average_length: float) -> Column:
    """Term frequency part of BM25 for a posting row."""
    tf = F.col("tf").cast("double")
    relative = F.col("length") / F.lit(average_length)
    norm = F.lit(lx.BM25_K1) * ((1.0 - lx.BM25_B) + F.lit(lx.BM25_B) * relative)
    return tf * (lx.BM25_K1 + 1.0) / (tf + norm)


def in_scope(hits: DataFrame, scope: DataFrame, settings: Settings) -> DataFrame:
    """Keep hits inside their question's documents; unmentioned questions keep all.

    ``hits`` says in ``limited`` whether its question has a scope.
    """
    allowed = scope.select("query_id", "doc_id").distinct().withColumn("_allowed", F.lit(True))
    if fits_broadcast(allowed, settings):
        allowed = F.broadcast(allowed)
    return hits.join(allowed, ["query_id", "doc_id"], "left").where(
        ~F.col("limited") | F.col("_allowed")
    )


def steady(score: Column) -> Column:
    """Nine decimals: sums that differ only by the order of addition become equal, so
    that ties are real ties and are broken by the stated keys."""
    return F.floor(score * 1e9 + 0.5) / F.lit(1e9)


def bm25_scores(
    weights: DataFrame,
    postings: DataFrame,
    average_length: float,
    settings: Settings,
    scope: DataFrame | None = None,
) -> DataFrame:
    """``query_id, doc_id, ordinal, score`` of the chunks above the match floor."""
    if scope is not None:
        scope = save(scope.select("query_id", "doc_id"), "scope")
        named = scope.select("query_id").distinct().withColumn("_named", F.lit(True))
        weights = save(
            weights.join(named, "query_id", "left")
            .withColumn("limited", F.col("_named").isNotNull())
            .drop("_named"),
            "scoped-weights",
        )
    hits = join_small(
        postings.select("term", "doc_id", "ordinal", "tf", "length"),
        weights,
        ["term"],
        "doc_id",
        settings,
    )
    if scope is not None:
        hits = in_scope(hits, scope, settings)
    # Only numbers are aggregated: Spark then keeps to hash aggregation.
    scored = hits.groupBy("query_id", "doc_id", "ordinal").agg(
        steady(F.sum(F.col("weight_idf") * saturation(average_length))).alias("score"),
        (F.min("pos") < F.max("pos")).alias("several"),
        F.max("n_groups").alias("n_groups"),
    )
    # A floor of two distinct terms is met exactly when the first and the last matched
    # position differ, so no set has to be collected per chunk.
    short = F.col("n_groups") <= lx.SHORT_QUESTION_TERMS
    return scored.where(short | F.col("several")).select(
        "query_id", "doc_id", "ordinal", "score"
    )


def top_chunks(scores: DataFrame, limit: int) -> DataFrame:
    """Best ``limit`` chunks per question with their ``rank``; ties by document, ordinal.

    The limit on ``row_number`` is applied to each partition before the shuffle too, so
    a question that matches a third of the corpus still moves ``limit`` rows per task.
    """
    best_first = Window.partitionBy("query_id").orderBy(
        F.desc("score"), "doc_id", "ordinal"
    )
    ranked = scores.withColumn("rank", F.row_number().over(best_first))
    chunk_id = F.concat_ws(":", "doc_id", F.col("ordinal").cast("string"))
    return ranked.where(F.col("rank") <= limit).select(
        "query_id", chunk_id.alias("chunk_id"), "doc_id", "ordinal", "score", "rank"
    )
