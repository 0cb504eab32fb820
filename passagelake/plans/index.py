"""A snapshot of the tables retrieval reads, and retrieval over it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import tokens
from ..operators import blockmax, lexical
from ..operators.context import context_blocks
from ..operators.dense import Encoder, dense_topk, encode
from ..operators.diversify import diversify
from ..operators.fusion import fuse
from ..operators.postings import bucket
from ..operators.scope import Scope
from ..workspace import fits_broadcast, join_small, prune_buckets, save


@dataclass(frozen=True)
class Index:
    documents: DataFrame
    chunks: DataFrame
    # one row a posting, and the blocks they lie in
    postings: DataFrame
    blocks: DataFrame
    vocabulary: DataFrame
    # the same before it is summed over the segments, for lookups of a few terms
    term_rows: DataFrame
    grams: DataFrame
    gram_order: DataFrame
    n_chunks: int
    average_length: float
    settings: Settings
    # bitmaps of deleted documents by segment and bucket; None if they are too large to hold
    gone: dict | None = None
    vectors: DataFrame | None = None
    # where documents lie: segment, doc_bucket, doc_id, number; and the names of the segments
    places: DataFrame | None = None
    segments: tuple[str, ...] = ()

    # -- lexical --------------------------------------------------------------------

    def expansions(self, terms: DataFrame) -> DataFrame:
        return lexical.expand_terms(
            terms, self.term_rows, self.grams, self.gram_order, self.settings
        )

    def weights(self, questions: DataFrame) -> DataFrame:
        terms = save(lexical.question_terms(questions), "question-terms")
        distinct = save(terms.select("term").distinct(), "terms")
        return save(
            lexical.term_weights(terms, self.expansions(distinct), self.n_chunks), "weights"
        )

    def lexical(
        self, questions: DataFrame, limit: int, scope: DataFrame | Scope | None = None
    ) -> DataFrame:
        """The best chunks of every question. Weights and scope of checked size go to where the
        postings lie; larger ones are joined with them and shuffled.

        ``scope`` has query_id and doc_id, or names sets of documents that questions share.
        """
        weights = self.weights(questions)
        pairs = None
        if isinstance(scope, DataFrame):
            pairs = save(scope.select("query_id", "doc_id").distinct(), "scope")
            scope = None if fits_broadcast(pairs, self.settings) else Scope.of(pairs)
        if scope is not None:
            scope = scope.saved()
        if self.gone is not None and fits_broadcast(weights, self.settings):
            placed = (None, None) if scope is None else self._placed(scope)
            if placed is not None:
                sets, members = placed
                wanted = blockmax.asked(weights, None if scope else pairs, sets)
                scores = blockmax.best_in_buckets(
                    self.blocks, wanted, self.average_length, limit, self.gone, members
                )
                return lexical.top_chunks(scores, limit)
        if scope is not None:
            pairs = scope.pairs()
        scores = lexical.bm25_scores(weights, self.postings, self.average_length, self.settings, pairs)
        return lexical.top_chunks(scores, limit)

    def _placed(self, scope: Scope) -> tuple[DataFrame, dict] | None:
        """Which sets the questions name, and the numbers of their documents by segment and
        bucket; None if they are too many to send."""
        if not fits_broadcast(scope.asked, self.settings):
            return None
        # a set is known by its place among the names, which are no more than the questions
        order = Window.orderBy("scope")
        codes = save(
            scope.asked.select("scope").distinct().withColumn("set", F.row_number().over(order)), "scope-codes"
        )
        sets = save(scope.asked.join(F.broadcast(codes), "scope").select("query_id", "set"), "scope-sets")
        members = scope.members.join(F.broadcast(codes), "scope").select("doc_id", "set")
        segment = F.array_position(F.lit(list(self.segments)), F.col("segment")) - 1
        placed = save(
            self.places.distinct().join(members, "doc_id")
            .select(segment.cast("int").alias("segment"), "doc_bucket", "set", "number").distinct(),
            "scope-places",
        )
        # a number and its set
        if placed.count() * 12 > self.settings.broadcast_mb << 20:
            return None
        return sets, blockmax.numbers_by_set(placed, list(self.segments))

    # -- dense and hybrid ---------------------------------------------------------

    def search(
        self,
        questions: DataFrame,
        limit: int | None = None,
        scope: DataFrame | Scope | None = None,
        query_vectors: DataFrame | None = None,
    ) -> DataFrame:
        """Candidates ``query_id, chunk_id, doc_id, ordinal, score, rank``.

        ``questions`` has query_id and question; ``scope`` has query_id and doc_id, and a
        question it does not mention searches everything.
        """
        limit = limit or self.settings.candidate_k
        found = self.lexical(questions, limit, scope)
        if self.vectors is None or query_vectors is None:
            return found
        usable = query_vectors.join(
            questions.where(F.size(tokens(F.col("question"))) > 0).select("query_id"), "query_id", "left_semi"
        )
        if isinstance(scope, Scope):
            scope = scope.pairs()
        near = dense_topk(self.vectors, usable, limit, self.settings, scope)
        return fuse(found, near, limit)

    def encoded(self, questions: DataFrame, encoder: Encoder | None) -> DataFrame | None:
        if encoder is None or self.vectors is None:
            return None
        return save(encode(questions, ["query_id"], "question", encoder), "query-vectors")

    # -- selection and context ----------------------------------------------------

    def _chunks_of(self, hits: DataFrame) -> DataFrame:
        buckets = self.settings.doc_buckets
        return prune_buckets(
            self.chunks, "doc_bucket", hits, bucket("doc_id", buckets), buckets
        )

    def select(self, candidates: DataFrame, top_k: int, lambda_: float | None = None) -> DataFrame:
        """Diversified picks from written ``candidates``."""
        terms = self._chunks_of(candidates).select(
            "chunk_id", F.col("counts.term").alias("terms")
        )
        with_terms = join_small(terms, candidates, ["chunk_id"], "chunk_id", self.settings)
        chosen = self.settings.mmr_lambda if lambda_ is None else lambda_
        return diversify(with_terms, top_k, chosen)

    def retrieve(
        self,
        questions: DataFrame,
        top_k: int | None = None,
        scope: DataFrame | None = None,
        query_vectors: DataFrame | None = None,
    ) -> DataFrame:
        """``query_id, blocks`` for every question that finds anything."""
        candidates = save(
            self.search(questions, scope=scope, query_vectors=query_vectors), "candidates"
        )
        picks = save(self.select(candidates, top_k or self.settings.top_k), "picks")
        return context_blocks(picks, self._chunks_of(picks), self.documents, self.settings)

