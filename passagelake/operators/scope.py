"""Which documents a question may find."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import save


@dataclass(frozen=True)
class Scope:
    """Questions that share a set of documents name it, and the set is held once.

    As pairs of question and document, sets grow with the product of both; here rows are as many as
    questions and documents. A question that names several sets may find the documents of each, one
    that names none finds everything.
    """

    asked: DataFrame  # query_id, scope
    members: DataFrame  # scope, doc_id

    @classmethod
    def of(cls, pairs: DataFrame) -> Scope:
        """Every question of ``query_id, doc_id`` with a set of its own."""
        own = F.col("query_id").alias("scope")
        return cls(pairs.select("query_id", own), pairs.select(own, "doc_id"))

    def pairs(self) -> DataFrame:
        """As ``query_id, doc_id``; without a document where a set has none, as nothing is found there."""
        return self.asked.join(self.members, "scope", "left").select("query_id", "doc_id").distinct()

    def saved(self) -> Scope:
        """Written, no row twice, and without sets that nobody names."""
        asked = save(self.asked.select("query_id", F.col("scope").cast("string")).distinct(), "scope-asked")
        members = self.members.select(F.col("scope").cast("string"), "doc_id").distinct()
        return Scope(asked, save(members.join(asked.select("scope").distinct(), "scope", "left_semi"), "scope-members"))
