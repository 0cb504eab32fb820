"""Settings: one frozen object, defaults overridable from the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

PREFIX = "PASSAGELAKE_"
SWITCHED_ON = {"1", "true", "yes", "on"}


def _typed(text: str, default):
    """``text`` as a value of the default's type; what cannot be read is the default."""
    text = text.strip()
    if not text:
        return default
    if isinstance(default, bool):
        return text.lower() in SWITCHED_ON
    try:
        return type(default)(text)
    except ValueError:
        return default


@dataclass(frozen=True)
class Settings:
    """Every field may be given, or set as ``PASSAGELAKE_<FIELD>``."""

    # layout: how many directories postings (by term) and chunks (by document) are
    # spread over. Raise both with the corpus; 4096 suits tens of terabytes. An index keeps
    # the numbers it was written with until it is compacted.
    term_buckets: int | None = None
    doc_buckets: int | None = None
    # the largest side, in rows and bytes, that may be sent to every executor
    broadcast_rows: int | None = None
    broadcast_mb: int | None = None
    # rows of one key that a single task takes; more are split
    hot_rows: int | None = None
    # copies made of the small side when it is too big to broadcast
    salts: int | None = None
    # retrieval
    top_k: int | None = None
    candidate_k: int | None = None
    neighbour_window: int | None = None
    mmr_lambda: float | None = None
    embeddings: bool | None = None
    embedding_model: str | None = None
    # documents
    chunk_words: int | None = None
    chunk_overlap: int | None = None
    max_upload_mb: int | None = None

    def __post_init__(self) -> None:
        for field in fields(self):
            if getattr(self, field.name) is None:
                text = os.environ.get(PREFIX + field.name.upper(), "")
                object.__setattr__(self, field.name, _typed(text, DEFAULTS[field.name]))

    @property
    def max_upload_bytes(self) -> int:
        return self.max_upload_mb * 1024 * 1024


DEFAULTS = {
    "term_buckets": 16, "doc_buckets": 16, "broadcast_rows": 500_000, "broadcast_mb": 64,
    "hot_rows": 2_000_000, "salts": 16, "top_k": 6, "candidate_k": 40, "neighbour_window": 1,
    "mmr_lambda": 0.7, "embeddings": False,
    "embedding_model": "sentence-transformers/all-MiniLM-L6-v2", "chunk_words": 180,
    "chunk_overlap": 45, "max_upload_mb": 25,
}
