from __future__ import annotations

from passagelake.config import Settings
from passagelake.operators.dense import build_encoder


def test_defaults():
    s = Settings()
    assert (s.chunk_words, s.chunk_overlap, s.candidate_k, s.top_k) == (180, 45, 40, 6)
    assert (s.mmr_lambda, s.neighbour_window, s.embeddings) == (0.7, 1, False)
    assert s.max_upload_bytes == 25 * 1024 * 1024


def test_environment(monkeypatch):
    monkeypatch.setenv("PASSAGELAKE_TOP_K", "9")
    monkeypatch.setenv("PASSAGELAKE_CHUNK_WORDS", "many")
    monkeypatch.setenv("PASSAGELAKE_EMBEDDINGS", " Yes ")
    monkeypatch.setenv("PASSAGELAKE_EMBEDDING_MODEL", "")
    s = Settings()
    assert (s.top_k, s.chunk_words, s.embeddings) == (9, 180, True)
    assert s.embedding_model == "sentence-transformers/all-MiniLM-L6-v2"


def test_no_encoder_without_the_model():
    assert build_encoder(False, "any") is None
    assert build_encoder(True, "no-such-model") is None
