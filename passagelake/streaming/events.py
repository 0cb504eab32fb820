"""An answer as a sequence of events: sources, text, done (or error)."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..operators.answer import prompt_messages
from ..operators.context import sources
from ..plans.engine import Engine


def ask_stream(engine: Engine, question: str, **options) -> Iterator[dict]:
    """Yield ``sources`` as soon as they are found, then ``delta`` texts as they are made,
    then ``done``; or ``error``.

    A generator that returns pieces of text is called here and passed on piece by piece.
    The one row retrieved for the question is all that reaches the caller.
    """
    if not (question or "").strip():
        yield {"type": "error", "message": "Question must not be empty."}
        return
    started = time.perf_counter()

    def since(moment: float) -> float:
        return round((time.perf_counter() - moment) * 1000, 1)

    try:
        found = engine.found_one(question, **options)
        nothing = F.array().cast("array<int>")
        head = found.select("query_used", "refused", sources(F.col("blocks"), nothing).alias("sources")).first()
    except Exception as problem:
        yield {"type": "error", "message": f"Retrieval failed: {problem}"}
        return
    retrieval = since(started)
    if head["refused"]:
        yield {"type": "error", "message": head["refused"]}
        return
    yield {
        "type": "sources",
        "sources": [{**s.asDict(), "cited": False} for s in head["sources"]],
        "query_used": head["query_used"],
    }
    if not head["sources"]:
        yield {"type": "delta", "text": lx.NO_MATCH_ANSWER}
        yield {"type": "done", "mode": "no_match", "timing_ms": {"retrieval": retrieval}}
        return
    begun, streamed, problem = time.perf_counter(), [], None
    if engine.generator is not None:
        messages = found.select(
            prompt_messages(F.col("question"), F.col("blocks"), F.col("history")).alias("m")
        ).first()["m"]
        try:
            made = engine.generator([m.asDict() for m in messages])
            for text in [made] if isinstance(made, str) else made or []:
                streamed.append(text)
                yield {"type": "delta", "text": text}
        except Exception as failure:
            yield {"type": "error", "message": f"Answer generation failed: {failure}"}
            return
    text = "".join(streamed).strip()
    answer = found.select("*", F.lit(text or None).cast("string").alias("generated"), F.lit(problem).cast("string").alias("problem"))
    row = engine.finished(answer).first()
    if not text:
        yield {"type": "delta", "text": row["answer"]}
    yield {
        "type": "done",
        "mode": row["mode"],
        "model": row["model"],
        "sources": [s.asDict() for s in row["sources"]],
        "timing_ms": {"retrieval": retrieval, "generation": since(begun), "total": since(started)},
    }


def server_sent(events: Iterator[dict]) -> Iterator[str]:
    """Frame events for delivery over a text stream."""
    for event in events:
        yield f"data: {json.dumps(event)}\n\n"
