"""Dense ranking: exact inner-product search, and a plug-in point for an encoder."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings

HIT = "query_id string, chunk_id string, doc_id string, score double"

# queries scored at a time inside a task, which bounds the size of the product
_COLUMNS = 256

# An encoder turns texts into vectors of unit length.
Encoder = Callable[[list[str]], list[list[float]]]


def build_encoder(enabled: bool, model_name: str) -> Encoder | None:
    """The configured sentence encoder, or None where it is off or cannot be had."""
    if not enabled:
        return None
    try:
        load_model(model_name)
    except Exception as problem:
        logging.getLogger(__name__).warning(
            "No encoder %s (%s); retrieval stays lexical.", model_name, problem
        )
        return None
    return lambda texts: load_model(model_name).encode(texts, normalize_embeddings=True).tolist()


@lru_cache(maxsize=1)
def load_model(model_name: str):
    """One model per process: loaded on the driver to check, then in each worker."""
    from sentence_transformers import SentenceTransformer

    return SentenceTransformer(model_name)


def encode(texts: DataFrame, key: list[str], text: str, encoder: Encoder) -> DataFrame:
    """``key..., vector`` for every text but those the encoder fails on.

    A batch that fails is encoded text by text, so that one bad text costs no other its
    vector, however texts are batched.
    """
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.select(key).schema)

    def each(values: list[str]) -> list:
        try:
            vectors = list(encoder(values))
            if len(vectors) == len(values):
                return vectors
        except Exception as problem:
            if len(values) == 1:
                logging.getLogger(__name__).warning("A text has no vector: %s", problem)
        return [None] if len(values) == 1 else [v for value in values for v in each([value])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = each(list(batch[text])) if len(batch) else []
            has = [v is not None for v in vectors]
            rows = batch[key][has].copy()
            # of objects, also where no text has a vector: an empty list would be a column of numbers
            kept = [np.asarray(v, dtype="float64") for v in vectors if v is not None]
            rows["vector"] = pd.Series(kept, index=rows.index, dtype="object")
            yield rows

    return texts.select(*key, text).mapInPandas(run, f"{fields}, vector array<double>")


def _best(query: np.ndarray, score: np.ndarray, names: np.ndarray, limit: int) -> np.ndarray:
    """Places of the best ``limit`` rows of every query. Names are compared only where scores
    are equal at the limit; the greatest count, and nulls last."""
    order = np.lexsort((-score, query))
    starts = np.flatnonzero(np.diff(query[order], prepend=-1))
    sizes = np.diff(np.append(starts, len(order)))
    rank = np.arange(len(order)) - np.repeat(starts, sizes)
    last = np.repeat(score[order[starts + np.minimum(sizes, limit) - 1]], sizes)
    tied = score[order] == last
    kept, over = rank < limit, np.repeat(sizes > limit, sizes) & tied
    if (over & ~kept).any():
        rows = order[over]
        named = np.array([n is not None for n in names[rows]], bool)
        place = np.full(len(rows), -1)
        place[named] = np.unique(names[rows][named], return_inverse=True)[1]
        # the tied rows of a query share the places that better ones leave
        order[np.flatnonzero(over)] = rows[np.lexsort((-place, query[rows]))]
    return order[kept]


def _search(query_ids: list[str], queries: np.ndarray, limit: int, limited: set[str]):
    """Score partitions against one block of query vectors, keeping ``limit`` rows each.

    A query in ``limited`` sees only rows whose ``allowed`` list names it.
    """
    width = queries.shape[1]
    position = {q: i for i, q in enumerate(query_ids)}
    free = np.array([q not in limited for q in query_ids])
    # the queries of one id share a top, those without any have none
    tops = [*dict.fromkeys(q for q in query_ids if q is not None)]
    top = {q: i for i, q in enumerate(tops)}
    top_of = np.array([top.get(q, -1) for q in query_ids], np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query, score = np.empty(0, np.int64), np.empty(0)
        chunks = docs = np.empty(0, object)
        floor = np.full(len(tops) + 1, -np.inf)
        for batch in batches:
            vectors = np.zeros((len(batch), width))
            for row, vector in enumerate(batch["vector"]):
                shared = min(width, len(vector))
                vectors[row, :shared] = vector[:shared]
            allowed = None
            if limited:
                allowed = np.tile(free, (len(batch), 1))
                for row, ids in enumerate(batch["allowed"]):
                    if ids is not None:
                        allowed[row, [position[q] for q in ids if q in position]] = True
            # The matrix product finds what can still enter the top; those few scores
            # are then summed row by row, so equal vectors get equal scores.
            rows, columns = [], []
            for low in range(0, len(query_ids), _COLUMNS):
                part = slice(low, low + _COLUMNS)
                rough = vectors @ queries[part].T
                if allowed is not None:
                    rough = np.where(allowed[:, part], rough, -np.inf)
                bar = floor[top_of[part]]
                if len(batch) > limit and not np.isfinite(bar).all():
                    bar = np.maximum(bar, np.partition(rough, -limit, axis=0)[-limit])
                row, column = np.nonzero((rough >= bar - 1e-9) & np.isfinite(rough))
                rows.append(row)
                columns.append(column + low)
            row, column = np.concatenate(rows), np.concatenate(columns)
            row, column = row[top_of[column] >= 0], column[top_of[column] >= 0]
            exact = (vectors[row] * queries[column]).sum(axis=1)
            query = np.concatenate((query, top_of[column]))
            score = np.concatenate((score, np.floor(exact * 1e9 + 0.5) / 1e9))
            chunks = np.concatenate((chunks, batch["chunk_id"].to_numpy(dtype=object)[row]))
            docs = np.concatenate((docs, batch["doc_id"].to_numpy(dtype=object)[row]))
            kept = _best(query, score, chunks, limit)
            query, score, chunks, docs = query[kept], score[kept], chunks[kept], docs[kept]
            full = np.flatnonzero(np.bincount(query, minlength=len(tops)) >= limit)
            least = np.full(len(tops), np.inf)
            np.minimum.at(least, query, score)
            floor[full] = least[full]
        if len(query):
            yield pd.DataFrame(
                {"query_id": np.array(tops, object)[query], "chunk_id": chunks, "doc_id": docs, "score": score}
            )

    return run


def dense_topk(
    vectors: DataFrame,
    query_vectors: DataFrame,
    limit: int,
    settings: Settings,
    scope: DataFrame | None = None,
) -> DataFrame:
    """``query_id, chunk_id, doc_id, score, rank`` by inner product, no floor.

    ``vectors`` (chunk_id, doc_id, vector) is scanned where it lies. Query vectors are
    sent to the tasks in blocks of bounded size; more queries mean more blocks, each
    with its own scan. ``scope`` (query_id, doc_id) limits the documents of a question.
    """
    block_rows = max(1, min(4096, settings.broadcast_rows))
    total = query_vectors.count()
    blocks = -(-total // block_rows) * 2 if total > block_rows else 1
    block_of = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    columns = ["chunk_id", "doc_id", "vector"]
    found = None
    for block in range(blocks):
        rows = query_vectors.where(block_of == block).select("query_id", "vector").collect()
        if not rows:
            continue
        ids = [r["query_id"] for r in rows]
        width = max(len(r["vector"]) for r in rows)
        matrix = np.zeros((len(rows), width))
        for i, r in enumerate(rows):
            matrix[i, : len(r["vector"])] = r["vector"]
        source = vectors.select(*columns)
        limited: set[str] = set()
        if scope is not None:
            # no more readers per document than there are queries in the block
            mine = scope.where(block_of == block)
            limited = {r[0] for r in mine.select("query_id").distinct().collect()}
            readers = mine.groupBy("doc_id").agg(F.collect_set("query_id").alias("allowed"))
            source = source.join(readers, "doc_id", "left")
        part = source.mapInPandas(_search(ids, matrix, limit, limited), HIT)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], HIT)
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("chunk_id"))
    return found.withColumn("rank", F.row_number().over(best_first)).where(
        F.col("rank") <= limit
    )
