from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import CORPUS, uploads
from passagelake.config import Settings
from passagelake.functions import lexicon as lx
from passagelake.operators import lexical
from passagelake.operators import postings as P
from passagelake.operators.dense import dense_topk
from passagelake.operators.diversify import diversify
from passagelake.operators.fusion import fuse
from passagelake.workspace import join_small, save

TINY = Settings(broadcast_rows=0, salts=3, term_buckets=3, doc_buckets=3)


def index_of(spark, engine, chunks: dict[str, list[str]], segment="s"):
    """Index ready-made chunks, one document per key."""
    rows = [
        (d, [(i, None, t, len(t.split())) for i, t in enumerate(texts)]) for d, texts in chunks.items()
    ]
    parsed = spark.createDataFrame(
        rows, "doc_id string, chunks array<struct<ordinal:int,page:int,text:string,n_words:int>>"
    )
    totals = engine._write_index(parsed, segment, None)
    engine.store.commit(segment, "ingest", "now", documents=len(chunks), **totals)
    return engine.index()


NIGHTS = {
    "n1": [
        "Clouds rolled over the ridge, so the shutter stayed closed and nobody opened the log.",
        "Each visitor signs the guest log beside the stairs before climbing to the dome.",
    ],
    "n2": [
        "Meteor counts go to the survey office before breakfast on the following morning.",
        "Filters are rinsed in alcohol, dried with lint and boxed beside the dome door.",
    ],
    "n3": ["Tuners adjust nineteen strings of the old harp under lamplight."],
}


def ask(spark, index, question, scope=None, limit=40):
    asked = spark.createDataFrame([("q", question)], "query_id string, question string")
    if scope is not None:
        scope = spark.createDataFrame([("q", d) for d in scope], "query_id string, doc_id string")
    return index.search(asked, limit, scope).orderBy("rank").collect()


@pytest.fixture(scope="module")
def nights(spark, small, tmp_path_factory):
    from passagelake.plans.engine import Engine

    engine = Engine(spark, str(tmp_path_factory.mktemp("nights")), small)
    return index_of(spark, engine, NIGHTS)


def test_relevant_chunk_first(spark, nights):
    assert ask(spark, nights, "where do the meteor counts go after the survey")[0]["chunk_id"] == "n2:0"
    assert ask(spark, nights, "who signs the log by the stairs")[0]["chunk_id"] == "n1:1"


def test_misspelt_and_inflected_words_still_match(spark, nights):
    assert ask(spark, nights, "filtr alcohool")[0]["chunk_id"] == "n2:1"
    assert ask(spark, nights, "harps")[0]["doc_id"] == "n3"
    assert ask(spark, nights, "visitrs climbing")[0]["chunk_id"] == "n1:1"


def test_unknown_words_find_nothing(spark, nights):
    assert ask(spark, nights, "xylophone quicksand") == []
    assert ask(spark, nights, "over the and under") == []


def test_scope_limits_hits_but_not_statistics(spark, nights):
    free = {r["chunk_id"]: r["score"] for r in ask(spark, nights, "dome beside")}
    scoped = ask(spark, nights, "dome beside", ["n2"])
    assert {r["doc_id"] for r in scoped} == {"n2"} and len(free) > len(scoped)
    assert all(r["score"] == free[r["chunk_id"]] for r in scoped)
    assert ask(spark, nights, "dome beside", ["nobody"]) == []
    assert len(ask(spark, nights, "dome beside", [])) == len(free)


def test_two_words_must_match_when_three_are_known(spark, nights):
    assert ask(spark, nights, "harp meteor ridge alcohol") == []
    assert {r["doc_id"] for r in ask(spark, nights, "harp meteor")} == {"n2", "n3"}


def test_scores_match_the_formula(spark, nights):
    """Exact scores for a single known word, worked out from the counts."""
    from passagelake.functions import text as T

    rows = spark.createDataFrame([(t,) for texts in NIGHTS.values() for t in texts], "text string")
    tokens = [r[0] for r in rows.select(T.tokens(F.col("text"))).collect()]
    average = sum(map(len, tokens)) / len(tokens)
    holders = [t for t in tokens if "dome" in t]
    idf = np.log(1 + (len(tokens) - len(holders) + 0.5) / (len(holders) + 0.5))
    want = {round(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len(t) / average)), 6) for t in holders}
    assert {round(r["score"], 6) for r in ask(spark, nights, "dome")} == want


def test_ties_by_document_then_ordinal(spark, make_engine):
    same = "identical words everywhere"
    index = index_of(spark, make_engine(), {"b": [same] * 3, "a": [same] * 2})
    hits = ask(spark, index, "identical words")
    assert [r["chunk_id"] for r in hits] == ["a:0", "a:1", "b:0", "b:1", "b:2"]


def brute_neighbours(term, vocabulary):
    def grams(word):
        padded = f"${word}$"
        return {padded[i : i + 3] for i in range(max(1, len(padded) - 2))}

    scored = []
    for other in vocabulary:
        if other != term:
            a, b = grams(term), grams(other)
            similarity = len(a & b) / len(a | b)
            if similarity >= lx.FUZZY_MIN_SIMILARITY:
                scored.append((similarity, other))
    return {(o, s) for s, o in scored}


def test_fuzzy_neighbours_are_complete(spark, small):
    """Prefix filtering loses nothing, whichever way the join runs."""
    import random

    rng = random.Random(3)
    stems = ["meteor", "shutter", "visitor", "dome", "ab", "a", "aaaa", "needling", "colon"]
    vocabulary = set(stems)
    for word in stems * 30:
        letters = list(word)
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(letters) + 1)
            letters[at : at + rng.randint(0, 1)] = rng.choice("abcdeinorst")
        vocabulary.add("".join(letters) or "x")
    frame = spark.createDataFrame([(v, 1) for v in sorted(vocabulary)], "term string, df long")
    order = save(P.gram_order(frame), "order")
    grams = save(P.by_prefix_gram(P.gram_prefixes(frame, order)), "grams")
    terms = [*stems, "incidnt", "zzz", "licences"]
    wanted = save(spark.createDataFrame([(t,) for t in terms], "term string"), "wanted")
    expected = {(t, o, round(s, 9)) for t in terms for o, s in brute_neighbours(t, vocabulary)}
    for settings in (small, TINY):
        found = lexical.fuzzy_neighbours(wanted, grams, order, settings).collect()
        assert {(r["q_term"], r["term"], round(r["similarity"], 9)) for r in found} == expected
        assert len(found) == len(expected)


def test_salted_join_equals_broadcast_join(spark, small):
    large = spark.createDataFrame([("hot" if i % 3 else "cold", i) for i in range(300)], "k string, i int")
    few = spark.createDataFrame([("hot", 1.0), ("hot", 2.0), ("none", 3.0)], "k string, w double")
    few = save(few, "few")
    got = [sorted(map(tuple, join_small(large, few, ["k"], "i", s).collect())) for s in (small, TINY)]
    assert got[0] == got[1] and len(got[0]) == 400


def test_search_is_the_same_without_broadcasts(spark, nights):
    from dataclasses import replace

    question = "who signs the guest log beside the dome, and where do filtrs go"
    salted = replace(nights, settings=TINY)
    assert ask(spark, salted, question) == ask(spark, nights, question)


def test_dense_matches_brute_force(spark, small):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(200, 8))
    vectors[50:60] = vectors[40]  # ties
    queries = rng.normal(size=(3, 8))
    queries[0] = vectors[40]
    frame = spark.createDataFrame(
        [(f"c{i:03}", f"d{i % 7}", v.tolist()) for i, v in enumerate(vectors)],
        "chunk_id string, doc_id string, vector array<double>",
    ).repartition(5)
    asked = spark.createDataFrame(
        [(f"q{i}", v.tolist()) for i, v in enumerate(queries)], "query_id string, vector array<double>"
    )
    scope = spark.createDataFrame([("q1", "d2"), ("q2", "d9")], "query_id string, doc_id string")
    found = dense_topk(frame, asked, 12, small).collect()
    for i, q in enumerate(queries):
        scores = sorted(((round(float(v @ q), 6), f"c{j:03}") for j, v in enumerate(vectors)), reverse=True)
        got = sorted((r for r in found if r["query_id"] == f"q{i}"), key=lambda r: r["rank"])
        assert [(round(r["score"], 6), r["chunk_id"]) for r in got] == scores[:12]
    scoped = dense_topk(frame, asked, 500, small, scope).collect()
    assert {r["doc_id"] for r in scoped if r["query_id"] == "q1"} == {"d2"}
    assert [r for r in scoped if r["query_id"] == "q2"] == []
    assert len([r for r in scoped if r["query_id"] == "q0"]) == 200
    blocks = dense_topk(frame, asked, 12, Settings(broadcast_rows=1)).collect()
    assert sorted(map(tuple, blocks)) == sorted(map(tuple, found))


def test_vectors_of_unequal_length(spark, small):
    frame = spark.createDataFrame([("c", "d", [1.0, 2.0, 9.0])], "chunk_id string, doc_id string, vector array<double>")
    asked = spark.createDataFrame([("q", [3.0, 1.0])], "query_id string, vector array<double>")
    assert dense_topk(frame, asked, 5, small).first()["score"] == 5.0


def ranking(spark, rows):
    return spark.createDataFrame(
        [("q", c, c.split(":")[0], s, r) for r, (c, s) in enumerate(rows, start=1)],
        "query_id string, chunk_id string, doc_id string, score double, rank int",
    )


def test_fusion_order(spark):
    lexical_hits = ranking(spark, [("a:0", 9.0), ("b:0", 8.0), ("c:0", 7.0)])
    dense_hits = ranking(spark, [("d:0", 0.9), ("c:0", 0.8), ("e:0", 0.7)])
    fused = fuse(lexical_hits, dense_hits, 4).orderBy("rank").collect()
    # c is in both; a and d tie and a, the lexical one, stays ahead; b and then e
    assert [r["chunk_id"] for r in fused] == ["c:0", "a:0", "d:0", "b:0"]
    assert fused[0]["score"] == pytest.approx(1 / 63 + 1 / 62)


def test_fusion_without_dense_hits_keeps_scores(spark):
    lexical_hits = ranking(spark, [("a:0", 9.0), ("b:0", 8.0)])
    fused = fuse(lexical_hits, ranking(spark, [("x:0", 1.0)]).limit(0), 4).orderBy("rank").collect()
    assert [(r["chunk_id"], r["score"]) for r in fused] == [("a:0", 9.0), ("b:0", 8.0)]


def test_spreading_over_documents(spark):
    terms = ["annual", "deep", "clean"]
    rows = [("q", i + 1, f"a:{i}", "a", i, 2.0, terms) for i in range(4)]
    rows.append(("q", 5, "b:0", "b", 0, 1.9, ["annual", "audit", "plan", "budget"]))
    frame = spark.createDataFrame(
        rows, "query_id string, rank int, chunk_id string, doc_id string, ordinal int, score double, terms array<string>"
    )
    picks = diversify(frame, 2, 0.6).orderBy("pick").collect()
    assert [p["chunk_id"] for p in picks] == ["a:0", "b:0"]
    everything = diversify(frame, 5, 0.6).orderBy("pick").collect()
    assert [p["chunk_id"] for p in everything] == [f"a:{i}" for i in range(4)] + ["b:0"]


def test_retrieval_over_files(spark, make_engine):
    engine = make_engine(CORPUS)
    cases = {
        "Where do visitors wait?": "dome.txt",
        "What closes the shutter at once?": "dome.txt",
        "Where does sourdough prove overnight?": "bakery.md",
        "When is the stone oven swept?": "bakery.md",
        "How are felt hammers needled?": "piano.txt",
    }
    asked = spark.createDataFrame(list(zip(cases, cases)), "query_id string, question string")
    got = {r["query_id"]: r["blocks"] for r in engine.index().retrieve(asked).collect()}
    assert {q: got[q][0]["filename"] for q in cases} == cases


def test_known_floors_spare_the_search_of_batches(monkeypatch):
    """What could fill a top is sought until every query has one; ties go to the greatest name."""
    import pandas as pd

    from passagelake.operators import dense

    rng = np.random.default_rng(8)
    vectors = rng.integers(-2, 3, (600, 3)).astype(float)  # with many ties
    names = [f"c{i:03}" for i in rng.permutation(600)]
    queries = rng.integers(-2, 3, (4, 3)).astype(float)
    ids = ["a", "b", "a", None]  # an id may come twice, or not at all
    batches = [
        pd.DataFrame({"chunk_id": names[k : k + 100], "doc_id": "d", "vector": list(vectors[k : k + 100])}) for k in range(0, 600, 100)
    ]
    sought, partition = [], np.partition
    monkeypatch.setattr(dense.np, "partition", lambda *a, **b: sought.append(1) or partition(*a, **b))
    found = pd.concat(dense._search(["a", "b", "c", "b"], queries, 12, set())(iter(batches)))
    assert len(sought) == 1
    for q, own in (("a", [0]), ("b", [1, 3]), ("c", [2])):
        want = sorted(((float(v @ queries[i]), n) for i in own for v, n in zip(vectors, names)), reverse=True)[:12]
        mine = found[found.query_id == q]
        assert sorted(zip(mine.score, mine.chunk_id), reverse=True) == want
    found = pd.concat(dense._search(ids, queries, 12, set())(iter(batches)))
    assert set(found.query_id) == {"a", "b"} and len(found) == 24
