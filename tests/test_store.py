"""The commit log, deletions as bitmaps, merging by size, and exact skipping of blocks."""

from __future__ import annotations

import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import BAKERY, CORPUS, DOME, PIANO, uploads
from passagelake.operators import blockmax
from passagelake.plans import log as L
from passagelake.plans import store as S
from passagelake.plans.engine import Engine
from passagelake.plans.log import CommitLog, Conflict


def entry(name, **more):
    return {"segment": name, "kind": "ingest", **more}


def commit(name, supersedes=()):
    return {"entries": [entry(name)], "supersedes": list(supersedes)}


def test_two_writers_never_share_a_number(spark, tmp_path):
    """Forty commits by four writers at once: each is there, in one order for all."""
    folder, failed = str(tmp_path / "log"), []

    def write(k):
        try:
            own = CommitLog(spark, folder)
            for i in range(10):
                own.append(commit(f"w{k}-{i}"), own.state())
        except Exception as problem:
            failed.append(problem)

    writers = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert not failed
    state = CommitLog(spark, folder).state()
    assert state.number == 40 and set(state.entries) == {f"w{k}-{i}" for k in range(4) for i in range(10)}
    assert not list((tmp_path / "log").glob(".*.tmp"))


def test_a_reader_needs_the_last_checkpoint_only(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "log")
    own = CommitLog(spark, folder)
    for i in range(3 * L.EVERY + 2):
        own.append(commit(f"s{i}", [f"s{i - 1}"] if i % 5 == 4 else []), own.state())
    read = []
    fresh = CommitLog(spark, folder)
    plain = CommitLog._read
    monkeypatch.setattr(CommitLog, "_read", lambda self, name: (read.append(name), plain(self, name))[1])
    assert fresh.state().entries == own.state().entries and fresh.state().replaced == own.state().replaced
    # pointer, checkpoint, the commits behind it, and one that is not there
    assert len(read) <= 2 * (L.EVERY + 3)
    # without checkpoints the history says the same
    for path in (tmp_path / "log").glob("*checkpoint*"):
        path.unlink()
    assert CommitLog(spark, folder).state().entries == own.state().entries


def test_an_ingest_during_a_deletion_stays(spark, make_engine):
    """A deletion names rows; what is committed while it runs is not hidden by it."""
    engine = make_engine({"dome.txt": DOME, "bakery.md": BAKERY})
    other = Engine(spark, engine.store.root, engine.settings)
    doc = engine.documents().where("filename = 'dome.txt'").first()["doc_id"]
    plain = engine.store.commit_deletion

    def late(entries, base):
        other.ingest(uploads(spark, {"piano.txt": PIANO}))
        engine.store.commit_deletion = plain
        return plain(entries, base)

    engine.store.commit_deletion = late
    assert engine.delete_documents([doc]) == 1
    assert {r["filename"] for r in engine.documents().collect()} == {"bakery.md", "piano.txt"}
    assert engine.search("felt hammers").count() == 1 and engine.search("lightning shutter").count() == 0
    # added again under the same id
    again = uploads(spark, {"dome.txt": DOME}).withColumn("doc_id", F.lit(doc))
    engine.ingest(again)
    assert engine.search("lightning shutter").count() == 1 and engine.document_chunks(doc).count() == 1
    engine.compact()
    assert engine.search("lightning shutter").count() == 1 and engine.stats()["documents"] == 3


def test_a_compaction_of_changed_segments_is_refused(spark, make_engine):
    engine = make_engine({"dome.txt": DOME, "bakery.md": BAKERY})
    other = Engine(spark, engine.store.root, engine.settings)
    doc = engine.documents().where("filename = 'dome.txt'").first()["doc_id"]
    plain = engine.store.commit

    def late(*a, **k):
        other.delete_documents([doc])
        return plain(*a, **k)

    engine.store.commit = late
    with pytest.raises(Conflict):
        engine.compact()
    engine.store.commit = plain
    assert engine.search("lightning shutter").count() == 0
    engine.compact()
    assert engine.search("lightning shutter").count() == 0 and engine.stats()["documents"] == 1


def test_two_first_ingests_keep_one_order_of_grams(spark, make_engine):
    engine = make_engine()
    other = Engine(spark, engine.store.root, engine.settings)
    plain = engine.store.commit

    def late(*a, **k):
        engine.store.commit = plain
        other.ingest(uploads(spark, {"bakery.md": BAKERY}))
        return plain(*a, **k)

    engine.store.commit = late
    engine.ingest(uploads(spark, {"dome.txt": DOME}))
    orders = [e for e in engine.store.commits() if e["rows"].get("gram_order")]
    assert len(orders) == 1 and len(engine.store.commits()) == 2
    assert engine.search("lightnin").count() == 1 and engine.search("sourdouhg").count() == 1


def test_merging_small_segments_leaves_a_large_one(spark, make_engine):
    many = " ".join(f"Locker {i} belongs to person {i} of the long team list." for i in range(700))
    engine = make_engine({"large.txt": many.encode()})
    large = engine.store.commits()[0]["segment"]
    for i in range(4):
        engine.ingest(uploads(spark, {f"n{i}.txt": f"Porter number{i} oils hinge number{i}.".encode()}))
    engine.delete_documents([engine.documents().where("filename = 'n3.txt'").first()["doc_id"]])
    before = {(r["doc_id"], round(r["score"], 8)) for r in engine.search("porter oils").collect()}
    stats = engine.stats()
    assert [len(g) for g in engine.merge(fanout=4)] == [4]
    left = {e["segment"]: e["rows"]["documents"] for e in engine.store.commits()}
    assert len(left) == 2 and left.pop(large) == 1 and list(left.values()) == [3]
    assert {(r["doc_id"], round(r["score"], 8)) for r in engine.search("porter oils").collect()} == before and len(before) == 3
    assert engine.stats() == stats and engine.merge(fanout=4) == []
    assert engine.search("locker porter").count() > 0


def test_large_deletions_lie_in_a_table(spark, make_engine, monkeypatch):
    monkeypatch.setattr("passagelake.plans.engine.INLINE_WORDS", 0)
    engine = make_engine({**CORPUS, "spaces.txt": b" \n "})
    gone = [r["doc_id"] for r in engine.documents().where("filename in ('dome.txt', 'spaces.txt')").collect()]
    assert engine.delete_documents(gone) == 2 and engine.store.snapshot().gone_in
    assert engine.search("lightning shutter").count() == 0 and engine.documents().count() == 2
    assert engine.index().postings.where("term = 'lightn' or term = 'lightning'").count() == 0
    fine = engine.index().gone
    assert sum(bin(b & (2**64 - 1)).count("1") for words in fine.values() for _, b in words) == 2


def test_blocks_are_passed_over_without_loss(spark, make_engine):
    """Against plain sums over all postings, for limits that let windows be skipped."""
    import pyarrow as pa

    rng = random.Random(4)
    rows, plain = [], {}
    for window in range(blockmax.WINDOWS):
        for term, low in (("a", 1), ("b", 0), ("c", 5)):
            found = []
            # one window is worth far more than the others
            for k in range(9 if window == 3 else rng.randrange(low, 12)):
                doc, ordinal = f"d{window}-{k % 3}", k
                tf, length = (rng.randrange(5, 12), 10) if window == 3 else (rng.randrange(1, 4), 2000 + 10 * window)
                found.append({"doc_id": doc, "ordinal": ordinal, "number": 64 * window + k % 3, "tf": tf, "length": length})
                plain.setdefault((doc, ordinal), {})[term] = (tf, length)
            if found:
                rows.append((term, window, max(f["tf"] for f in found), min(f["length"] for f in found), found))
    kind = pa.list_(pa.struct([("doc_id", pa.string()), ("ordinal", pa.int32()), ("number", pa.int64()), ("tf", pa.int32()), ("length", pa.int32())]))
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()),
            pa.array([r[3] for r in rows], pa.int32()), pa.array([r[4] for r in rows], kind),
        ],
        ["term", "window", "max_tf", "min_length", "entries"],
    )
    weights = [
        {"query_id": q, "pos": p, "term": t, "weight_idf": w, "n_groups": n}
        for q, n in (("long", 3), ("short", 2)) for p, (t, w) in enumerate([("a", 1.5), ("b", 0.7), ("c", 0.1)])
    ]
    scope = [{"query_id": "short", "doc_id": f"d{w}-{k}"} for w in range(0, 16, 2) for k in (0, 1)]
    gone = [(3, 0b010), (7, 0b101)]
    hidden = {"d3-1", "d7-0", "d7-2"}
    question = blockmax.asked(weights, scope)
    for limit in (1, 3, 10, 1000):
        bucket = blockmax.Bucket([batch], question, 120.0, gone)
        got = bucket.hits(limit).to_pylist()
        assert limit > 3 or bucket.passed_over > 0
        for q, n in (("long", 3), ("short", 2)):
            want = []
            for (doc, ordinal), terms in plain.items():
                if doc in hidden or (q == "short" and {"query_id": q, "doc_id": doc} not in scope):
                    continue
                if n > 2 and len(terms) < 2:
                    continue
                score = sum(
                    w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / 120.0))
                    for t, w in (("a", 1.5), ("b", 0.7), ("c", 0.1)) if t in terms for tf, length in [terms[t]]
                )
                want.append((-np.floor(score * 1e9 + 0.5) / 1e9, doc, ordinal))
            mine = [(-r["score"], r["doc_id"], r["ordinal"]) for r in got if r["query_id"] == q]
            assert mine == [(pytest.approx(s), d, o) for s, d, o in sorted(want)[:limit]]


def test_both_ways_of_scoring_agree(spark, make_engine, small):
    from dataclasses import replace

    engine = make_engine(CORPUS)
    engine.delete_documents([engine.documents().where("filename = 'piano.txt'").first()["doc_id"]])
    doc = engine.documents().where("filename = 'dome.txt'").first()["doc_id"]
    asked = spark.createDataFrame(
        [("a", "the shutter and the oven"), ("b", "humidity mirror"), ("c", "felt hammers")], "query_id string, question string"
    )
    scope = spark.createDataFrame([("a", doc)], "query_id string, doc_id string")
    index = engine.index()
    shuffled = replace(index, settings=replace(index.settings, broadcast_rows=0))
    found = [sorted(map(tuple, i.lexical(asked, 5, scope).collect())) for i in (index, shuffled)]
    assert found[0] == found[1] and {r[0] for r in found[0]} == {"a", "b"}


def test_sets_of_documents_are_not_spread_over_questions(spark, make_engine, monkeypatch):
    """Scopes with more pairs than may be sent are scored where the postings lie all the same."""
    from dataclasses import replace

    from passagelake.operators import lexical
    from passagelake.operators.scope import Scope

    engine = make_engine(CORPUS)
    engine.ingest(uploads(spark, {"second.txt": b"A shutter of the second house. Felt hammers in the oven."}))
    docs = {r["filename"]: r["doc_id"] for r in engine.documents().collect()}
    engine.delete_documents([docs["piano.txt"]])
    texts = ("the shutter and the oven", "felt hammers", "humidity mirror", "oven")
    asked = spark.createDataFrame([(f"{t}{k}", x) for t, x in enumerate(texts) for k in range(12)], "query_id string, question string")
    names = [("0", "west"), ("1", "east"), ("1", "west"), ("3", "nowhere")]
    asked_sets = spark.createDataFrame([(f"{t}{k}", s) for t, s in names for k in range(12)] * 2, "query_id string, scope string")
    members = [("west", "dome.txt"), ("west", "second.txt"), ("east", "second.txt"), ("east", "piano.txt"), ("other", "bakery.md")]
    held = spark.createDataFrame([(s, docs[f]) for s, f in members] + [("west", None)], "scope string, doc_id string")
    scope = Scope(asked_sets, held)
    index = engine.index()
    plain = replace(index, settings=replace(index.settings, broadcast_rows=0))
    found = sorted(map(tuple, index.lexical(asked, 5, scope).collect()))
    allowed = {(r[0], r[1]) for r in scope.pairs().collect()}
    assert all(r[0][0] == "2" or (r[0], r[2]) in allowed for r in found)
    assert {r[0][0] for r in found} == {"0", "1", "2"} and len({r[0] for r in found}) == 36
    assert found == sorted(map(tuple, plain.lexical(asked, 5, scope).collect()))
    # pairs beyond the limit, weights within it
    limited = replace(index, settings=replace(index.settings, broadcast_rows=180))
    assert limited.weights(asked).count() < 180
    monkeypatch.setattr(lexical, "bm25_scores", lambda *_: pytest.fail("the postings were joined"))
    more = scope.pairs().unionByName(spark.range(400).selectExpr("'00' as query_id", "concat('none-', id) as doc_id"))
    assert sorted(map(tuple, limited.lexical(asked, 5, more).collect())) == found


def test_a_file_of_several_row_groups_is_refused(spark, make_engine, monkeypatch):
    engine = make_engine(CORPUS)
    monkeypatch.setattr(blockmax, "ONE_GROUP", 10)
    with pytest.raises(Exception, match="several row groups"):
        engine.search("lightning shutter").collect()


def test_rows_of_tables_are_known_from_the_log(spark, make_engine):
    engine = make_engine(CORPUS)
    snapshot = engine.store.snapshot()
    for name in ("documents", "chunks", "postings", "vocabulary", "grams", "files"):
        assert snapshot.rows(name) == engine.store._load(name).count()
    assert snapshot.rows("vectors") == 0 and S.SCHEMAS.keys() >= {"postings"}


def test_questions_reach_the_driver_as_columns(spark, small, monkeypatch):
    """Weights and scopes of written tables, without an object a row."""
    from pyspark.sql import DataFrame

    weights = spark.range(0, 20_000, 1, 3).select(
        F.concat(F.lit("q"), (F.col("id") % 500).cast("string")).alias("query_id"), (F.col("id") % 40).cast("int").alias("pos"),
        F.concat(F.lit("t"), (F.col("id") % 700).cast("string")).alias("term"), (F.col("id") / 7).alias("weight_idf"),
        (F.col("id") % 500 % 5).alias("n_groups"),
    )
    scope = spark.createDataFrame([("q3", "b"), ("q3", "a"), ("q9", "a"), ("nobody", "c"), ("q3", "b"), ("q9", None)], "query_id string, doc_id string")
    rows, limits = weights.collect(), scope.collect()
    monkeypatch.setattr(DataFrame, "collect", lambda self: pytest.fail("rows were collected"))
    found = blockmax.asked(weights, scope)
    plain = sorted(rows, key=lambda r: (r["term"], r["query_id"], r["pos"]))
    assert found.query_ids == sorted({r["query_id"] for r in rows})
    assert [found.query_ids[q] for q in found.query] == [r["query_id"] for r in plain]
    assert found.pos.tolist() == [r["pos"] for r in plain] and found.weight.tolist() == [r["weight_idf"] for r in plain]
    assert all({plain[k]["term"] for k in range(*span)} == {t} for t, span in found.first_of.items())
    assert sum(high - low for low, high in found.first_of.values()) == len(plain)
    assert {found.query_ids[q] for q in np.flatnonzero(found.short)} == {r["query_id"] for r in rows if r["n_groups"] <= 2}
    named = {found.query_ids[q]: {found.scope_docs[d] for d in docs} for q, docs in found.allowed.items()}
    assert named == {q: {r["doc_id"] for r in limits if r["query_id"] == q} for q in ("q3", "q9")}
    empty = blockmax.asked(weights.limit(0), None)
    assert empty.query_ids == [] and empty.first_of == {} and len(empty.weight) == 0


def test_postings_of_larger_segments_lie_in_pieces(spark, make_engine, monkeypatch):
    """More pieces than windows are dealt to, each with whole chunks, and the same answers."""
    texts = {f"{i}.txt": f"lightning shutter number{i % 7} harp{i} visitors. ".encode() * (1 + i % 3) for i in range(40)}
    plain, dealt = make_engine(texts, "plain"), None
    monkeypatch.setattr(blockmax, "PIECE_CHUNKS", 2)
    dealt = make_engine(texts, "dealt")
    assert blockmax.pieces_for(40, 3) == 8 and blockmax.pieces_for(0, 3) == 1
    where = dealt.index().blocks.select("doc_bucket", F.input_file_name().alias("file"), F.inline("entries"))
    files = where.groupBy("doc_bucket").agg(F.count_distinct("file").alias("n")).collect()
    assert max(r["n"] for r in files) > blockmax.WINDOW_PIECES
    chunks = where.groupBy("doc_id", "ordinal").agg(F.count_distinct("file").alias("n"))
    assert chunks.where("n > 1").isEmpty() and chunks.count() == 40
    found = []
    for engine in (plain, dealt):
        rows = engine.search("lightning harp3 number5", 12).join(engine.documents().select("doc_id", "filename"), "doc_id")
        found.append(sorted((r["rank"], round(r["score"], 9)) for r in rows.collect()))
    assert found[0] == found[1] and len(found[0]) == 12
    dealt.compact()
    again = dealt.search("lightning harp3 number5", 12).collect()
    assert sorted((r["rank"], round(r["score"], 9)) for r in again) == found[0]


def test_grams_are_written_without_what_follows_from_them(spark, make_engine):
    assert make_engine(CORPUS).store._load("grams").columns == ["gram", "term", "n_grams", "grams", "signature", "segment", "gram_bucket"]


def test_postings_are_grouped_where_they_were_dealt(spark):
    """One exchange and no aggregate; the same blocks as by plain loops, whichever way batches are cut."""
    rng = random.Random(7)
    rows = []
    for k in range(300):
        terms = sorted(rng.sample(["a", "b", "é", "z’s", *map(str, range(60))], rng.randrange(0, 9)))
        counts = [(t, rng.randrange(1, 5)) for t in terms]
        rows.append((k % 3, f"d{k % 70}", k, k // 70, sum(n for _, n in counts), counts))
    schema = "doc_bucket int, doc_id string, number long, ordinal int, length int, counts array<struct<term:string,tf:int>>"
    chunks = spark.createDataFrame(rows, schema)
    placed = chunks.select("number", blockmax.piece_of(4).alias("piece"), blockmax.window_of().alias("window"))
    where = {r["number"]: (r["piece"], r["window"]) for r in placed.collect()}
    want: dict = {}
    for bucket, doc, number, ordinal, length, counts in rows:
        for term, tf in counts:
            want.setdefault((bucket, where[number][0], term, where[number][1]), []).append((doc, ordinal, number, tf, length))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = blockmax.blocks(chunks, 3, 4)
        got = found.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    mine = {(r["doc_bucket"], r["piece"], r["term"], r["window"]): r for r in got}
    assert len(mine) == len(got) and mine.keys() == want.keys()
    for key, entries in want.items():
        r = mine[key]
        assert [tuple(e) for e in r["entries"]] == sorted(entries) and r["n"] == len(entries)
        assert r["max_tf"] == max(e[3] for e in entries) and r["min_length"] == min(e[4] for e in entries)
    plan = blockmax.blocks(chunks, 3, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Exchange") == 1
    assert blockmax.blocks(chunks.limit(0), 3, 1).isEmpty()


def test_words_are_counted_as_the_text_functions_do(spark):
    from passagelake.functions import text as T
    from passagelake.operators import postings as P

    texts = [
        None, "", "the of and", "The İstanbul ﬁnal’s ΣΑΣ stopped stop's dogs’ édly running classes 50's ß ŉ ½ cries died",
        "addressed passes glasses ties tied sing being wedly boldly boxes cats a1 it's 'quoted' x’y’z", DOME.decode(), "Ünïcödé naïve résumés",
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    plain = rows.select("*", T.tokens(F.col("text")).alias("t")).select("i", "text", F.size("t").alias("length"), T.term_counts(F.col("t")).alias("counts"))
    found = P.analysed(rows)
    assert found.columns == plain.columns and found.dtypes == plain.dtypes
    assert found.orderBy("i").collect() == plain.orderBy("i").collect()


def test_grams_are_ordered_within_their_row(spark):
    """No exchange; rarest grams first, unknown ones before all, equal ones by name."""
    from passagelake.operators import postings as P

    words = ["dome", "domes", "home", "a", "", "zzz", "é’s", "banana"]
    terms = spark.createDataFrame([(w,) for w in words], "term string")
    order = P.gram_order(terms.where("term not in ('zzz', 'banana')"))
    holders = {r["gram"]: r["holders"] for r in order.collect()}
    found = P.gram_prefixes(terms, order)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    for r in found.collect():
        padded = f"${r['term']}$"
        grams = {padded[i : i + 3] for i in range(max(1, len(padded) - 2))}
        assert r["grams"] == sorted(grams, key=lambda g: (holders.get(g, 0), g)) and r["n_grams"] == len(grams)
        assert r["prefix"] == r["grams"][: len(r["prefix"])] and bin(r["signature"] & (2**64 - 1)).count("1") <= len(grams)
    bits = spark.createDataFrame([(g,) for g in ("$do", "dom", "ome", "me$")], "g string").selectExpr("shiftleft(1L, cast(pmod(xxhash64(g), 64) as int)) as b")
    assert found.where("term = 'dome'").first()["signature"] == bits.selectExpr("bit_or(b)").first()[0]
