from __future__ import annotations

from dataclasses import replace

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from conftest import CORPUS, PIANO, DOME, BAKERY, uploads
from passagelake.config import Settings
from passagelake.functions import lexicon as lx
from passagelake.plans.engine import Engine
from passagelake.streaming.events import ask_stream, server_sent
from passagelake.streaming.ingest import start_ingest
from test_sources import docx, pdf

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def status_of(outcomes):
    return {r["filename"]: (r["status"], r["error"]) for r in outcomes.collect()}


@pytest.fixture(scope="module")
def library(spark, small, tmp_path_factory):
    """An engine over every kind of file; tests that change it make their own."""
    engine = Engine(spark, str(tmp_path_factory.mktemp("library")), small)
    files = {
        **CORPUS,
        "visits.pdf": pdf([["Visitor badges are issued at the gate and returned daily."], ["Parking is on level two."]]),
        "pay.docx": docx(["Salaries are paid on the last working day of each month."], [["Grade", "Band"]]),
        "photo.png": b"\x89PNG", "blank.txt": b"", "spaces.txt": b"  \n ", "copy.txt": DOME,
        "../../etc/evil.txt": b"root:x:0:0 some words here for the index",
    }
    engine.outcomes = engine.ingest(uploads(spark, files))
    return engine


def test_each_file_has_its_own_outcome(library):
    got = status_of(library.outcomes)
    assert {n for n, (s, _) in got.items() if s == "indexed"} == {
        *CORPUS, "visits.pdf", "pay.docx", "evil.txt",
    }
    assert got["copy.txt"] == ("duplicate", None)
    assert got["photo.png"][0] == "rejected" and "Unsupported file type" in got["photo.png"][1]
    assert got["blank.txt"] == ("rejected", "The file is empty.")
    assert got["spaces.txt"] == ("failed", "The file is empty.")
    same = {r["filename"]: r["doc_id"] for r in library.outcomes.collect()}
    assert same["copy.txt"] == same["dome.txt"]


def test_documents_are_listed(library):
    listed = library.list_documents()
    assert "sha256" not in listed.columns and "stored_path" not in listed.columns
    rows = {r["filename"]: r for r in listed.collect()}
    assert list(rows) == sorted(rows)
    assert rows["visits.pdf"]["pages"] == 2 and rows["dome.txt"]["pages"] is None
    assert rows["spaces.txt"]["status"] == "failed" and rows["spaces.txt"]["n_chunks"] == 0
    dome = rows["dome.txt"]
    assert dome["n_words"] == len(DOME.split()) and dome["n_chunks"] == 1


def test_lookups(library, spark):
    doc = library.documents().where("filename = 'dome.txt'").first()
    assert library.get_document(doc["doc_id"]).count() == 1
    assert library.get_document("nothing").count() == 0
    assert library.has_document(doc["doc_id"]) and not library.has_document("nothing")
    assert library.find_by_sha256(doc["sha256"]).first()["doc_id"] == doc["doc_id"]
    chunk = f"{doc['doc_id']}:0"
    assert [r["chunk_id"] for r in library.get_chunks([chunk, "no:1"]).collect()] == [chunk]
    assert library.chunks_in_range(doc["doc_id"], 0, 5).count() == 1
    assert library.document_preview(doc["doc_id"]).first().asDict().keys() == {"ordinal", "page", "text"}
    original = library.download(doc["doc_id"]).first()
    assert original["filename"] == "dome.txt" and bytes(original["content"]) == DOME
    with pytest.raises(KeyError):
        library.download("nothing")
    failed = library.documents().where("status = 'failed'").first()
    assert not library.has_document(failed["doc_id"])


def test_stats(library):
    stats = library.stats()
    assert stats["documents"] == 6 and stats["chunks"] == 6
    assert stats["words"] == library.documents().agg(F.sum("n_words")).first()[0]
    assert stats["vocabulary"] == library.index().vocabulary.count()
    assert (stats["dense_retrieval"], stats["generation"], stats["model"]) == (False, "extractive", None)
    assert sum(1 for _ in library.iter_chunks()) == 6


def test_answers_carry_sources(library):
    result = library.ask("What does lightning nearby do to the shutter?")
    assert result["mode"] == "extractive"
    assert "[1]" in result["answer"] and "the mount is parked" in result["answer"]
    first = result["sources"][0]
    assert first["filename"] == "dome.txt" and first["cited"] and first["n"] == 1
    assert result["warning"] == lx.EXTRACTIVE_WARNING
    assert result["timing_ms"]["total"] >= 0


def test_pdf_sources_name_their_page(library):
    source = library.ask("Where are visitor badges issued?")["sources"][0]
    assert (source["filename"], source["page"]) == ("visits.pdf", 1)


def test_scope(library):
    bakery = library.documents().where("filename = 'bakery.md'").first()["doc_id"]
    result = library.ask("What must be reported to the supervisor each day?", doc_ids=[bakery])
    assert all(s["document_id"] == bakery for s in result["sources"])


def test_nothing_found(library):
    result = library.ask("How thick is the glacier above the fjord?")
    assert (result["mode"], result["sources"], result["answer"]) == ("no_match", [], lx.NO_MATCH_ANSWER)
    assert "warning" not in result


def test_empty_question(library):
    with pytest.raises(ValueError):
        library.ask("   ")


def test_many_questions_at_once(library, spark):
    rows = [("a", "Where does sourdough prove overnight?"), ("b", " "), ("c", "zebra quagga")]
    asked = spark.createDataFrame(rows, "query_id string, question string")
    got = {r["query_id"]: r for r in library.ask_many(asked).collect()}
    assert got["a"]["mode"] == "extractive" and got["a"]["sources"][0]["filename"] == "bakery.md"
    assert got["b"]["error"] == "Question must not be empty." and got["b"]["answer"] is None
    assert got["c"]["mode"] == "no_match"


def test_events(library):
    events = list(ask_stream(library, "When is the stone oven swept?"))
    assert [e["type"] for e in events] == ["sources", "delta", "done"]
    assert not any(s["cited"] for s in events[0]["sources"])
    assert any(s["cited"] for s in events[-1]["sources"])
    missing = list(ask_stream(library, "zebra quagga"))
    assert [e["type"] for e in missing] == ["sources", "delta", "done"]
    assert missing[-1].keys() == {"type", "mode", "timing_ms"}
    assert [e["type"] for e in ask_stream(library, " ")] == ["error"]
    framed = list(server_sent(iter(missing)))
    assert all(f.startswith("data: ") and f.endswith("\n\n") for f in framed)
    assert json.loads(framed[0][6:])["type"] == "sources"


def test_second_upload_is_known(spark, make_engine):
    # with hot_rows this low every repeated key takes the split path
    engine = make_engine({"dome.txt": DOME, "twin.txt": DOME}, settings=Settings(hot_rows=1))
    again = engine.ingest(uploads(spark, {"other.txt": DOME, "third.txt": DOME, "bakery.md": BAKERY})).collect()
    got = {r["filename"]: r for r in again}
    assert got["other.txt"]["duplicate"] and got["third.txt"]["duplicate"]
    assert len({r["doc_id"] for r in again}) == 2
    assert got["bakery.md"]["status"] == "indexed"
    assert engine.stats()["documents"] == 2


def test_same_bytes_under_two_kinds(spark, make_engine):
    """The PDF fails, so the text file with the same bytes is the original."""
    engine = make_engine()
    files = {"a.pdf": PIANO, "b.txt": PIANO, "c.md": PIANO, "d.pdf": PIANO}
    got = status_of(engine.ingest(uploads(spark, files)))
    assert [got[n][0] for n in files] == ["failed", "indexed", "duplicate", "duplicate"]
    assert engine.stats()["documents"] == 1


def test_deleting_and_adding_again(spark, make_engine):
    engine = make_engine(CORPUS)
    before = engine.stats()
    doc = engine.documents().where("filename = 'dome.txt'").first()["doc_id"]
    assert engine.delete_documents(["nothing"]) == 0
    assert engine.delete_documents([doc]) == 1
    assert engine.get_document(doc).count() == 0 and not engine.has_document(doc)
    assert engine.search("lightning shutter").count() == 0
    # the vocabulary shrinks, so no neighbour in spelling can lead back either
    assert engine.search("assistantts gallerys").count() == 0
    assert engine.delete_documents([doc]) == 0
    engine.ingest(uploads(spark, {"dome.txt": DOME}))
    assert engine.retrieve("lightning shutter").first()["filename"] == "dome.txt"
    assert engine.stats() == before


def test_a_deletion_hides_only_what_was_there_before(spark, make_engine):
    """Under the same id a document can go and come back, also across a compaction."""
    engine = make_engine()
    rows = [("same", "dome.txt", bytearray(DOME), 1)]
    upload = spark.createDataFrame(rows, "doc_id string, filename string, content binary, position int")
    engine.ingest(upload)
    before = engine.stats(), [r["score"] for r in engine.search("lightning shutter").collect()]
    for step in range(2):
        assert engine.delete_documents(["same"]) == 1 and engine.search("lightning shutter").count() == 0
        assert engine.ingest(upload).first()["status"] == "indexed"
        assert engine.get_document("same").count() == 1 and engine.document_preview("same").count() == 1
        assert (engine.stats(), [r["score"] for r in engine.search("lightning shutter").collect()]) == before
        if not step:
            engine.compact()
    assert bytes(engine.download("same").first()["content"]) == DOME


def test_other_bucket_settings_find_everything(spark, make_engine, small):
    """The layout belongs to the tables; compacting takes up a new one."""
    first = make_engine(CORPUS)
    doc = first.documents().where("filename = 'dome.txt'").first()["doc_id"]
    wide = Engine(spark, first.store.root, replace(small, term_buckets=16, doc_buckets=7))

    def seen(engine):
        return engine.retrieve("lightning shutter").count(), engine.document_preview(doc).count()

    assert seen(wide) == seen(first) and min(seen(wide)) > 0
    wide.ingest(uploads(spark, {"note.txt": b"The porter oils every shutter hinge in spring."}))
    assert seen(wide) == seen(first) and wide.search("porter hinge").count() == 1
    wide.compact()
    assert {r["term_buckets"] for r in wide.store.commits()} == {16}
    assert seen(wide) == seen(first) and min(seen(first)) > 0


def test_one_bad_text_costs_no_other_its_vector(spark):
    from passagelake.operators.dense import encode

    def picky(texts):
        if "bad" in texts:
            raise RuntimeError("cannot read this")
        return [[float(len(t)), 1.0] for t in texts]

    rows = spark.createDataFrame([(i, "bad" if i == 5 else f"text {i}") for i in range(21)], "k int, t string").coalesce(1)
    assert sorted(r["k"] for r in encode(rows, ["k"], "t", picky).collect()) == [i for i in range(21) if i != 5]


def test_pieces_equal_the_whole(spark, make_engine):
    """Ingest in steps, delete, compact: scores are those of a fresh index."""
    extra = {"gone.txt": b"Lightning once struck a stool in the gallery, says the oldest page."}
    steps = make_engine({"dome.txt": DOME}, name="steps")
    steps.ingest(uploads(spark, {**extra, "bakery.md": BAKERY}))
    steps.ingest(uploads(spark, {"piano.txt": PIANO}))
    steps.delete_documents([steps.documents().where("filename = 'gone.txt'").first()["doc_id"]])
    whole = make_engine(CORPUS, name="whole")

    def scores(engine):
        names = engine.documents().select("doc_id", "filename")
        found = engine.search("Does lightning reach the stool in the galery?")
        return {(r["filename"], r["ordinal"]): round(r["score"], 8) for r in found.join(names, "doc_id").collect()}

    expected = scores(whole)
    assert expected and scores(steps) == expected
    steps.compact()
    assert scores(steps) == expected and steps.stats() == whole.stats()
    assert steps.store.read("grams", steps.store.snapshot()).count() > 0


def test_replaying_a_segment(spark, make_engine):
    engine = make_engine()
    first = engine.ingest(uploads(spark, CORPUS), segment="batch-1").collect()
    again = engine.ingest(uploads(spark, CORPUS), segment="batch-1").collect()
    assert sorted(map(str, first)) == sorted(map(str, again))
    assert engine.stats()["documents"] == 3


def test_an_uncommitted_segment_does_not_count(spark, make_engine):
    engine = make_engine({"dome.txt": DOME})
    before = engine.stats()
    commit = engine.store.commit
    engine.store.commit = lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        engine.ingest(uploads(spark, {"bakery.md": BAKERY}), segment="s2")
    engine.store.commit = commit
    assert engine.stats() == before and engine.search("sourdough overnight").count() == 0
    engine.ingest(uploads(spark, {"bakery.md": BAKERY}), segment="s2")
    assert engine.stats()["documents"] == 2 and engine.search("sourdough overnight").count() == 1


def test_restart(spark, small, library):
    again = Engine(spark, library.store.root, small)
    assert again.stats() == library.stats()
    assert again.retrieve("lightning closes shutter").first()["filename"] == "dome.txt"


def test_widened_context_repeats_nothing(spark, make_engine):
    sentences = [f"Rule {i} says that locker {i} belongs to person number {i} of the team." for i in range(60)]
    engine = make_engine({"rules.txt": " ".join(sentences).encode()})
    block = engine.retrieve("locker person number team rule").first()
    found = [s for s in block["text"].split(". ") if len(s) > 40]
    assert len(found) == len(set(found)) > 10
    assert len(block["chunk_ids"]) >= 2


def letters(texts):
    """A stand-in encoder: letter counts, normalised."""
    out = []
    for text in texts:
        counts = [text.lower().count(c) + 0.0 for c in "abcdefghijklmnopqrstuvwxyz"]
        norm = sum(c * c for c in counts) ** 0.5 or 1.0
        out.append([c / norm for c in counts])
    return out


def broken(*_):
    raise RuntimeError("no")


def test_encoder(spark, make_engine):
    engine = make_engine(CORPUS, encoder=letters)
    assert engine.stats()["dense_retrieval"]
    # no word in common, yet the dense ranking still offers passages
    hits = engine.search("quokka marsupials").collect()
    assert len(hits) == 3 and hits[0]["score"] == pytest.approx(1 / 61)
    assert engine.search("of the").count() == 0
    engine.delete_documents([hits[0]["doc_id"]])
    assert engine.search("quokka marsupials").count() == 2
    plain = make_engine(CORPUS, name="plain", encoder=broken)
    assert not plain.stats()["dense_retrieval"] and plain.search("lightning").count() == 1
    assert plain.ask("What does lightning close?")["mode"] == "extractive"


def test_questions_outlive_a_failing_encoder(spark, make_engine, small):
    """With vectors in the tables and an encoder that fails, ranking is lexical."""
    engine = make_engine(CORPUS, encoder=letters)
    failing = Engine(spark, engine.store.root, small, encoder=broken)
    plain = Engine(spark, engine.store.root, small)
    found = failing.search("lightning shutter").collect()
    assert found and [(r["chunk_id"], r["score"]) for r in found] == [
        (r["chunk_id"], r["score"]) for r in plain.search("lightning shutter").collect()
    ]
    assert failing.ask("What does lightning close?")["sources"][0]["filename"] == "dome.txt"


def test_generator_and_condenser(spark, make_engine):
    engine = make_engine(
        CORPUS,
        generator=lambda messages: f"{len(messages)} {messages[-1]['content'][:9]} [1] [7]",
        condenser=lambda question, turns: "Where does sourdough prove overnight?",
        model="stand-in",
    )
    history = [{"role": "assistant", "content": "Hi"}, {"role": "user", "content": "sourdough"}]
    result = engine.ask("And how often?", history=history)
    assert result["answer"] == "2 Excerpts: [1] [7]"
    assert (result["mode"], result["model"]) == ("generated", "stand-in")
    assert result["query_used"] == "Where does sourdough prove overnight?"
    assert result["sources"][0]["cited"]
    engine.generator = lambda messages: " "
    assert engine.ask("sourdough")["mode"] == "extractive"
    engine.condenser = broken
    assert engine.ask("sourdough overnight", history=history)["query_used"] == "sourdough overnight"
    engine.generator = broken
    with pytest.raises(RuntimeError, match="Answer generation failed"):
        engine.ask("sourdough")


def test_requests_over_the_limits_are_refused(library, spark):
    long = "sourdough " * 300
    for refused in (
        lambda: library.ask(long), lambda: library.ask("sourdough", top_k=21), lambda: library.ask("sourdough", top_k=0),
        lambda: library.ask("sourdough", history=[{"role": "user", "content": "x" * 8_001}]),
    ):
        with pytest.raises(ValueError):
            refused()
    rows = [("a", long, []), ("b", "sourdough overnight", [("user", "y" * 8_001)]), ("c", "sourdough overnight", [])]
    asked = spark.createDataFrame(rows, "query_id string, question string, history array<struct<role:string,content:string>>")
    got = {r["query_id"]: (r["error"], r["answer"]) for r in library.ask_many(asked).collect()}
    assert got["a"] == (lx.TOO_LONG_QUESTION, None) and got["b"] == (lx.TOO_LONG_TURN, None) and got["c"][0] is None
    assert [e["type"] for e in ask_stream(library, long)] == ["error"]


def test_pieces_are_passed_on_as_they_come(spark, library, small):
    made = []

    def slow(messages):
        for piece in ("Willow ", "baskets [1]."):
            made.append(piece)
            yield piece

    engine = Engine(spark, library.store.root, small, generator=slow, model="m")
    events = ask_stream(engine, "Where does sourdough prove overnight?")
    assert next(events)["type"] == "sources" and not made
    assert next(events) == {"type": "delta", "text": "Willow "} and made == ["Willow "]
    assert next(events)["text"] == "baskets [1]."
    done = next(events)
    assert done["mode"] == "generated" and done["sources"][0]["cited"] and set(done["timing_ms"]) == {"retrieval", "generation", "total"}


def test_vacuum_removes_what_was_replaced(spark, make_engine, tmp_path):
    engine = make_engine({"dome.txt": DOME})
    engine.ingest(uploads(spark, {"bakery.md": BAKERY}))
    engine.delete_documents([engine.documents().where("filename = 'dome.txt'").first()["doc_id"]])
    engine.compact()
    before = engine.stats()
    assert len(engine.vacuum()) == 3 and engine.stats() == before
    assert engine.search("sourdough overnight").count() == 1 and len(engine.store.commits()) == 1
    left = [p for p in (tmp_path / "index" / "files").rglob("*.parquet")]
    assert left and spark.read.parquet(str(tmp_path / "index" / "files")).count() == 1
    assert engine.vacuum() == [] or len(engine.vacuum()) == 3


def test_folder_and_stream(spark, make_engine, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "dome.txt").write_bytes(DOME)
    (inbox / "virus.exe").write_bytes(b"MZ")
    engine = make_engine()

    def run():
        query = start_ingest(engine, str(inbox), str(tmp_path / "progress"), "inbox")
        query.awaitTermination(120)
        assert query.exception() is None

    run()
    assert engine.stats()["documents"] == 1
    (inbox / "copy.txt").write_bytes(DOME)
    (inbox / "bakery.md").write_bytes(BAKERY)
    run()
    assert engine.stats()["documents"] == 2
    doc = engine.documents().where("filename = 'bakery.md'").first()
    assert bytes(engine.download(doc["doc_id"]).first()["content"]) == BAKERY
    (inbox / "huge.md").write_bytes(b"x" * ((1 << 20) + 1))
    other = make_engine(name="other", settings=Settings(max_upload_mb=1, hot_rows=1))
    got = status_of(other.ingest_folder(str(inbox)))
    assert {n: s for n, (s, _) in got.items()} == {
        "copy.txt": "indexed", "dome.txt": "duplicate", "bakery.md": "indexed", "huge.md": "rejected",
    }
    assert got["huge.md"][1] == "File is 1.0 MB; the limit is 1 MB."


def test_an_engine_without_documents(spark, make_engine):
    engine = make_engine()
    assert engine.ask("anything at all")["mode"] == "no_match"
    got = status_of(engine.ingest(uploads(spark, {"photo.png": b"\x89PNG", "spaces.md": b" \n"})))
    assert [got[n][0] for n in ("photo.png", "spaces.md")] == ["rejected", "failed"]
    assert engine.ask("anything at all")["mode"] == "no_match"
    assert engine.stats()["documents"] == engine.stats()["vocabulary"] == 0
    engine.ingest(uploads(spark, {"dome.txt": DOME}))
    assert engine.ask("lightning shutter")["sources"][0]["filename"] == "dome.txt"
