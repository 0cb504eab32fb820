"""Token records, packing, chat formatting and archives: exact round trips."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from passagelake.llm import chat, packing, records, warc  # noqa: E402
from passagelake.llm.tokens import PieceEncoder, space_led, spaced  # noqa: E402

BYTES, WORDS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = [
    "", " ", "  a  b ", "it's 'tis\n\n x\ty  z\u0085q \x1cfoo\x1d bar", "<|endoftext|> <|startoftext|>x", "d \u0301e ΣΑΣ Σ",
    "日本 語 🙂 x", "\n\n\nfoo \n bar\r\n baz ", "x" * 5_000, "a\x00b", "İstanbul ǅ", "a\u180e b\u200b c\u3000d", "end. of, line.\nNext.",
    "word.\n", "\nword", "a. b, c.", "1. 2, é. ñ,", " lead", "trail ",
]


def whole(path, text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("path", "cut"), [(BYTES, space_led), (WORDS, spaced)])
def test_pieces_give_the_ids_of_the_whole_text(path, cut, monkeypatch):
    encoder = PieceEncoder(path, cut)
    for _ in range(3):  # the second and third time from the dictionary, and from its older generation
        flat, bounds = encoder.encode(ODD)
        assert [list(flat[bounds[i] : bounds[i + 1]]) for i in range(len(ODD))] == [whole(path, t) for t in ODD]
        monkeypatch.setattr("passagelake.llm.tokens.KEPT_PIECES", 0)


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, part string, ids string")


ROWS = [(i, t, "own", "own") for i, t in enumerate(ODD)] + [(3, "again", "x", "y")] * 2 + [(None, "no id", "x", "y"), (99, None, "x", "y")]


def test_records_round_trip(spark, tmp_path):
    folder = str(tmp_path / "records")
    files = records.write_records(docs_of(spark, ROWS), folder, WORDS)
    got = [(r["doc_id"], r["start"], bytes(r["ids"])) for r in records.read_records(spark, folder, files).orderBy("start").collect()]
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    assert sorted(str(r[0]) for r in got) == sorted(str(r[0]) for r in order) and [r[0] for r in got] == [r[0] for r in order]
    start, ids = 0, {}
    for own, at, data in got:
        assert at == start
        start += len(data) // 4
        ids.setdefault(own, []).append(list(np.frombuffer(data, "<u4")))
    for own, text, *_ in ROWS:
        assert [*whole(WORDS, text or ""), 1] in ids[own]
    first = files.orderBy("part").first()
    picked = records.read_selected(folder, first["part"], [first["n_records"] - 1, 0])
    assert picked[1][0] is None and list(picked[1][1]) == [*whole(WORDS, "no id"), 1]
    assert records.write_records(docs_of(spark, []), str(tmp_path / "none"), WORDS).count() == 0


def test_damage_is_noticed():
    good = records.frame(b"abc")
    assert records.unframe(good) == (b"abc", len(good))
    for at in range(len(good)):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(bad))


def test_hilbert_order_goes_from_neighbour_to_neighbour():
    for n, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n), -1).reshape(-1, n)
        keys = packing.hilbert_key(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0))
        assert (steps.sum(axis=1) == 1).all()


def test_packing_keeps_every_id(spark):
    pieces = packing.pack(docs_of(spark, ROWS), BYTES, length=64)
    rows = pieces.collect()
    by_sequence, by_document = {}, {}
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), "<u4")
        assert len(ids) == r["length"] > 0
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_document.setdefault(r["doc_id"], []).append((r["start"], list(ids)))
    last = max(by_sequence)
    for k, parts in by_sequence.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 64 or k == last
    for own in {r[0] for r in ROWS}:
        texts = [t or "" for i, t, *_ in ROWS if i == own]
        parts = sum((p for _, p in sorted(by_document[own])), [])
        assert sorted(parts) == sorted(x for t in texts for x in [*whole(BYTES, t), 0])
        if len(texts) == 1:
            assert parts == [*whole(BYTES, texts[0]), 0]
    joined = {r["sequence_id"]: (r["n_ids"], len(bytes(r["ids"]))) for r in packing.sequences(pieces).collect()}
    assert all(n * 4 == size for n, size in joined.values()) and len(joined) == last + 1
    assert packing.pack(docs_of(spark, []), BYTES).count() == 0


TALK = [
    (1, 0, "user", "\\### Assistant: </turn> ok"), (1, 1, "assistant", "#### x </turn></turn>\\"), (1, None, "system", None),
    (2, 0, None, "### "), (2, 1, "assistant", ""), (2, 1, "assistant", "b"), (2, 1, "assistant", "b"), (None, 3, "we: ird:", "é🙂"),
    (3, 0, "assistant", "y" * 30_000 + "<|endoftext|>"),
]


def test_chat_reads_back_what_was_said(spark):
    rows = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string")
    turns = chat.written_turns(rows, BYTES)
    got = {r["conv_id"]: r for r in chat.read_digests(turns, BYTES).collect()}
    assert set(got) == {1, 2, 3, None}
    for own, r in got.items():
        said = sorted(
            ((t is not None, t or 0, role or "", text or "") for c, t, role, text in TALK if c == own)
        )
        learned = "".join(x[3] for x in said if x[2] == "assistant")
        whole_ = "".join(f"{x[2]}\n{x[3]}\n" for x in said)
        assert (r["n_turns"], r["turns_sha256"]) == (len(said), hashlib.sha256(whole_.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    for r in turns.collect():
        ids = np.frombuffer(bytes(r["ids"]), "<u4")
        marks = np.flatnonzero(ids >= ids[0])
        assert len(marks) == 3 and r["formatted"].startswith("### ") and r["formatted"].endswith("</turn>\n")
        inside = r["formatted"][4:-8]
        assert "</turn>" not in inside.replace("\\</turn>", "") and "###" not in inside.replace("\\#", "")
    starts = turns.where("conv_id = 2").orderBy("n").collect()
    assert [r["start"] for r in starts] == [0, *np.cumsum([r["n_ids"] for r in starts])[:-1]]
    assert chat.read_digests(chat.written_turns(rows.where("false"), BYTES), BYTES).count() == 0


def test_escaping_is_reversible():
    for text in [*ODD, "\\", "\\\\###", "####", "#####</turn>", "a\\\nb", "</turn", "\\</turn>"]:
        assert chat.unescape(chat.escape(text)) == text


BIG = "<p>" + "x" * 200 + "</p>"
PAGES = [
    (5, "http://a/\r\nX: y", BIG), (3, "http://b", BIG), (9, None, BIG), (3, "http://b", BIG), (None, "http://n", BIG),
    (1, "http://c", None), (2, "http://d", ""), (4, "http://e", "short"), (6, "http://f", "short"), (7, "", "é" * 50), (8, "", "é" * 50),
    (10, "u", "\r\n\r\nWARC/1.0\r\n" * 20), (11, "u", "z" * 300_000),
]


def test_archives_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    index = warc.write_archives(pages, str(tmp_path / "warc"))
    got = [
        (r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
        for r in warc.read_archives(index, str(tmp_path / "warc")).collect()
    ]
    want = []
    for own, _, html in PAGES:
        data = (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "").encode() == data and p is not None]
        other = len(data) >= 100 and same and own != min(same)
        want.append((own, len(data), hashlib.sha256(data).hexdigest(), "revisit" if other else "response", min(same) if other else None))
    assert sorted(got, key=str) == sorted(want, key=str)
    some = index.where("page_id in (10, 11)")
    payloads = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_archives(some, str(tmp_path / "warc")).collect()}
    assert payloads == {10: PAGES[11][2], 11: PAGES[12][2]}
    assert warc.write_archives(pages.where("false"), str(tmp_path / "none")).count() == 0


def test_ranges_join_neighbours():
    found = list(warc.ranges([(0, 10), (10, 5), (20, 5), (10_000_000, 7), (10_000_007, 1)]))
    assert found == [(0, 25, 0, 3), (10_000_000, 10_000_008, 3, 5)]


def test_a_damaged_payload_is_noticed():
    data = zlib.decompress(warc.record(1, "u", b"abc" * 50, hashlib.sha256(b"abc" * 50).hexdigest(), None), 31)
    assert warc.parse(data)["payload"] == b"abc" * 50
    with pytest.raises(ValueError):
        warc.parse(data.replace(b"abcabc", b"abcabd", 1))
