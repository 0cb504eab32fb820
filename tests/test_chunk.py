from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passagelake.operators import chunk as C


def chunked(spark, blocks, target, overlap):
    frame = spark.createDataFrame([("d", blocks)], f"doc_id string, blocks {C.BLOCKS}")
    return C.chunk_rows(C.with_chunks(frame, target, overlap)).orderBy("ordinal").collect()


def test_sizes_order_and_overlap(spark):
    text = " ".join(f"Item {i} names part{i} up to part{i + 9} in the long list." for i in range(100))
    chunks = chunked(spark, [(1, text)], 100, 25)
    assert len(chunks) > 5
    assert [c["ordinal"] for c in chunks] == list(range(len(chunks)))
    assert [c["chunk_id"] for c in chunks][:2] == ["d:0", "d:1"]
    assert all(c["n_words"] <= 120 for c in chunks)
    assert all(c["n_words"] == len(c["text"].split()) for c in chunks)
    for one, two in zip(chunks, chunks[1:]):
        assert set(one["text"].split()) & set(two["text"].split())


def test_page_of_the_first_sentence(spark):
    chunks = chunked(spark, [(3, "Alpha beta gamma."), (4, "Delta epsilon.")], 100, 10)
    assert [(c["page"], c["text"]) for c in chunks] == [(3, "Alpha beta gamma. Delta epsilon.")]


def test_endless_sentence_is_sliced(spark):
    chunks = chunked(spark, [(None, " ".join(f"w{i}" for i in range(600)))], 100, 20)
    assert len(chunks) == 4
    assert all(c["n_words"] <= 160 for c in chunks)


def test_nothing_in_nothing_out(spark):
    assert chunked(spark, [], 100, 20) == []
    assert chunked(spark, [(None, "  ")], 100, 20) == []


def test_form_feeds_number_pages(spark):
    frame = spark.createDataFrame([("one\n\ntwo\fthree",), ("plain",), ("",)], "x string")
    got = [r[0] for r in frame.select(C.text_blocks(F.col("x"))).collect()]
    assert [(b["page"], b["text"]) for b in got[0]] == [(1, "one"), (1, "two"), (2, "three")]
    assert [(b["page"], b["text"]) for b in got[1]] == [(None, "plain")]
    assert got[2] == []


def greedy(sizes, target, overlap, smallest):
    """The packing rule in its plainest form, on unit sizes."""
    chunks, buffer = [], []
    for i, n in enumerate(sizes):
        filled = sum(sizes[k] for k in buffer)
        if buffer and filled + n > target and filled >= smallest:
            chunks.append((buffer[0], i, filled))
            buffer = [k for k in buffer if sum(sizes[k:i]) <= overlap]
        buffer.append(i)
    if buffer:
        chunks.append((buffer[0], len(sizes), sum(sizes[k] for k in buffer)))
    return chunks


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.lists(st.integers(1, 70), max_size=40), min_size=1, max_size=40),
    st.sampled_from([(40, 0), (40, 20), (60, 30), (100, 25), (180, 45)]),
)
def test_cuts_match_the_plain_rule(spark, documents, sizes):
    target, overlap = sizes
    smallest = max(20, target // 3)
    frame = spark.createDataFrame([(i, d) for i, d in enumerate(documents)], "i int, n array<int>")
    cuts = frame.select("i", C.chunk_cuts(F.col("n"), target, overlap, smallest).alias("c"))
    got = {r["i"]: [tuple(c) for c in r["c"]] for r in cuts.collect()}
    for i, document in enumerate(documents):
        assert got[i] == greedy(document, target, overlap, smallest)
