"""Line dedup, quality rules and decontamination against plain Python."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from passagelake.llm.decontaminate import decontaminate, scan
from passagelake.llm.line_dedup import dedup_lines, line_bitmaps
from passagelake.llm.quality_rules import RULES, judge, limits, measured, sketches

SCHEMA = "doc_id long, text string, lang string, source string, _id string, n_lines string, kept string"
SPACE = " \t\n\x0b\f\r"


def docs_of(spark, texts, schema=SCHEMA):
    rows = [(i, t, "en" if i is None or i % 3 else None, "s", "own", "own", "own") for i, t in texts]
    return spark.createDataFrame(rows, schema).repartition(3)


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


COMMON = ["\t Terms of Use ", "terms of use", "É sure", "ÉSURE"]
TEXTS = (
    [(i, f"{COMMON[i % 2]}\nown line {i}\n\n{COMMON[2]}\nown line {i}") for i in range(12)]
    + [(100 + i, f"é sure\nİ {i}\n{COMMON[3]}") for i in range(9)]
    + [(None, "terms OF use"), (None, None), (7, "again\nterms of use"), (300, ""), (301, None), (302, "\n\n"), (303, " "), (304, "x" * 70_000 + "\nterms of use\x0b")]
    + [(400, "twice\nterms of use")] * 2
    + [(500, "\n".join([f"line {k}" if k % 7 else "Terms of Use" for k in range(1_000)]))]
)


def brute_lines(texts, min_docs=10):
    held = Counter()
    for _, t in texts:
        held.update({k for k in (fold(x.strip(SPACE)) for x in (t or "").split("\n")) if k})
    out = []
    for i, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if held[fold(x.strip(SPACE))] < min_docs]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup_equals_plain_python(spark):
    found = dedup_lines(docs_of(spark, TEXTS), min_docs=10)
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in found.select("_row.doc_id", "n_lines", "n_dropped", "kept").collect()]
    assert sorted(got, key=str) == sorted(brute_lines(TEXTS), key=str)


@pytest.mark.parametrize("own", [1, None])
def test_equal_rows_are_documents(spark, own):
    """Ten and more equal rows share all their lines, with ids and without."""
    texts = [(own, "same line\nown\nown")] * 12 + [(5, "rare")] * 9
    found = dedup_lines(docs_of(spark, texts), min_docs=10)
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in found.select("_row.doc_id", "n_lines", "n_dropped", "kept").collect()]
    assert sorted(got, key=str) == sorted(brute_lines(texts), key=str) and (own, 3, 3, "") in got


def test_first_occurrence_is_kept(spark):
    texts = [(i, "same\nsame\nx") for i in range(3)]
    found = dedup_lines(docs_of(spark, texts), min_docs=2, keep="first").select("_row.doc_id", "kept")
    assert {r["doc_id"]: r["kept"] for r in found.collect()} == {0: "same", 1: "", 2: ""} or {
        r["doc_id"]: r["kept"] for r in found.collect()
    } == {0: "same\nx", 1: "", 2: ""}
    with pytest.raises(ValueError):
        line_bitmaps(docs_of(spark, texts), keep="last")


def test_short_keys_and_no_rows(spark):
    texts = [(i, "é\nlong line") for i in range(4)]
    found = dedup_lines(docs_of(spark, texts), min_docs=2, min_chars=2).select("kept").distinct().collect()
    assert [r["kept"] for r in found] == ["é"]
    assert dedup_lines(docs_of(spark, [])).count() == 0


WORD = re.compile("[^ \t\n\x0b\f\r]+")


def brute_counts(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(8)}
    n = len(words)
    return (
        n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit),
        n < 20 or 100 * len(hit) > 30 * n,
    )


def test_quality_counts_equal_plain_python(spark):
    prose = " ".join(f"word{k}" for k in range(60))
    texts = [(i, f"{prose} {i}\n{prose[:40]}\n{prose[:40]}") for i in range(30)] + [
        (50, None), (51, ""), (52, " \x0b\f "), (53, "a b c d e f g h " * 4), (54, "a b c d e f g h a b c d e f g h i"),
        (55, "x " * 500), (56, prose.replace(" ", "### ")), (57, prose + "\n" + prose), (None, prose), (58, prose), (58, prose),
        (59, "日本 語\u00a0x é# " * 3), (60, "y" * 40_000),
    ]
    found = judge(docs_of(spark, texts))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = sorted(((r["doc_id"], *(r[n] for n in names)) for r in found.select("_row.doc_id", *names).collect()), key=str)
    assert got == sorted(((i, *brute_counts(t)) for i, t in texts), key=str)
    kept = {r["doc_id"]: r["kept"] for r in found.select("_row.doc_id", "kept").collect()}
    assert all(kept[i] for i in range(30)) and kept[58] and kept[None]
    assert not any(kept[i] for i in (50, 51, 52, 53, 55, 56, 60))
    assert judge(docs_of(spark, [])).count() == 0


def test_limits_follow_their_group(spark):
    """The same symbols are too many among prose, and usual among code."""
    prose, code = " ".join(f"w{k}ord" for k in range(80)), " ".join(f"a{k}*b<c>" for k in range(80))
    rows = [(i, f"{prose} {i}", "en", "books") for i in range(300)] + [(1000 + i, f"{code} {i}", "en", "code") for i in range(300)]
    rows += [(5000, code, "en", "books")]
    found = judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    kept = {r["doc_id"]: r["kept"] for r in found.select("_row.doc_id", "kept").collect()}
    assert kept.pop(5000) is False and all(kept.values())


def test_limits_follow_the_tail_of_their_group(spark):
    """Usual repetition lifts a source's limits, by a bounded step; rows that fail the base rule lift none."""
    words = [f"word{k}" for k in range(100)]

    def text(i, again):
        return " ".join(words + [f"own{i}"]) + "\n" + " ".join(words[:again])

    rows = [(i, text(i, 0), "en", "plain") for i in range(300)]
    rows += [(1_000 + i, text(i, 10 if i % 10 == 0 else 0), "en", "refrains") for i in range(300)]
    rows += [(2_000 + i, "again and again " * 30 if i % 3 == 0 else text(i, 0), "en", "junk") for i in range(300)]
    rows += [(3_000 + i, "too few", "en", "short") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    failed = F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")
    found = limits(sketches(measured(docs).withColumn("base_failed", failed)), min_group=100)
    high = {r["_source"]: r["repeats_high"] for r in found.collect()}
    rule = next(r for r in RULES if r.name == "repeats")
    assert high["plain"] == high["junk"] == rule.margin
    assert rule.margin < high["refrains"] <= rule.margin + rule.rise
    kept = {r["doc_id"]: r["kept"] for r in judge(docs).select("_row.doc_id", "kept").collect()}
    assert len(kept) == len(rows) and not any(kept[3_000 + i] for i in range(3))
    assert all(kept[i] for i in range(300)) and all(kept[1_000 + i] for i in range(300))


TEST_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_hits(text, items, n=13):
    words = TEST_WORD.findall(fold(text or ""))
    hit, ids = set(), set()
    for item, t in items:
        w = TEST_WORD.findall(fold(t or ""))
        size = min(n, len(w))
        for p in range(len(w) - size + 1 if size else 0):
            for q in range(len(words) - size + 1):
                if words[q : q + size] == w[p : p + size]:
                    hit.update(range(q, q + size))
                    ids.add("" if item is None else str(item))
    return len(words), sorted(hit), sorted(ids)


ITEMS = [
    (1, "One two three four five six seven eight nine ten Eleven twelve thirteen fourteen."), (10, "tiny item"),
    (2, "One two three four five six seven eight nine ten eleven twelve thirteen"), (3, ""), (4, None), (None, "null é item"),
    (1, "One two three four five six seven eight nine ten Eleven twelve thirteen fourteen."), (5, "é É"), (6, "..."),
]
PASSAGE = "one, TWO three-four five six seven eight nine ten eleven: twelve (thirteen) fourteen"


def passages():
    filler = " ".join(f"filler{k}" for k in range(300))
    return [
        (1, PASSAGE), (2, f"start {PASSAGE} end {PASSAGE}"), (3, f"{filler} tiny, item {filler}"), (4, None), (5, ""), (6, "..."),
        (7, "one two three four five six seven eight nine ten eleven twelve"), (8, "null É item"), (None, f"a {PASSAGE}"),
        (9, PASSAGE), (9, PASSAGE), (9, "another text"), (10, "null é item é é É"), (11, "x" * 50_000 + " tiny item"),
    ]


def test_hits_equal_plain_python(spark):
    texts = passages()
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = scan(docs_of(spark, texts), items).select("_row.doc_id", "n_words", "hit_words", "items").collect()
    got = sorted(((r["doc_id"], r["n_words"], r["hit_words"], r["items"]) for r in found), key=str)
    assert got == sorted(((i, *brute_hits(t, ITEMS)) for i, t in texts), key=str)


def test_dropping_and_cutting(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = docs_of(spark, passages())
    kept = decontaminate(docs, items)
    assert kept.columns == docs.columns
    clean = [i for i, t in passages() if not (h := brute_hits(t, ITEMS))[1] or 20 * len(h[1]) < h[0]]
    assert sorted([r["doc_id"] for r in kept.collect()], key=str) == sorted(clean, key=str)
    cut = {r["doc_id"]: r["text"] for r in decontaminate(docs, items, mode="cut").collect()}
    assert cut[2] == "start end" and cut[4] is None and cut[6] == "..." and cut[1] == ""
    assert cut[3] == " ".join([*(f"filler{k}" for k in range(300)), *(f"filler{k}" for k in range(300))])
    with pytest.raises(ValueError):
        decontaminate(docs, items, mode="hide")


def test_an_empty_benchmark_or_corpus(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = docs_of(spark, passages())
    assert {len(r["hit_words"]) for r in scan(docs, none).collect()} == {0}
    assert decontaminate(docs_of(spark, []), none).count() == 0


def test_line_query_hash(spark, tmp_path):
    from passagelake.llm.queries import op1_line_dedup

    docs_of(spark, TEXTS).drop("_id").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["doc_id"], r["kept_sha256"]) for r in op1_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {(i, hashlib.sha256(t.encode()).hexdigest()) for i, _, _, t in brute_lines(TEXTS)}


def test_bitmaps_name_only_documents_that_lose_lines(spark):
    found = line_bitmaps(docs_of(spark, TEXTS)).select("_id", F.size("dropped").alias("n")).collect()
    assert {r["_id"] for r in found} >= set(range(12)) and 300 not in {r["_id"] for r in found}
