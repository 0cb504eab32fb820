"""Whitening, backtracking BPE and collocations against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
pytest.importorskip("passagelake.llm")

from passagelake.llm import bpe, phrases  # noqa: E402
from passagelake.llm.phrases import collocations  # noqa: E402
from passagelake.llm.whitening import covariance, whiten  # noqa: E402

BYTES = public_tokenizers.path("byte_bpe_50k.json")


# -- whitening ------------------------------------------------------------------------------


def plain_whitening(vectors, components):
    """Each usable row's deviation, and the exact covariance of the distinct integer vectors."""
    good = [
        (k, v) for k, v in vectors
        if v and all(c is not None and math.isfinite(c) and abs(c) < 2**55 for c in v)
    ]
    sizes = Counter(len(v) for _, v in good)
    d = max(sizes, key=lambda n: (sizes[n], n))
    rows = [(k, [math.floor(64 * c) + 1_000_000 for c in v]) for k, v in good if len(v) == d]
    fit = sorted({tuple(x) for _, x in rows})
    n, sums = len(fit), [sum(x[i] for x in fit) for i in range(d)]
    cov = np.array([
        [float(Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in fit), n**3)) for j in range(d)]
        for i in range(d)
    ])
    deviation = [(k, sum((n * c - s) ** 2 for c, s in zip(x, sums))) for k, x in rows]
    return n, sums, rows, cov, deviation


def test_whitening_equals_plain_covariance(spark):
    rng = random.Random(5)
    base = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(60)]
    vectors = [(i, [v[0], v[1], v[0] * 0.5 + v[2], v[3], v[4] + v[1]]) for i, v in enumerate(base)]
    vectors += [(100, vectors[3][1]), (None, vectors[4][1]), (3, vectors[5][1])]  # copies, null and repeated ids
    vectors += [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [float("nan")] * 5), (203, [float("inf")] * 5)]
    vectors += [(204, []), (205, [1.0, 2.0]), (206, [1e300] * 5)]
    frame = spark.createDataFrame(
        [(k, v, "clash", 1) for k, v in vectors], "vec_id long, embedding array<double>, x string, component int"
    ).repartition(5)
    got = whiten(frame, components=4).collect()
    n, sums, rows, cov, deviation = plain_whitening(vectors, 4)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:4], axes[:, ::-1][:, :4]
    assert len(got) == len(rows) * 4 and {r["n"] for r in got} == {n}
    assert sorted((str(r["vec_id"]), r["deviation"]) for r in got if r["component"] == 1) == sorted((str(k), v) for k, v in deviation)
    want = defaultdict(list)
    for k, x in rows:
        w = (np.array(x) - np.array(sums) / n) @ axes / np.sqrt(values)
        want[k].append(np.abs(w))
    seen = defaultdict(list)
    for r in got:
        seen[r["vec_id"], r["component"]].append(abs(r["whitened"]))
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(cov), rel=1e-9)
        assert r["identity_error"] < 1e-9
    for (k, c), found in seen.items():
        assert sorted(found) == pytest.approx(sorted(w[c - 1] for w in want[k]), abs=1e-7)


def test_polarisation_is_exact_for_large_numbers():
    rng = random.Random(1)
    rows = [[rng.randrange(-(2**55), 2**55) for _ in range(3)] for _ in range(20)]
    s = [sum(r[i] for r in rows) for i in range(3)]
    squares = {(i, j): sum((r[i] + (r[j] if i != j else 0)) ** 2 for r in rows) for i in range(3) for j in range(i, 3)}
    v = covariance(20, s, squares)
    for i in range(3):
        for j in range(3):
            exact = Fraction(sum((20 * r[i] - s[i]) * (20 * r[j] - s[j]) for r in rows), 20**3)
            assert v[i, j] == pytest.approx(float(exact), rel=1e-12)


def test_whitening_of_large_entries(spark):
    rows = [(i, [float(2**50 + i * 2**30), float(i)]) for i in range(8)]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), components=2).collect()
    assert {r["deviation"] for r in got} == {None}  # more than 64 bits hold
    assert all(math.isfinite(r["whitened"]) for r in got)


def test_whitening_without_variance(spark):
    schema = "vec_id string, embedding array<float>"
    assert whiten(spark.createDataFrame([], schema)).collect() == []
    assert whiten(spark.createDataFrame([("a", [1.0, 2.0])] * 3, schema)).collect() == []
    two = whiten(spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 2.0])], schema)).collect()
    assert {(r["vec_id"], r["component"], round(abs(r["whitened"]), 9)) for r in two} == {("a", 1, 1.0), ("b", 1, 1.0)}


# -- BPE ------------------------------------------------------------------------------------


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTES)


HARD = [
    "", " ", "  ", "\n", " \n \n\n x", "don't we'll I'VE 12345 a1b2", "aaaaaaaaaaaaaaaaaaaaaaaaaaa", "<|endoftext|>", "x<|endoftext|> y<|endoftext",
    "naïve Straße — “quoted” … 北京 😀👩‍👩‍👧   ​﻿\x00\x1f\x85", "é" * 50, "́՘႔0ᲊ", "word.word,word;  tabs\t\tand\r\nlines",
    "-" * 300, "=" * 65 + " " * 130 + "end", "ab" * 4000, "a" * 20_000, "　".join("abc"), "thethethe ingingtionationation" * 20,
]


def test_bpe_equals_the_library_and_round_trips(spark):
    rng = random.Random(2)
    letters = "aeinorst  .,'\n0189-_ÄéñΩж北😀 \t"
    texts = HARD + ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(300)]
    rows = [(i if i % 7 else None, t, i) for i, t in enumerate(texts)] + [(1, None, -1), (1, texts[9], 9), (1, texts[9], 9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids long").repartition(3)
    got = bpe.decode(bpe.encode(frame, BYTES), BYTES).collect()
    tokenizer = library()
    want = Counter()
    for k, t, _ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want[k, tuple(ids), tokenizer.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r["doc_id"], tuple(r["ids"]), r["text"]) for r in got) == want


def test_bpe_special_strings_as_text():
    tokenizer = library()
    tokenizer.encode_special_tokens = True
    encoder = bpe.Encoder(BYTES, special=False)
    assert encoder.encode("a<|endoftext|>b") == tokenizer.encode("a<|endoftext|>b", add_special_tokens=False).ids


def test_long_runs_cross_blocks():
    """Backtracking over several blocks of matches gives what the merges give."""
    encoder, tokenizer = bpe.Encoder(BYTES), library()
    rng = random.Random(3)
    for text in ("".join(rng.choice("abcdetion") for _ in range(3 * bpe.BLOCK)), "ab" * bpe.BLOCK, "ation" * bpe.BLOCK):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder._backtrack(text) == want and encoder.encode(text) == want


def test_decoding_of_any_ids(spark):
    rows = [("a", [0, 50256, 13]), ("b", [447]), ("c", None), ("d", [])]
    frame = spark.createDataFrame(rows, "doc_id string, ids array<int>")
    got = {r["doc_id"]: r["text"] for r in bpe.decode(frame, BYTES).collect()}
    tokenizer = library()
    assert got == {k: tokenizer.decode(v or [], skip_special_tokens=False) for k, v in rows}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(empty, BYTES), BYTES).collect() == []


# -- phrases --------------------------------------------------------------------------------

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_phrases(rows, max_words, least, covered, top):
    import re

    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(FOLD)):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, max_words + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    candidates = {p: a for p, a in counts.items() if len(p[1]) > 1 and a >= least}
    longest = defaultdict(int)
    for (lang, words), a in candidates.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                part = lang, words[i : i + k]
                longest[part] = max(longest[part], a)
    found = defaultdict(list)
    for (lang, words), a in candidates.items():
        if 100 * longest[lang, words] >= covered * a and (lang, words) in longest:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((10**6 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        found[lang].append((-score, -a, " ".join(words).encode(), left, right))
    out = []
    for lang, some in found.items():
        for rank, (s, a, phrase, left, right) in enumerate(sorted(some)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def some_texts(seed, n):
    rng = random.Random(seed)
    words = ["New", "york", "city", "hall", "é", "the", "of", "Ünder", "x" * 300, "a-b"]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" "] * 8 + ["  ", "\t", ". ", ",", "\n", ": \r\n"]) for _ in range(rng.randrange(90)))
        rows.append((text + (passage if i % 3 == 0 else ""), rng.choice(["en", "de", None, "und"])))
    return rows + [(None, "en"), ("", None), (" .\n,", "de"), ("same " * 3000, "en"), ("same same", "fr")] + [("new york city", "en")] * 20


@pytest.mark.parametrize(("max_words", "least", "covered", "top"), [(3, 10, 50, 2000), (4, 3, 80, 7), (2, 2, 50, 50)])
def test_phrases_equal_plain_counting(spark, max_words, least, covered, top):
    rows = some_texts(max_words, 120)
    frame = spark.createDataFrame([(t, x, 1, "c") for t, x in rows], "text string, lang string, f long, chunk string").repartition(4)
    got = collocations(frame, max_words, least, covered, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_phrases(rows, max_words, least, covered, top)


def test_phrases_with_a_saturated_bitmap_and_small_batches(spark, monkeypatch):
    """A bitmap that lets everything through, forced cuts and flushes change nothing."""
    rows = some_texts(9, 60)
    for name, value in (("MOST_BITS", 1 << 16), ("HELD", 50), ("AT_ONCE", 2000), ("LONGEST", 5), ("MODULUS", 3)):
        monkeypatch.setattr(phrases, name, value)
    frame = spark.createDataFrame(rows, "text string, lang string").repartition(2)
    assert sorted(map(tuple, collocations(frame, 3, 10, 50, 100).collect())) == plain_phrases(rows, 3, 10, 50, 100)


def test_phrases_beyond_the_broadcast_limit(spark, monkeypatch):
    from passagelake.llm import common

    rows = some_texts(4, 40)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    frame = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(map(tuple, collocations(frame, 3, 10, 50, 100).collect())) == plain_phrases(rows, 3, 10, 50, 100)


def test_scores_whose_products_pass_64_bits(spark):
    from pyspark.sql import functions as F

    a, left, right = 3 * 10**9 + 1, 4 * 10**9 + 7, 10**10 + 9
    frame = spark.createDataFrame([(a, left, right), (10, 10, 10), (10, 10**12, 10**12)], "a long, l long, r long")
    got = [r[0] for r in frame.select(phrases.score(F.col("a"), F.col("l"), F.col("r"))).collect()]
    assert got == [10**6 * a * a // (left * right), 10**6, 0]


def test_phrases_of_nothing(spark):
    assert collocations(spark.createDataFrame([], "text string, lang string")).collect() == []


def test_a_chunk_is_cut_alike_wherever_it_stands(spark):
    """Equal passages share dictionary entries; frequencies add up to all words."""
    rng = random.Random(8)
    passage = " ".join(rng.choice("abcdefghij") + str(rng.randrange(30)) for _ in range(400))
    rows = [(f"head{i} {passage} tail{i}", "en") for i in range(50)]
    chunks = phrases.parse(spark.createDataFrame(rows, "text string, lang string"), 3).collect()
    owned = sum(r["f"] * (len(r["chunk"].split()) - (0 if r["tail"] else 2)) for r in chunks)
    assert owned == 50 * 402
    assert max(r["f"] for r in chunks) >= 50 and len(chunks) < 50 * 8


def test_digest_of_the_registered_query(spark):
    from passagelake.llm.queries import QUERIES

    got = QUERIES["op12_bpe"](spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    tokenizer = library()
    assert len(got) == len(texts)
    for r in got:
        ids = tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
