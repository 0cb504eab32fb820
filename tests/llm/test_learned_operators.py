"""Near duplicates, both classifiers and the pipeline."""

from __future__ import annotations

import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagelake.llm import near_dedup, quality_pu, toxicity
from passagelake.llm.wordhash import Words, shingles

WORD = re.compile("[^ \t\n\x0b\f\r]+")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def word_shingles(text):
    words = WORD.findall(fold(text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_hashes_tell_words_and_shingles_apart():
    texts = ["", "A b\tc", "a B c", "one two three four five six", "x " * 9, "é\x0b日本", "long" * 9_000]
    words = Words(texts)
    assert list(np.diff(words.bounds)) == [len(WORD.findall(t)) for t in texts]
    names = [w for t in texts for w in WORD.findall(fold(t))]
    by_hash = {}
    for name, h in zip(names, words.hashes):
        assert by_hash.setdefault(h, name) == name
    assert len(by_hash) == len(set(names))
    values, bounds = shingles(words, 5)
    parts = [set(values[bounds[i] : bounds[i + 1]]) for i in range(len(texts))]
    assert [len(p) for p in parts] == [len(word_shingles(t)) for t in texts] and parts[1] == parts[2]


def families(seed=3):
    """Texts with exact copies, near copies of a hub, chains, and unlike texts that share a passage."""
    rng = random.Random(seed)

    def prose(n):
        return ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]

    shared, rows = prose(60), []
    for k in range(6):
        hub = prose(200)
        rows += [" ".join(hub), " ".join(hub).upper(), "  ".join(hub) + "\n"]
        for edits in (1, 2, 3, 4, 8, 12):
            copy = list(hub)
            for at in rng.sample(range(200), edits):
                copy[at] = prose(1)[0]
            rows.append(" ".join(copy))
            copy = list(copy)
            for at in rng.sample(range(200), 3):
                copy[at] = prose(1)[0]
            rows.append(" ".join(copy))
    rows += [" ".join(prose(60) + shared + prose(60)) for _ in range(20)] + [" ".join(prose(3)) for _ in range(5)]
    rows += ["", None, " \n ", "two words", "Two  Words"]
    return rows


def brute_classes(texts, threshold=0.8):
    parts = [word_shingles(t) for t in texts]
    label = list(range(len(texts)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if similar(parts[i], parts[j]) >= threshold:
                a, b = sorted((top(i), top(j)))
                label[b] = a
    return [top(i) for i in range(len(texts))]


def test_near_duplicate_classes_equal_brute_force(spark):
    texts = families()
    want = brute_classes(texts)
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id long, text string, node string").repartition(3)
    got = {r["id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert len(got) == len(texts)
    for i, first in enumerate(want):
        assert got[i] == got[first], (i, first)  # no link is lost
    # weights may add links just below the plain threshold, and no others
    parts = [word_shingles(t) for t in texts]
    for i, first in got.items():
        if first != want[i]:
            assert max(similar(parts[i], parts[j]) for j in range(len(texts)) if want[j] != want[i] and got[j] == first) > 0.65
    kept = near_dedup.first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values()))


def test_like_nodes_of_a_large_bucket_meet_behind_an_unlike_leader(spark):
    rng = np.random.default_rng(5)
    n = 3_000
    shared = rng.integers(0, 1 << 63, 40, dtype=np.uint64)  # a passage that everybody has
    own = rng.integers(0, 1 << 63, (n, 60), dtype=np.uint64)
    own[2_000] = own[1_000]
    own[2_000, :3] = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    own[:600] = own[0]  # a class that has more in common than with anybody else
    own[:600, 0] = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
    values = [np.sort(np.concatenate((x, shared))) for x in own]
    ones = np.ones(100, "<i4").tobytes()
    parts = spark.createDataFrame([(k, bytearray(v.tobytes()), bytearray(ones)) for k, v in enumerate(values)], "num long, values binary, counts binary")
    log_idf = np.full(near_dedup.COUNTERS, 1.0, np.float32)
    log_idf[near_dedup._counter(shared)] = 0.0  # frequent
    idf = spark.sparkContext.broadcast(log_idf)
    nodes = spark.createDataFrame([(k, 0 if k < 600 else k) for k in range(n)], "num long, cls long")
    groups = near_dedup.open_groups(near_dedup.rare_rows(nodes, parts, idf, 0.8), nodes)
    found = {(r["x"], r["y"]) for r in near_dedup.across(groups, 0.8).collect()}
    assert found == {(1_000, 2_000)}


def test_rounds_go_on_from_the_classes_they_join(spark):
    # links found so far are not gone through again: found ones name classes, and only those change
    rows = spark.createDataFrame([(7, k, 1, c) for k, c in ((1, 1), (2, 1), (3, 3), (4, 4), (5, 3))] + [(8, 6, 6, 6), (8, 9, 6, 9)],
                                 "key long, num long, first long, cls long")
    found = spark.createDataFrame([(1, 3), (6, 9)], "cx long, cy long")
    after = near_dedup.relabelled(rows, found)
    assert {r["num"]: r["cls"] for r in after.collect()} == {1: 1, 2: 1, 3: 1, 5: 1, 4: 4, 6: 6, 9: 6}
    left = near_dedup.open_buckets(after)  # a bucket of one class is done with
    assert {(r["key"], r["num"], r["first_cls"]) for r in left.collect()} == {(7, k, 1) for k in range(1, 6)}


def test_nodes_are_joined_by_size_and_reach_python_in_small_batches(spark, monkeypatch):
    rng = np.random.default_rng(4)
    values = [np.sort(rng.integers(0, 1 << 63, 50, dtype=np.uint64)) for _ in range(3)]
    values[2] = np.sort(np.concatenate((values[0][:48], values[1][:2])))
    ones = np.ones(50, "<i4")
    rows = [
        (bytearray([k]), k, bytearray(v.tobytes()), bytearray(ones.tobytes()), bytearray(near_dedup.binned(v, ones, np.array([0, 50])).tobytes()))
        for k, v in enumerate(values)
    ]
    parts = spark.createDataFrame(rows, "node binary, num long, values binary, counts binary, bins binary")
    pairs = spark.createDataFrame([(0, 1, 0, 1), (0, 2, 0, 2), (1, 2, 1, 2)], "x long, y long, cx long, cy long")
    idf = spark.sparkContext.broadcast(np.zeros(near_dedup.COUNTERS, np.float32))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen = spark.conf.get(key), []
    monkeypatch.setattr(near_dedup, "_save", lambda df, name, save=near_dedup._save: seen.append(spark.conf.get(key)) or save(df, name))
    for limit, sent in ((near_dedup.SENT_BYTES, True), (100, False)):
        monkeypatch.setattr(near_dedup, "SENT_BYTES", limit)
        sides = near_dedup.sent_if_small(parts)
        assert ("broadcast" in sides._jdf.queryExecution().logical().toString()) is sent
        links = near_dedup.verified(near_dedup.bounded(pairs, sides, 0.8), sides, idf, 0.8).collect()
        assert [(r["cx"], r["cy"]) for r in links] == [(0, 2)]
    assert set(seen) == {str(near_dedup.BATCH_BYTES)} and spark.conf.get(key) == before


def test_similar_texts_have_a_rare_shingle_in_common():
    rng = np.random.default_rng(7)
    met = 0
    for n in (1, 2, 5, 60, 1_000):
        for share in (0.0, 0.02, 0.05, 0.1, 0.2):
            for _ in range(20):
                a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
                b = np.unique(np.where(rng.random(len(a)) < share, rng.integers(0, 1 << 63, len(a), dtype=np.uint64), a))
                sides = []
                for x in (a, b):
                    logs = (x % np.uint64(7)).astype(np.float32) / 3
                    sides.append((x, (1 + x % np.uint64(3)) * np.exp(logs), logs))
                rare = [near_dedup.rare_shingles(*side, 0.8) for side in sides]
                if max(near_dedup.similarities(*(s[:2] for s in sides))) >= 0.8:
                    met += 1
                    common, i, j = np.intersect1d(*(s[0][r[0]] for s, r in zip(sides, rare)), return_indices=True)
                    assert len(common)
                    # the first one in common leaves enough behind it, by number or by weight
                    first = min(range(len(common)), key=lambda k: i[k])
                    least = (1 - 1e-4) * 0.8 / 1.8
                    assert any(
                        min(rare[0][k][i[first]], rare[1][k][j[first]]) >= least * whole
                        for k, whole in ((1, len(a) + len(b)), (2, sides[0][1].sum() + sides[1][1].sum()))
                    )
    assert met > 150
    assert len(near_dedup.rare_shingles(np.empty(0, np.uint64), np.empty(0), np.empty(0), 0.8)[0]) == 0


def test_bounds_leave_out_no_similar_pair():
    rng = np.random.default_rng(6)
    for n in (5, 60, 3_000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        for share in (0.0, 0.05, 0.1, 0.3, 0.9):
            b = np.unique(np.where(rng.random(len(a)) < share, rng.integers(0, 1 << 63, len(a), dtype=np.uint64), a))
            sides = [(x, 1.0 + x % np.uint64(7)) for x in (a, b)]
            x, y = (near_dedup.binned(v, w, np.array([0, len(v)])) for v, w in sides)
            if max(near_dedup.similarities(*sides)) >= 0.8:
                assert near_dedup.may_link(x, y, 0.8)[0]
            if share == 0.9 and n == 60:
                assert not near_dedup.may_link(x, y, 0.8)[0]


@pytest.mark.parametrize("kind", ["repeated", "family"])
def test_plain_similarity_links_what_weights_hold_apart(spark, kind):
    rng = random.Random(8)

    def prose(n):
        return ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]

    if kind == "repeated":
        texts = []
        for _ in range(30):
            own = prose(120)
            texts += [" ".join(own), " ".join(own * 3)]
    else:  # a third of the rows, each with rare edits
        hub = prose(100)
        texts = []
        for _ in range(60):
            own = list(hub)
            for at in rng.sample(range(5, 95), 2):
                own[at] = prose(1)[0]
            texts += [" ".join(own), " ".join(prose(100)), " ".join(prose(100))]
    want = brute_classes(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    for i, first in enumerate(want):
        assert got[i] == got[first], (i, first)


def test_repeated_rows_and_null_ids(spark):
    same = " ".join(f"w{k}" for k in range(30))
    rows = [(1, same), (1, same), (2, same), (None, same + " end"), (5, "else where"), (5, "else where")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(docs).collect()
    assert sorted((str(r["id"]), str(r["class_id"])) for r in got) == sorted(
        [("1", "None"), ("1", "None"), ("2", "None"), ("None", "None"), ("5", "5"), ("5", "5")]
    )
    assert sorted(str(r["doc_id"]) for r in near_dedup.first_of_each(docs).collect()) == ["5", "None"]
    assert near_dedup.near_duplicates(docs.where("false")).count() == 0


def test_samples_agree_as_often_as_the_weights_are_similar():
    rng = np.random.default_rng(0)
    base = rng.integers(1, 1 << 63, 4_000, dtype=np.uint64)
    agreed, similarity = [], []
    for k in range(40):
        a, b = base[k * 50 : k * 50 + 200], base[k * 50 + 40 : k * 50 + 240]
        wa, wb = rng.uniform(0.5, 3, 200), rng.uniform(0.5, 3, 200)
        wb[:160] = wa[40:]
        drawn = near_dedup.samples(np.concatenate((a, b)), np.log(np.concatenate((wa, wb))).astype(np.float32), np.array([0, 200, 400]))
        agreed.append((drawn[0] == drawn[1]).mean())
        order_a, order_b = np.argsort(a), np.argsort(b)
        similarity.append(near_dedup.similarities((a[order_a], wa[order_a]), (b[order_b], wb[order_b]))[0])
    assert abs(np.mean(agreed) - np.mean(similarity)) < 0.03


def held_out(i, by, rest):
    return zlib.crc32(str(i).encode()) % by == rest


def test_quality_from_positives_alone(spark):
    rng = random.Random(1)

    def text(good):
        words = ["".join(rng.choices("abcdefg", k=5)) for _ in range(rng.randint(20, 60))]
        return " ".join(words) if good else " ".join(w.upper() + "!!###" for w in words)

    rows = [(i, text(i % 5 != 0)) for i in range(1_000)] + [(None, "x"), (2_000, None), (2_001, ""), (2_002, "w " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    table = quality_pu.features(docs)
    labels = spark.createDataFrame([(i, 1) for i in range(0, 1_000) if i % 5 and i % 3] + [(7, 0), (11, None), (None, 1)], "doc_id long, quality int")
    model = quality_pu.fit(table, quality_pu.trusted_ids(labels, "quality"), F.lit(True))
    assert 0.7 < model.prior < 0.85
    got = {r["id"]: r["score"] for r in quality_pu.scored(table, model).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    right = sum((got[i] >= 0.5) == (i % 5 != 0) for i in range(1_000))
    assert right > 980
    none = quality_pu.fit(table, quality_pu.trusted_ids(labels.where("false"), "quality"), F.lit(True))
    assert {r["score"] for r in quality_pu.scored(table, none).collect()} == {0.5}
    assert quality_pu.scored(quality_pu.features(docs.where("false")), model).count() == 0


def test_unseen_misspellings_are_found(spark):
    rng = random.Random(2)
    # of one language, so that its n-grams are known from clean texts
    syllables = ["ta", "lo", "ri", "men", "sa", "ko", "ne", "du"]

    def prose(n):
        return ["".join(rng.choices(syllables, k=3)) for _ in range(n)]

    def text(insult=None):
        words = prose(rng.randint(30, 200))
        if insult:
            words[rng.randrange(len(words))] = insult
        return " ".join(words)

    known = ["wretchface", "wretchfaced", "wrettchface", "wretchfayce", "wrechface"]
    rows = [(i, text(known[i % 5] if i % 4 == 0 else None), int(i % 4 == 0)) for i in range(600)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(2)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    named = toxicity.toxic_labels(labels)
    assert named.where("id = 0 or id is null").count() == 0
    model = toxicity.fit(docs, named)
    fresh = [text("wretchfase") for _ in range(50)] + [text() for _ in range(50)] + ["", "wretchfface " * 3]
    scores = model.scores(fresh)
    assert (scores[:50] >= 0.3).sum() >= 45 and (scores[50:100] < 0.3).sum() >= 45
    assert scores[100] == pytest.approx(model.share) and scores[101] > 0.5
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "z" * 100_000)], "doc_id long, text string")
    got = toxicity.scored(odd, model).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got)
    silent = toxicity.fit(docs, named.where("false"))
    assert silent.scores(["anything"])[0] == 0.0
    assert toxicity.scored(odd.where("false"), model).count() == 0


def test_stretches_overlap_and_long_texts_are_passed_over(spark):
    bounds = np.array([0, 9, 9, 12])
    starts, edges = toxicity.halves(bounds)
    assert starts.tolist() == [0, 4, 8, 9] and edges.tolist() == [0, 3, 3, 4]
    other, joined = toxicity.partners(edges)
    assert other.tolist() == [1, 2, 1, 3] and joined.tolist() == [True, True, True, False]
    assert toxicity.partners(np.array([0, 0]))[0].size == 0
    rows = [(i, ("vile " if i % 2 else "fine ") * 5) for i in range(200)] + [(1_000 + i, "fine " * 2_000) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "id long, label int")
    # none of the long texts fits, wherever it stands in the order; all others are learned from
    model = toxicity.fit(docs, labels, characters=9_000)
    assert model.share == 0.5
    assert model.scores(["vile vile"])[0] > 0.5 > model.scores(["fine fine"])[0]
    assert toxicity.fit(docs, labels, characters=10).share == 0.0


LARGE = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(LARGE), reason="needs the larger tables")
@pytest.mark.parametrize("name, label, found, marked", [
    ("op7_toxicity", "toxic", 0.75, 0.025), ("op9_quality_classifier", "quality", 0.97, 0.1),
])
def test_rows_held_out_of_the_labels(spark, name, label, found, marked):
    """The share of held-out rows of label 1 that are predicted so, and of label 0 that are too."""
    from passagelake.llm.queries import QUERIES

    labels = spark.read.parquet(f"{LARGE}/labels.parquet").select("doc_id", F.col(label).alias("y")).where("y is not null")
    rows = QUERIES[name](spark, LARGE).where("held_out").join(labels, "doc_id")
    share = {r["y"]: r["share"] for r in rows.groupBy("y").agg(F.avg("predicted").alias("share")).collect()}
    assert share[1] >= found and share[0] <= marked, share


DATA = "/root/testdata/sf0.001"


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline
    from passagelake.llm.queries import quality_scores
    from test_text_operators import brute_hits, brute_lines

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    described, model = quality_scores(spark, DATA, docs)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    scores = {r["id"]: r["score"] for r in quality_pu.scored(described, model).collect()}
    rows = {i: t for i, t in rows.items() if scores[i] >= 0.5}
    rows = {i: t for i, _, _, t in brute_lines(list(rows.items()))}
    ids = sorted(rows)
    classes = brute_classes([rows[i] for i in ids])
    rows = {i: rows[i] for i, k in zip(ids, classes) if ids[k] == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    hits = {i: brute_hits(t, items) for i, t in rows.items()}
    rows = {i: t for i, t in rows.items() if not hits[i][1] or 20 * len(hits[i][1]) < hits[i][0]}

    stages = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.save(stage(spark, docs, DATA), name)
        stages.append(docs)
    assert all(s.columns == ["doc_id", "text", "lang", "source", "n_chars"] for s in stages[:-1])
    assert {r["doc_id"]: r["text"] for r in stages[-2].collect()} == rows
    assert all(r["n_chars"] == len(r["text"]) for r in stages[-2].collect())
    pieces = stages[-1].groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("all")).collect()
    assert {r["doc_id"] for r in pieces} == set(rows) and all(r["n"] == r["all"] for r in pieces)
    # the same rows again through the registered query
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == sorted(map(tuple, stages[-1].collect()))


def test_pipeline_passes_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").where("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered_queries_of_the_part():
    from passagelake.llm.queries import ORACLES, QUERIES

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
