"""Physical plans have the shape that holds up on large data."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import CORPUS, uploads
from passagelake.operators.chunk import chunk_rows, text_blocks, with_chunks
from passagelake.operators import lexical
from passagelake.operators.intake import first_of_each
from passagelake.plans.engine import Engine


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def index(spark, small, tmp_path_factory):
    engine = Engine(spark, str(tmp_path_factory.mktemp("plans")), small)
    engine.ingest(uploads(spark, CORPUS))
    return engine.index()


def questions(spark):
    return spark.createDataFrame([("q", "lightning shutters")], "query_id string, question string")


def test_chunking_is_one_map_over_the_text_column(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    blocks = rows.select("doc_id", text_blocks(F.col("text")).alias("blocks"))
    plan = plan_of(chunk_rows(with_chunks(blocks)))
    assert "Exchange" not in plan and "Python" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    # packing and its carried tail, once: no inferred filter evaluates them again
    assert plan.count("aggregate(") == 2


def test_scores_are_limited_where_the_postings_lie(spark, index):
    """Nothing is exchanged between the postings and the best of each question in each bucket."""
    plan = plan_of(index.lexical(questions(spark), 10))
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Join" not in plan
    below = plan[plan.index("MapInArrow") :]
    assert "Exchange" not in below and "/postings" in below
    above = plan[: plan.index("MapInArrow")]
    assert above.count("Exchange") == 1 and "WindowGroupLimit" in above and "Partial" in above
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "postings" in line)
    assert "In(term" in scan.split("PushedFilters")[1]


def test_deletions_need_no_join_with_postings(spark, small, tmp_path):
    engine = Engine(spark, str(tmp_path / "gone"), small)
    engine.ingest(uploads(spark, CORPUS))
    engine.delete_documents([engine.documents().where("filename = 'bakery.md'").first()["doc_id"]])
    spark.sparkContext.setJobGroup("reading", "")
    index = engine.index()
    spark.sparkContext.setJobGroup("other", "")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("reading")
    assert index.gone and "Join" not in plan_of(index.lexical(questions(spark), 10))
    # other tables meet the bitmaps, one row a segment and bucket, by a broadcast
    assert "SortMergeJoin" not in plan_of(index.chunks) and "BroadcastHashJoin" in plan_of(index.chunks)


def test_beyond_the_size_limit_the_join_is_salted(spark, index):
    from dataclasses import replace

    salted = replace(index, settings=replace(index.settings, broadcast_rows=0))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(salted.lexical(questions(spark), 10))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "_salt" in plan and "BroadcastHashJoin" not in plan


def test_neighbours_join_on_grams_only(spark, index):
    terms = spark.createDataFrame([("lightnin",)], "term string")
    plan = plan_of(
        lexical.fuzzy_neighbours(terms, index.grams, index.gram_order, index.settings)
    )
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "bit_count" in plan


def test_lookups_of_terms_read_their_buckets_only(spark, index):
    from passagelake.workspace import save

    terms = save(spark.createDataFrame([("lightnin",)], "term string"), "terms")
    plan = plan_of(index.expansions(terms))
    scans = [line for line in plan.splitlines() if "FileScan" in line and "/vocabulary" in line]
    assert scans and all("term_bucket" in line.split("PartitionFilters")[1].split("]")[0] for line in scans)
    near = plan_of(lexical.fuzzy_neighbours(terms, index.grams, index.gram_order, index.settings))
    scan = next(line for line in near.splitlines() if "FileScan" in line and "/grams" in line)
    assert "gram_bucket" in scan.split("PartitionFilters")[1].split("]")[0]


def test_jobs_of_one_question(spark, index):
    """Each saved table is a job, and its size is known without another."""
    context = spark.sparkContext
    context.setJobGroup("one question", "retrieval")
    index.retrieve(questions(spark)).collect()
    context.setJobGroup("other", "")
    jobs = len(context.statusTracker().getJobIdsForGroup("one question"))
    assert 0 < jobs <= 40, jobs
    print("jobs of one question:", jobs)


def test_first_copies_are_combined_before_the_shuffle(spark):
    rows = spark.range(10).select(F.lit("same").alias("sha256"), F.col("id").alias("position"), F.col("id").cast("string").alias("doc_id"))
    plan = plan_of(first_of_each(rows, ["sha256"], "position", "doc_id"))
    assert "partial_min" in plan and "Window" not in plan


def test_neighbours_are_not_sent_to_the_driver(spark, index):
    """Their number grows with the vocabulary; only the question's own terms are broadcast."""
    from passagelake.workspace import save

    terms = save(spark.createDataFrame([("lightnin",), ("shutter",)], "term string"), "terms")
    plan = plan_of(index.expansions(terms))
    assert plan.count("SortMergeJoin") == 1
    similar = save(lexical.fuzzy_neighbours(terms, index.grams, index.gram_order, index.settings), "neighbours")
    ways = [
        sorted(map(tuple, lexical.known_terms(index.term_rows, similar, index.settings, grows).collect()))
        for grows in (False, True)
    ]
    assert ways[0] == ways[1] != []
