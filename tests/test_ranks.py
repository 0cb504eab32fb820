"""Nearest ranks against sorted lists."""

from __future__ import annotations

import random

import pytest

from passagelake.operators import ranks


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_ranks_equal_sorted_lists(spark, monkeypatch, accuracy):
    monkeypatch.setattr(ranks, "ACCURACY", accuracy)
    rng = random.Random(accuracy)
    groups = {
        "even": [rng.random() for _ in range(3000)], "ties": [float(rng.randrange(3)) for _ in range(2500)],
        "one": [4.0], None: [-1.0, 7.0, 7.0], "skewed": [0.0] * 2000 + [10.0 ** rng.randrange(9) for _ in range(50)],
    }
    rows = [(g, v) for g, values in groups.items() for v in values] + [("even", None), ("nothing", None)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "kind string, value double").repartition(4)
    shares = [0.0, 0.001, 0.5, 0.95, 0.999, 1.0]
    got = {(r["kind"], r["share"]): (r["n"], r["value"]) for r in ranks.nearest_ranks(frame, "kind", "value", shares).collect()}
    assert got == {
        (g, s): (len(v), sorted(v)[min(int(s * len(v)), len(v) - 1)]) for g, v in groups.items() for s in shares
    }


def test_no_group_is_sorted_whole(spark):
    frame = spark.range(10_000).selectExpr("id % 2 AS kind", "cast(id AS double) AS value")
    plan = ranks.nearest_ranks(frame, "kind", "value", [0.5])._jdf.queryExecution().executedPlan().toString()
    # what is ordered comes out of an aggregate that was combined before the shuffle
    window = plan[plan.index("Window") :]
    assert "HashAggregate" in window and "partial_count" in window
