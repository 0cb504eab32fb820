from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from passagelake.config import Settings  # noqa: E402
from passagelake.plans.engine import Engine  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small() -> Settings:
    return Settings(term_buckets=3, doc_buckets=3, salts=2)


@pytest.fixture
def make_engine(spark, small, tmp_path):
    def make(files: dict[str, bytes] | None = None, name: str = "index", **options) -> Engine:
        engine = Engine(spark, str(tmp_path / name), options.pop("settings", small), **options)
        if files:
            engine.ingest(uploads(spark, files))
        return engine

    return make


def uploads(spark, files: dict[str, bytes]):
    rows = [(n, bytearray(d), i) for i, (n, d) in enumerate(files.items())]
    return spark.createDataFrame(rows, "filename string, content binary, position int")


DOME = b"""Dome Log of the Hillside Observatory

The mirror cover stays shut until humidity drops under seventy percent for one hour.
Assistants write the seeing estimate on a slate before the first exposure begins.

Lightning within ten kilometres closes the shutter at once and the mount is parked.
Visitors wait in the lower gallery until a night assistant calls them up the stairs.
"""
BAKERY = b"""Notes from the Village Bakery

Sourdough proves overnight in willow baskets beside the cold flour store.
Rye loaves rest for a day, because the crumb is gummy when it is still warm.

The stone oven is swept with a wet broom every Tuesday after the last batch.
"""
PIANO = b"""Piano Workshop Bench Card

A tuner checks the pitch fork against the wall clock and then sets the middle octave.
Felt hammers are needled softly; a stool with three legs never rocks on old boards.
"""
CORPUS = {"dome.txt": DOME, "bakery.md": BAKERY, "piano.txt": PIANO}
