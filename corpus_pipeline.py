"""A training corpus from the table ``documents``: filter, clean, reduce, decontaminate, pack.

Each stage reads all rows the one before kept, and its decisions hold for all later ones:

* ``quality`` drops documents that the positive-unlabelled classifier scores below 0.5;
* ``lines`` takes out the lines that ten documents or more share (no document is dropped);
* ``near_duplicates`` keeps the first document of each class of near copies;
* ``decontaminate`` drops documents of which a twentieth or more is benchmark text;
* ``pack`` lays what is left along the Hilbert curve and cuts it into sequences.

All but the last return the columns of ``documents``; where a text is changed, ``n_chars``
follows. An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagelake.llm import decontaminate as benchmark_passages
from passagelake.llm import near_dedup, quality_pu
from passagelake.llm.common import attach, keyed, save, table
from passagelake.llm.line_dedup import dedup_lines
from passagelake.llm.queries import packed_pieces, quality_scores

#: the first stage keeps documents scored so or higher
KEPT_SCORE = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    described, model = quality_scores(spark, sf_dir, docs)
    rejected = quality_pu.scored(described, model).where(F.col("score") < KEPT_SCORE)
    key = ["_id", "_tie"]
    return attach(keyed(docs), save(rejected.select(*key).distinct(), "rejected"), key, "left_anti").select("_row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = F.when(F.col("_row.text").isNotNull(), F.col("kept"))
    row = F.col("_row").withField("text", kept)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.char_length(kept).cast(docs.schema["n_chars"].dataType))
    return dedup_lines(docs, min_docs=10, min_chars=1).select(row.alias("_row")).select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.first_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return benchmark_passages.decontaminate(docs, table(spark, sf_dir, "benchmark"), n=13, mode="drop", share=20)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_pieces(docs)


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: the first and third stage cannot be said in SQL; tests hold the rows against plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = save(docs, name)
    return docs
