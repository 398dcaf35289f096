"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Every stage takes any columns besides its own (clashing names among them), null ids and texts, repeated rows and an empty
table, which gives an empty one; all but the last return the columns they were given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern import reachable
from quern.llm import decontaminate, mixing, quality, rans, simhash
from quern.llm._shared import shared_path


def _beside(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on `labels`, rejects go. Null and empty texts are scored like any other; rows that share an id are scored each by its text."""
    reachable(spark)
    return quality.kept(docs, _beside(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (0.8 or more of their 5-word shingles shared) the document with the smallest id stays; documents without an id stay."""
    reachable(spark)
    return simhash.without_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak an item of `benchmark` go. Null and empty texts leak nothing; of repeated rows all go or stay."""
    reachable(spark)
    return decontaminate.decontaminated(docs, _beside(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for, up to three times. Null is a source of its own; texts without words have the whole copies of their source alone."""
    reachable(spark)
    return mixing.remixed(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files of all documents, in ascending order of ids; what is read back from them. Null texts are empty ones; repeated rows are written each."""
    reachable(spark)
    return rans.token_round_trip(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token_files", write_token_files),
]

#: SQL can express neither the classifier nor the coder; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`."""
    docs = _beside(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
