"""Corpus pipeline: toxicity, near duplicates, benchmark leaks, source mixing, token shards.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; the driver
writes it as Parquet and reads it back as the next stage's docs. All but the
last keep the columns of ``documents``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import decontamination, mixing, simhash, token_shards, toxicity
from fleetlens.llm.common import ROW, doc_fold, few_or_shuffled, materialize, output_path, read_table, recorded, release, row_keyed

#: Tables that stages have written for themselves.
_left: list[str] = []


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """Frees what earlier stages have left in the shared folder, once their result is a table of its own."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _left, docs)
        with recorded(_left):
            return f(spark, docs, sf_dir)

    return run


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; every row is judged by its own text, whatever its id."""
    held_out = doc_fold(F.col("doc_id"), 3) == 1
    return toxicity.without_toxic(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels"), ~held_out))


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row, with the smallest id; null, empty and wordless texts all stay."""
    keyed = row_keyed(docs)
    groups = keyed.select(ROW, "doc_id").join(simhash.similar_rows(keyed), ROW)
    first = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).alias("first"))
    # By row keys, as a group may hold a third of all rows.
    dropped = materialize(groups.select(ROW).join(first.select(f"first.{ROW}"), ROW, "left_anti"))
    return few_or_shuffled(keyed, dropped, ROW, "left_anti").select(*docs.columns)


@stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.without_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: whole passes over a source, and cut documents for its rest."""
    return mixing.mixed_documents(docs)


@stage
def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of token ids in training order, written to the shared folder; one row per record as written."""
    return token_shards.training_order(docs, output_path(spark, "shards"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("source mixing", mix_sources),
    ("token ids in training order", write_tokens),
]

#: Models, XXH64 and a byte-pair vocabulary are beyond SQL; the tests compare the stages after the toxicity model with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next one reads it."""
    base = output_path(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    return run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {}
