"""One JSON document per case, committed as a whole.

``commit`` writes to a staged folder, whose name Spark's readers skip, and renames
it to the next version: a batch is there entirely or not at all, and what was
committed before stays readable. ``read`` takes the latest document of each case.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PREFIX = "version="


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """Committed versions, one per batch."""
    at, fs = _file_system(spark, root)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n[len(PREFIX) :]) for n in names if n.startswith(PREFIX))


def stage(documents: DataFrame, root: str) -> str:
    """Writes documents(case_id, document) where no reader looks, and says where."""
    path = f"{root}/.staged-{uuid.uuid4().hex}"
    documents.select("case_id", "document").write.parquet(path)
    return path


def publish(spark: SparkSession, staged: str, root: str) -> int:
    """Renames what was staged to the next version; another writer that was faster makes it try the one after."""
    source, fs = _file_system(spark, staged)
    version = max(versions(spark, root), default=0) + 1
    while fs.exists(source):
        target, _ = _file_system(spark, f"{root}/{PREFIX}{version:06d}")
        if not fs.exists(target) and fs.rename(source, target):
            return version
        version += 1
    raise FileNotFoundError(staged)


def commit(documents: DataFrame, root: str) -> int:
    return publish(documents.sparkSession, stage(documents, root), root)


def read(cases: DataFrame, root: str) -> DataFrame:
    """(case_id, document, outcome) for every case: ok with an object, else {} and absent, corrupt or not_object."""
    spark = cases.sparkSession
    if not versions(spark, root):
        latest = cases.select("case_id", F.lit(None).cast("string").alias("text"), F.lit(False).alias("found")).limit(0)
    else:
        w = Window.partitionBy("case_id").orderBy(F.desc("version"))
        rows = spark.read.option("basePath", root).parquet(*[f"{root}/{PREFIX}{v:06d}" for v in versions(spark, root)])
        latest = rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("case_id", F.col("document").alias("text"), F.lit(True).alias("found"))
    met = cases.select("case_id").distinct().join(latest, "case_id", "left")
    return met.select("case_id", *_judged(F.col("text"), F.coalesce("found", F.lit(False))))


def _judged(text: Column, found: Column) -> list[Column]:
    parsed = F.try_parse_json(F.coalesce(text, F.lit("")))
    kind = F.schema_of_variant(parsed)
    outcome = F.when(~found, "absent").when(parsed.isNull(), "corrupt").when(~kind.startswith("OBJECT"), "not_object").otherwise("ok")
    return [F.when(outcome == "ok", F.to_json(parsed)).otherwise("{}").alias("document"), outcome.alias("outcome")]


def field(document: Column, path: str, kind: str = "string") -> Column:
    """A value in a document, null where it is missing or of another kind."""
    return F.try_variant_get(F.parse_json(document), f"$.{path}", kind)
