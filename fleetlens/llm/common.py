"""Helpers that several training-data operators share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_recorders: list[list[str]] = []
#: Name of the column of row keys.
ROW = "_row_key"
#: Keys of 8 bytes that are broadcast (about 40 MB on an executor); a checkpointed side has no size that Spark could judge by.
BROADCAST_KEYS = 1_000_000
#: Links of 16 bytes that a task of ``connected_components`` reads.
LINKS_A_TASK = 250_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder in spark.checkpoint.dir; where that is unset, a temporary one in local mode, and none on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="fleetlens-"))


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def output_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for something that stays."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def recorded(paths: list[str]):
    """Adds the tables that ``stored`` writes meanwhile to ``paths``."""
    _recorders.append(paths)
    try:
        yield
    finally:
        _recorders.pop()


def release(spark: SparkSession, paths: list[str], needed: DataFrame) -> None:
    """Delete recorded tables that ``needed`` is not read from."""
    files = needed.inputFiles() if paths else []
    for path in [p for p in paths if not any(p.rpartition("/")[2] in f for f in files)]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        paths.remove(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once, compressed, into the shared folder and read back."""
    path = output_path(df.sparkSession, name)
    for paths in _recorders:
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few_or_shuffled(rows: DataFrame, keys: DataFrame, on: str, how: str) -> DataFrame:
    """Semi or anti join with keys that are counted first: they are broadcast up to ``BROADCAST_KEYS``, else both sides are shuffled."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, on, how)


def row_keyed(df: DataFrame) -> DataFrame:
    """The rows with a key of their own each, written once: ids may be null or repeat, and a recomputed key may differ."""
    return stored(df.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def doc_fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k."""
    return F.crc32(doc_id.cast("string").cast("binary")) % k


def with_running_sums(
    df: DataFrame, order: list[str], sums: dict[str, Column], by: list[str] | None = None, partitions: int | None = None
) -> DataFrame:
    """Exclusive running sums of each column of ``sums`` in the total order ``order``.

    ``by`` (a prefix of ``order``) restarts the sums per group. Rows are range
    partitioned on the whole order, so a group of any size spreads over many
    tasks; only one row per partition and group is added up across partitions,
    through a second, small, window. ``order`` must be a total order.
    """
    spark = df.sparkSession
    by = by or []
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id())
    ranged = materialize(ranged.select(*df.columns, "_p", *[c.cast("long").alias(f"_v_{k}") for k, c in sums.items()]))
    inner = Window.partitionBy("_p", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("_p", *by).agg(*[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in sums])
    # One row per (partition, group): the number of partitions bounds what a group's window holds.
    across = Window.partitionBy(*[F.col(c) for c in by] or [F.lit(0)]).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_p", *by, *[F.coalesce(F.sum(f"_s_{k}").over(across), F.lit(0)).alias(f"_o_{k}") for k in sums])
    local = ranged.select(*df.columns, "_p", *[F.coalesce(F.sum(f"_v_{k}").over(inner), F.lit(0)).alias(f"_l_{k}") for k in sums])
    offsets = offsets.select(F.col("_p").alias("_q"), *[F.col(c).alias(f"_by_{c}") for c in by], *[f"_o_{k}" for k in sums])
    cond = F.col("_p") == F.col("_q")
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    joined = local.join(offsets, cond)
    return joined.select(*df.columns, *[(F.col(f"_l_{k}") + F.col(f"_o_{k}")).alias(k) for k in sums])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the smallest node reachable.

    Alternating large-star and small-star rounds: each round is two grouped
    minima and two joins on node ids, state is the edge list alone and is
    checkpointed each round; nothing is gathered on the driver but two counts.
    """

    def directed(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()

    def state(e: DataFrame) -> tuple:
        row = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        return tuple(row)

    current = materialize(directed(edges))
    seen = state(current)
    for _ in range(max_rounds):
        # Few links need few tasks, however many partitions a shuffle has.
        tasks = seen[0] // LINKS_A_TASK + 1
        turned = F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
        both = current.coalesce(tasks).select(F.inline(F.array(F.struct("a", "b"), turned)))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: every larger neighbour of a node points to the node's smallest neighbour, a row for each link.
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: a node and its smaller neighbours point to the smallest of them.
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_low, "a").select(F.inline(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))))
        current = materialize(directed(small).coalesce(tasks))
        now = state(current)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
