"""One-to-one matching, greedy in a given order, in one pass over the pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(pairs: DataFrame, keys: list[str], low: Column, high: Column, name: str = "island") -> DataFrame:
    """Numbers runs of pairs whose stretches [low, high] overlap or touch; pairs that share an end have a stretch in common."""
    rows = pairs.withColumn("_lo", low).withColumn("_hi", high)
    w = Window.partitionBy(*keys).orderBy("_lo", "_hi")
    reach = F.max("_hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.coalesce(F.col("_lo") > reach, F.lit(True)).cast("long"))
    return rows.withColumn(name, F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))).drop("_lo", "_hi", "_new")


def greedy(pairs: DataFrame, keys: list[str], left: str, right: str, order: list[str]) -> DataFrame:
    """Takes pairs in ``order`` as long as both ends are free.

    ``pairs`` has ``left_at`` and ``right_at``, any place on a line for either end,
    always the same for the same end. Pairs of ends that lie apart cannot compete, so the
    line is cut where no pair lies over it, and each stretch is settled by one
    fold over its pairs: no rounds, and a group is never gathered whole unless its
    pairs overlap from one end to the other.
    """
    rows = islands(pairs, keys, F.least("left_at", "right_at"), F.greatest("left_at", "right_at"), "_island")
    unit = F.struct(*order, F.col(left).alias("_l"), F.col(right).alias("_r"))
    lists = rows.groupBy(*keys, "_island").agg(F.array_sort(F.collect_list(unit)).alias("_pairs"))
    none = F.slice("_pairs", 1, 0)

    def take(taken: Column, pair: Column) -> Column:
        free = ~F.exists(taken, lambda t: (t["_l"] == pair["_l"]) | (t["_r"] == pair["_r"]))
        return F.when(free, F.concat(taken, F.array(pair))).otherwise(taken)

    taken = F.aggregate("_pairs", none, take)
    return lists.select(*keys, F.explode(taken).alias("_p")).select(*keys, *[F.col(f"_p.{c}").alias(c) for c in order if c not in (left, right)], F.col("_p._l").alias(left), F.col("_p._r").alias(right))
