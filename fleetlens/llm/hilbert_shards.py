"""Sharding along a Hilbert curve over several metadata dimensions.

Every dimension is quantised to ``2**bits`` cells of near-equal row mass (by the
share of rows that sort before a value, so any column type works and a value
that holds a third of the rows simply spans its cells' first one). Rows are put
in order of the curve index, equal texts of a cell side by side, and the order
is cut into runs of equal row counts: file statistics of every dimension stay
narrow per shard, so readers can skip files on any of them.

Null is a value of its own and sorts first; an empty table gives no rows. Equal rows
stand side by side and get slots of their own; ids may be null, large or repeat, texts of
any length count by their bytes. Only ``doc_id``, ``text`` and the dimensions are read, so
other columns may have any name.
Only narrow rows (ids, sizes, checksums) are ever shuffled; ranks come from
per-partition counts, never from a window over all rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, materialize, with_running_sums

SHARDS = 40
BITS = 6
#: A document costs this many bytes besides its text.
OVERHEAD = 16


def hilbert_index(coords: np.ndarray, bits: int) -> np.ndarray:
    """Curve index of each column of ``coords`` (dimensions x points), by bit planes (Skilling 2004)."""
    x = coords.astype(np.int64).copy()
    dims = x.shape[0]
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo excess work, plane by plane
        low = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & low
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = np.where(on, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = top
    while q > 1:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            index = (index << 1) | ((x[i] >> b) & 1)
    return index


def hilbert_column(dims: list[str], bits: int):
    @F.pandas_udf("long")
    def index(cells: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index(cells[dims].to_numpy(dtype=np.int64).T, bits))

    return index(F.struct(*dims))


def quantise(rows: DataFrame, column: str, bits: int, total: int) -> DataFrame:
    """Add ``_q_<column>``: the cell of each value by the share of rows before it."""
    values = rows.groupBy(column).agg(F.count("*").alias("_n"))
    before = with_running_sums(values, [column], {"_before": F.col("_n")})
    cells = materialize(before.select(
        F.col(column).alias("_value"),
        F.least(F.lit((1 << bits) - 1), F.floor(F.col("_before") * (1 << bits) / max(1, total))).cast("int").alias(f"_q_{column}"),
    ))
    # A value may have a third of all rows: few values travel to the rows; only where there are many do both sides travel.
    cells = F.broadcast(cells) if cells.count() <= BROADCAST_KEYS // 10 else cells
    return rows.join(cells, F.col(column).eqNullSafe(F.col("_value"))).drop("_value")


def assign_shards(
    docs: DataFrame, shards: int = SHARDS, dims: tuple[str, ...] = ("source", "lang", "size_class"), bits: int = BITS, law: str = "rows"
) -> DataFrame:
    """Document rows without their text, with size, text_crc32, curve index, shard and slot.

    ``law`` ``rows`` cuts runs whose counts are at most one apart, ``bytes`` runs
    of near-equal size. ``size_class`` is eighths of the binary logarithm of size.
    """
    blob = F.col("text").cast("binary")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + OVERHEAD
    rows = docs.select(
        "doc_id", size.alias("size"), F.crc32(F.coalesce(blob, F.lit(b""))).alias("text_crc32"),
        F.floor(F.log2(size.cast("double")) * 8).cast("int").alias("size_class"), *[d for d in dims if d != "size_class"],
    )
    rows = materialize(rows)
    totals = rows.agg(F.count("*").alias("n"), F.sum("size").alias("b")).first()
    n, total_bytes = totals["n"], totals["b"] or 0
    cells = rows
    for d in dims:
        cells = quantise(cells, d, bits, n)
    placed = cells.select(*rows.columns, hilbert_column([f"_q_{d}" for d in dims], bits).alias("curve"))
    ranked = with_running_sums(
        placed, ["curve", "text_crc32", "doc_id", "size"], {"_rank": F.lit(1), "_bytes": F.col("size")}
    )
    if law == "rows":
        shard = F.expr(f"cast((_rank * {shards}) div {max(1, n)} as int)")
    elif law == "bytes":
        shard = F.expr(f"cast(((_bytes + size div 2) * {shards}) div {max(1, total_bytes)} as int)")
    else:
        raise ValueError(law)
    ranked = ranked.withColumn("shard", F.least(shard, F.lit(shards - 1)))
    # The first rank of a shard is an aggregate with one row per shard.
    first = F.broadcast(ranked.groupBy("shard").agg(F.min("_rank").alias("_first")))
    out = ranked.join(first, "shard").withColumn("slot", F.col("_rank") - F.col("_first"))
    return out.withColumn("law", F.lit(law)).drop("_rank", "_bytes", "_first")
