"""Streaming forms of batch operators: open recordings by a time gap, and drop-out counts by minute."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recordings(stream: DataFrame, gap: str = "120 seconds", late: str = "10 minutes") -> DataFrame:
    """Recordings of each device: a pause longer than ``gap`` ends one. Needs case_id and a timestamp ``at``."""
    rows = stream.withWatermark("at", late).groupBy("case_id", F.session_window("at", gap).alias("w"))
    return rows.agg(F.count("*").alias("n_rows"), F.max("speed_kmh").alias("max_kmh")).select(
        "case_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_rows", "max_kmh"
    )


def minute_counts(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Rows, drop-outs and fixes of each device by minute."""
    from ..functions import predicates as P

    rows = stream.withWatermark("at", late).groupBy("case_id", F.window("at", "1 minute").alias("w"))
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(P.is_dropout()).alias("dropouts"), F.count_if(P.has_fix()).alias("fixes")).select("case_id", F.col("w.start").alias("minute"), "n_rows", "dropouts", "fixes")
