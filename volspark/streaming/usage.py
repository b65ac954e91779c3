"""Resource samples as a stream: a summary for each stage and session of work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(samples: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(stage, began, ended, peak, most_processes, samples) of samples (stage, ts, used, processes); works on streams and tables alike.

    A session ends when no sample came for `gap`; on a stream, samples later than `late` are left out, as its watermark says.
    """
    rows = samples.withWatermark("ts", late) if samples.isStreaming else samples
    grouped = rows.groupBy(F.session_window("ts", gap).alias("w"), "stage").agg(F.max("used").alias("peak"), F.max("processes").alias("most_processes"), F.count(F.lit(1)).alias("samples"))
    return grouped.select("stage", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "peak", "most_processes", "samples")
