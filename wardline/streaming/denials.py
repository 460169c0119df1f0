"""Denials per user over time, for streams and tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def denial_windows(denials: DataFrame, length: str = "1 hour", slide: str = "15 minutes",
                   lateness: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Denials per user and sliding window; late rows past the watermark are dropped."""
    timed = denials.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    return (timed.groupBy("user_id", F.window(ts, length, slide).alias("w"))
            .agg(F.count(F.lit(1)).alias("n_denials"))
            .select("user_id", F.col("w.start").alias("window_start"),
                    F.col("w.end").alias("window_end"), "n_denials"))


def denial_session_stream(denials: DataFrame, gap: str = "5 minutes",
                          lateness: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Bursts of denials per user of a stream, separated by a pause of `gap`.

    Set spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition to combine
    the denials of a user before the shuffle.
    """
    timed = denials.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    return (timed.groupBy("user_id", F.session_window(ts, gap).alias("w"))
            .agg(F.count(F.lit(1)).alias("n_denials"))
            .select("user_id", F.col("w.start").alias("burst_start"),
                    F.col("w.end").alias("burst_end"), "n_denials"))


def denial_sessions(denials: DataFrame, gap_seconds: int = 300, ts: str = "ts") -> DataFrame:
    """Bursts of denials per user of a table, separated by a pause of the gap.

    Denials of one user within one second are combined before the shuffle, with a gap that
    covers them, so a user with most of the denials is still a short list.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    seconds = (denials.groupBy("user_id", F.floor(micros / 1_000_000).alias("second"))
               .agg(F.min(micros).alias("first"), F.max(micros).alias("last"),
                    F.count(F.lit(1)).alias("n")))
    gap = F.concat((F.col("last") - F.col("first") + gap_seconds * 1_000_000).cast("string"),
                   F.lit(" microseconds"))
    start = F.timestamp_micros("first")
    return (seconds.withColumn("_start", start)
            .groupBy("user_id", F.session_window("_start", gap).alias("w"))
            .agg(F.sum("n").alias("n_denials"))
            .select("user_id", F.col("w.start").alias("burst_start"),
                    F.col("w.end").alias("burst_end"), "n_denials"))
