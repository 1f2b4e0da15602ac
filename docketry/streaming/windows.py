"""Event counts per time window; the same code serves tables and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.operators.ordered import ordered_scan


def instant(ts: Column) -> Column:
    """A zone-less time as an instant, read as UTC whatever the session's zone."""
    parts = [f(ts).cast("int") for f in (F.year, F.month, F.day, F.hour, F.minute)]
    return F.make_timestamp(*parts, F.extract(F.lit("SECOND"), ts), F.lit("UTC"))


def _watermarked(events: DataFrame, lateness: str) -> DataFrame:
    # a watermark needs an instant, not a zone-less time
    zoneless = dict(events.dtypes)["ts"] == "timestamp_ntz"
    return (events.withColumn("ts", instant(F.col("ts"))) if zoneless else events).withWatermark("ts", lateness)


def event_windows(events: DataFrame, length: str, slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """(window_start, window_end, event_kind, n) for tumbling or sliding windows over ``ts``."""
    if events.isStreaming:
        events = _watermarked(events, lateness)
    counted = events.groupBy(F.window("ts", length, slide).alias("w"), "event_kind").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_kind", "n")


def event_sessions(events: DataFrame, gap: str, lateness: str = "10 minutes") -> DataFrame:
    """(track_id, window_start, window_end, n): stretches of a track's events without a pause of ``gap``.

    A table is scanned in order by day, so that a track with most of the events is spread over its days; what is grouped
    are whole sessions.  A stream uses session windows.
    """
    if not events.isStreaming:
        pause = F.expr(f"INTERVAL {gap}")
        days = F.unix_date(F.to_date("ts"))
        rows = ordered_scan(
            events.filter("ts IS NOT NULL").select("track_id", "ts"), ["track_id"], ["ts"], days,
            breaks={"session": lambda prev, row: row["ts"] >= prev["ts"] + pause})
        return rows.groupBy("track_id", "session").agg(
            F.min("ts").alias("window_start"), (F.max("ts") + pause).alias("window_end"), F.count("*").alias("n")).drop("session")
    events = _watermarked(events, lateness)
    counted = events.groupBy(F.session_window("ts", gap).alias("w"), "track_id").agg(F.count("*").alias("n"))
    return counted.select("track_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")
