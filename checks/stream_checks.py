"""Streaming jobs run to the end of their input; results are read back from the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.text_checks import SCORES
from checks.sqlbase import FACES
from checks.track_checks import REPORTED, track_sql
from docketry import fixtures as X
from docketry.plans import faces as PF
from docketry.sources.readers import shared_folder
from docketry.streaming import documents as SD
from docketry.streaming import tracks as ST
from docketry.streaming import windows as SW

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


@query("t1_stream_documents", f"WITH {SCORES} SELECT doc_id, best_type FROM best")
def t1(spark, sf):
    base = shared_folder(spark, "t1")
    SD.stream_documents(X.scan_stream(spark, sf), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("doc_id", "best_type")


@query("t2_stream_tracks", f"WITH {REPORTED} SELECT camera_id, track_id, frame_idx, event_kind FROM fused")
def t2(spark, sf):
    """Detections are stored once and replayed as a stream."""
    base = shared_folder(spark, "t2")
    X.faces(spark, sf).write.parquet(f"{base}/faces")
    schema = spark.read.parquet(f"{base}/faces").schema
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ST.ROCKSDB)
    try:
        events = ST.stream_tracks(spark.readStream.schema(schema).parquet(f"{base}/faces"))
        ST.write_events(events, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(ST.EVENT_DDL).parquet(f"{base}/out")


@query("t2_track_and_report_batch", f"WITH {REPORTED} SELECT camera_id, track_id, frame_idx, event_kind FROM fused")
def t2b(spark, sf):
    return PF.track_and_report(X.faces(spark, sf))


@query("t3_track_timeout", f"""WITH RECURSIVE {FACES}, {track_sql(0.6, 20)},
h AS (SELECT * FROM tr WHERE frame_idx <= (SELECT max(frame_idx) FROM faces) - 5),
c AS (SELECT camera_id, max(frame_idx) AS newest FROM h GROUP BY 1)
SELECT camera_id, track_id, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame, count(*) AS n_seen FROM h JOIN c USING (camera_id)
GROUP BY camera_id, track_id, newest HAVING newest - max(frame_idx) > 12 OR newest + 30 <= (SELECT max(frame_idx) FROM faces) - 5""")
def t3(spark, sf):
    """Detections, a frame a second, replayed in any order: frames wait for the watermark, and tracks end behind it."""
    base = shared_folder(spark, "t3")
    faces = X.faces(spark, sf).withColumn("at", F.timestamp_seconds("frame_idx"))
    faces.repartition(8, F.xxhash64("frame_idx", "det_no")).write.parquet(f"{base}/faces")
    schema = spark.read.parquet(f"{base}/faces").schema
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ST.ROCKSDB)
    try:
        ends = ST.track_timeout(spark.readStream.schema(schema).parquet(f"{base}/faces"), "at", "5 seconds", "30 seconds")
        ST.write_events(ends, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(ST.END_DDL).parquet(f"{base}/out")


@query("t4_event_sessions_stream", """WITH e AS (SELECT user_id AS track_id, ts, ts >= lag(ts) OVER w + INTERVAL 30 MINUTE AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(coalesce(opens, false)::INT) OVER (PARTITION BY track_id ORDER BY ts, opens DESC ROWS UNBOUNDED PRECEDING) AS n FROM e)
SELECT * FROM (SELECT track_id, min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, count(*) AS n FROM s GROUP BY track_id, s.n)
WHERE window_end <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def t4s(spark, sf):
    """Sessions of a stream that its watermark has closed; partial sessions merge before the shuffle, state holds open ones."""
    base = shared_folder(spark, "t4s")
    schema = X.table(spark, sf, "events").schema
    ev = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).select("ts", F.col("user_id").alias("track_id"))
    before = spark.conf.get("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition")
    spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    try:
        found = SW.event_sessions(ev, "30 minutes")
        found = found.select("track_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("window_start", "window_end")], "n")
        (found.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
         .trigger(availableNow=True).start().awaitTermination())
    finally:
        spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", before)
    return spark.read.schema(found.schema).parquet(f"{base}/out")


@query("t4_event_windows_stream", """SELECT * FROM (SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS window_start, event_type AS event_kind, count(*) AS n FROM events GROUP BY ALL)
WHERE window_start + INTERVAL 20 MINUTE <= (SELECT max(ts) FROM events)""")
def t4(spark, sf):
    """The tumbling windows of a stream that its watermark has closed; state holds open windows only."""
    base = shared_folder(spark, "t4")
    schema = X.table(spark, sf, "events").schema
    ev = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    ev = ev.select("ts", F.col("event_type").alias("event_kind"))

    counted = SW.event_windows(ev, "10 minutes")
    counted = counted.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_kind", "n")
    (counted.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(counted.schema).parquet(f"{base}/out")
