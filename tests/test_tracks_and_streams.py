import random

import pytest
from pyspark.sql import functions as F

from docketry import fixtures as X
from docketry.operators import tracks as V
from docketry.plans import faces as PF
from docketry.sources.readers import shared_folder
from docketry.streaming import documents as SD
from docketry.streaming import tracks as ST
from docketry.streaming import windows as SW

SF = "/root/testdata/sf0.001"
FACE = "camera_id bigint, frame_idx bigint, det_no int, cx int, cy int, w int"


def tracked(spark, rows, **kw):
    df = spark.createDataFrame([(1, f, d, x, y, w) for f, d, x, y, w in rows], FACE)
    return [r["track_id"] for r in V.track_faces(df, **kw).orderBy("frame_idx", "det_no").collect()]


def test_reappearing_faces(spark):
    for gap, same in ((12, True), (13, True), (14, False), (40, False)):
        got = tracked(spark, [(1, 0, 100, 100, 50), (1 + gap, 0, 100, 100, 50)])
        assert (got[0] == got[1]) == same, gap


def test_reach_and_ties(spark):
    # reach is the larger of 20 pixels and 0.6 of the width, inclusive
    assert tracked(spark, [(1, 0, 0, 0, 10), (2, 0, 20, 0, 10), (3, 0, 41, 0, 10)]) == [0, 0, 1]
    # two tracks equally far: the first known one
    assert tracked(spark, [(1, 0, 0, 0, 60), (1, 1, 40, 0, 60), (2, 0, 20, 0, 60)]) == [0, 1, 0]
    # both detections of a frame may take the same track; it has moved when the second looks
    assert tracked(spark, [(1, 0, 0, 0, 60), (2, 0, 10, 0, 60), (2, 1, 30, 0, 60)]) == [0, 0, 0]
    # tracks born in a frame are not matched in it
    assert tracked(spark, [(1, 0, 0, 0, 60), (1, 1, 1, 0, 60)]) == [0, 1]


def test_order_of_tracks_after_a_frame(spark):
    # in frame 2 only the second face is seen, so it is tried first in frame 3
    rows = [(1, 0, 0, 0, 60), (1, 1, 100, 0, 60), (2, 0, 80, 0, 60), (3, 0, 40, 0, 100)]
    assert tracked(spark, rows) == [0, 1, 1, 1]


@pytest.mark.parametrize("chunk", [2, 16, 4096])
def test_cutting_a_camera_changes_nothing(spark, chunk):
    """One tracker over the whole camera, and the cut form, number tracks alike."""
    rng = random.Random(chunk)
    rows, frame = [], 0
    for _ in range(150):
        frame += rng.choice([1, 1, 1, 3, 13, 14, 15, 30])
        rows += [(frame, d, rng.randint(0, 200), rng.randint(0, 200), rng.choice([20, 60, 120])) for d in range(rng.randint(1, 3))]
    t = V.Tracker()
    t.start()
    want = [o[2] for r in rows for o in t.row(*r)]
    assert tracked(spark, rows, chunk_frames=chunk) == want


def frames_df(spark, rows):
    """(track, frame, ear, cx, smile?)"""
    data = [(0, t, f, ear, cx, 0, 200, 0.5 if s else 0.1, 0.1, False) for t, f, ear, cx, s in rows]
    return spark.createDataFrame(data, "camera_id bigint, track_id bigint, frame_idx bigint, ear double, cx int, cy int, bw int, mouth_w_ratio double, mouth_open_ratio double, is_fake boolean")


def test_blinks(spark):
    def events(closed, chunk=4096):
        df = frames_df(spark, [(1, i + 1, 0.1 if c == "x" else 0.4, 0, False) for i, c in enumerate(closed)])
        return [(r["frame_idx"], r["run_length"]) for r in V.blink_events(df, chunk_frames=chunk).orderBy("frame_idx").collect()]

    for chunk in (2, 3, 4096):
        assert events("xxx.", chunk) == [(4, 3)]
        assert events("xx.xxxx.xxx", chunk) == [(8, 4)]  # too short; counted; never opened again
        assert events("...", chunk) == []


def test_smiles_restart_every_third_frame(spark):
    df = frames_df(spark, [(1, i, 0.4, 0, i != 8) for i in range(1, 12)])
    for chunk in (2, 4096):
        got = [r["frame_idx"] for r in V.smile_events(df, chunk_frames=chunk).orderBy("frame_idx").collect()]
        assert got == [3, 6, 11]


def thin(frames, gap=12):
    last, kept = 0, []
    for f in frames:
        if f - last > gap:
            kept.append(f)
            last = f
    return kept


@pytest.mark.parametrize("chunk", [5, 4096])
def test_cooldown(spark, chunk):
    rng = random.Random(9)
    tracks = {1: [12, 13, 25, 26, 38], 2: [13, 25, 26], 3: sorted(rng.sample(range(1, 400), 120)), 4: [500], 5: [1, 2, 3]}
    rows = [(0, t, f, "blink") for t, fs in tracks.items() for f in fs]
    df = spark.createDataFrame(rows, "camera_id bigint, track_id bigint, frame_idx bigint, event_kind string")
    got = {t: [] for t in tracks}
    for r in V.cooldown(df, chunk_frames=chunk).orderBy("frame_idx").collect():
        got[r["track_id"]].append(r["frame_idx"])
    assert got == {t: thin(fs) for t, fs in tracks.items()}


def naive_events(rows):
    """Frame by frame, as one loop with all its counters."""
    out, st = [], {}
    for t, f, ear, cx, smiling in rows:
        s = st.setdefault(t, dict(closed=0, smile=0, saved=0, prev=None))
        free = lambda: f - s["saved"] > 12
        moved = s["prev"] is not None and abs(cx - s["prev"]) > 200 * 0.05 and free()
        blink = False
        if ear < 0.25:
            s["closed"] += 1
        else:
            blink = s["closed"] >= 3 and not moved
            s["closed"] = 0
        s["smile"] = s["smile"] + 1 if smiling else 0
        smile = s["smile"] >= 3
        if smile:
            s["smile"] = 0
        for kind, hit in (("smile", smile), ("blink", blink), ("motion", moved)):
            if hit and free():
                out.append((t, f, kind))
                s["saved"] = f
        s["prev"] = cx
    return out


@pytest.mark.parametrize("chunk", [4, 64, 4096])
def test_fused_events_against_the_loop(spark, chunk):
    rng = random.Random(chunk)
    rows = [(t, f, rng.choice([0.1, 0.1, 0.4]), rng.choice([0, 0, 0, 50]), rng.random() < 0.6) for t in range(3) for f in range(1, 200)]
    got = sorted((r["track_id"], r["frame_idx"], r["event_kind"]) for r in V.fused_events(frames_df(spark, rows), chunk_frames=chunk).collect())
    assert got == sorted(naive_events(rows))


def test_adaptive_need(spark):
    df = spark.createDataFrame([(0, 1, f, w) for f, w in enumerate([250] * 5 + [100] * 12 + [800] * 3, 1)], "camera_id bigint, track_id bigint, frame_idx bigint, bw int")
    got = [r["frame_idx"] for r in V.blink_adaptive(df, F.lit(True)).orderBy("frame_idx").collect()]
    # 5 frames at width 250, ten (clamped from 12) at 100, then two counted frames meet the low need of 800
    assert got == [5, 15, 18, 20]


def test_stale_frames(spark):
    df = spark.createDataFrame([(0, 1, 1, 0.1), (0, 1, 4, 0.2), (0, 1, 30, 0.3), (0, 2, 40, 0.4)], "camera_id bigint, track_id bigint, frame_idx bigint, ear double")
    got = [(r["frame_idx"], r["ear"], r["stale"]) for r in V.carry_stale(df).filter("track_id = 1").orderBy("frame_idx").collect()]
    want = [(1, 0.1, False), (2, 0.1, True), (3, 0.1, True), (4, 0.2, False)] + [(f, 0.2, True) for f in range(5, 17)] + [(30, 0.3, False)]
    assert got == want + [(f, 0.3, True) for f in range(31, 41)]


def test_screens_in_force(spark):
    faces = spark.createDataFrame([(0, f, 0, 10, 10, 5, 5) for f in (5, 6, 11, 12, 18)], "camera_id bigint, frame_idx bigint, det_no int, x int, y int, w int, h int")
    screens = spark.createDataFrame([(0, 6, 0, 10, 10, 5, 5), (0, 7, 0, 0, 0, 99, 99), (0, 18, 0, 11, 10, 50, 50)], "camera_id bigint, frame_idx bigint, obj_no int, x int, y int, w int, h int")
    got = {r["frame_idx"]: r["is_fake"] for r in V.screen_containment(faces, screens).collect()}
    assert got == {5: False, 6: True, 11: True, 12: False, 18: False}


# --- streams -----------------------------------------------------------------------------------

def test_track_stream_in_many_batches_equals_batch(spark):
    base = shared_folder(spark, "stream")
    faces = X.faces(spark, SF).cache()
    cuts = [0, 20, 21, 60, 10**6]
    for low, high in zip(cuts, cuts[1:]):
        # one micro-batch per stretch of frames
        faces.filter((F.col("frame_idx") > low) & (F.col("frame_idx") <= high)).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(faces.schema).parquet(f"{base}/in")
        ST.write_events(ST.stream_tracks(stream), f"{base}/out", f"{base}/cp").awaitTermination()
    got = sorted(map(tuple, spark.read.schema(ST.EVENT_DDL).parquet(f"{base}/out").collect()))
    want = sorted(map(tuple, PF.track_and_report(faces).select("camera_id", "track_id", "frame_idx", "event_kind").collect()))
    assert got == want and len(want) > 50


def test_late_frames_are_dropped(spark):
    base = shared_folder(spark, "late")
    schema = FACE + ", ear double, mouth_w_ratio double, mouth_open_ratio double, is_fake boolean"
    for frame in (20, 19, 40):
        spark.createDataFrame([(1, frame, 0, 0, 0, 200, 0.4, 0.1, 0.1, True)], schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(schema).parquet(f"{base}/in")
        ST.write_events(ST.stream_tracks(stream), f"{base}/out", f"{base}/cp").awaitTermination()
    assert sorted(r["frame_idx"] for r in spark.read.schema(ST.EVENT_DDL).parquet(f"{base}/out").collect()) == [20, 40]


def test_document_stream_equals_batch(spark):
    base = shared_folder(spark, "docs")
    SD.stream_documents(X.scan_stream(spark, SF), f"{base}/out", f"{base}/cp").awaitTermination()
    from docketry.operators import classify as K
    got = {(r[0], r[1]) for r in spark.read.parquet(f"{base}/out").select("doc_id", "best_type").collect()}
    assert got == {(r[0], r[1]) for r in K.classify(X.scans(spark, SF)).select("doc_id", "best_type").collect()}


def test_windows_of_a_stream_close_behind_the_watermark(spark):
    base = shared_folder(spark, "win")
    schema = "ts timestamp, event_kind string"
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    for minutes in ([1, 2, 11], [40], [3, 90]):
        rows = [(t0 + dt.timedelta(minutes=m), "blink") for m in minutes]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        ev = SW.event_windows(spark.readStream.schema(schema).parquet(f"{base}/in"), "10 minutes")
        ST.write_events(ev, f"{base}/out", f"{base}/cp").awaitTermination()
    got = sorted((r["window_start"].minute, r["n"]) for r in spark.read.parquet(f"{base}/out").collect())
    # minute 3 came after its window had closed; the window of minute 90 is still open
    assert got == [(0, 2), (10, 1), (40, 1)]


def test_sessions_of_a_hot_track(spark):
    import datetime as dt
    import random
    rng = random.Random(4)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1 if rng.random() < 0.9 else rng.randrange(2, 6), t0 + dt.timedelta(minutes=rng.choice([1, 29, 30, 31]) * rng.randrange(400))) for _ in range(600)]
    df = spark.createDataFrame(rows, "track_id int, ts timestamp_ntz")
    want = []
    for k in {r[0] for r in rows}:
        times = sorted(t for i, t in rows if i == k)
        start, last, n = times[0], times[0], 0
        for t in [*times, None]:
            if t is None or t - last >= dt.timedelta(minutes=30):
                want.append((k, start, last + dt.timedelta(minutes=30), n))
                start, n = t, 0
            last, n = t, n + 1
    got = [tuple(r) for r in SW.event_sessions(df, "30 minutes").select("track_id", "window_start", "window_end", "n").collect()]
    assert sorted(got) == sorted(want)
    assert SW.event_sessions(df.limit(0), "30 minutes").count() == 0


def test_blinks_hidden_by_movement_that_gets_through(spark):
    # eyes closed on three frames, open on the fourth; the face jumps on every frame
    rows = [(1, 1, f, 0.1 if f % 4 else 0.9, 100 * f, 0, 50, 0.0, 1.0, False) for f in range(1, 61)]
    df = spark.createDataFrame(rows, "camera_id bigint, track_id bigint, frame_idx bigint, ear double, cx int, cy int, bw int, mouth_w_ratio double, mouth_open_ratio double, is_fake boolean")
    last, want = 0, []
    for f in range(1, 61):
        moved = f > 1 and f - last > 12
        if f % 4 == 0 and not moved:
            want.append(f)
        if moved:
            last = f
    assert sorted(r["frame_idx"] for r in V.coupled_blinks(df).collect()) == want and 0 < len(want) < 15


def crowded(rng, n_frames):
    """An unbroken camera with crossing, jumping and alternating faces, so that some chunks start from a wrong guess."""
    rows = []
    for f in range(1, n_frames):
        for d in range(rng.randint(1, 3)):
            rows.append((f, d, rng.choice([0, 25, 50, 75, 100, 300]), rng.choice([0, 30, 60]), rng.choice([20, 60, 120])))
    return rows


@pytest.mark.parametrize("chunk", [3, 20, 64])
def test_unbroken_camera_in_chunks(spark, chunk):
    """Speculative chunks give the rows of one tracker over the whole camera, ids and distances included."""
    rows = crowded(random.Random(chunk), 500)
    t = V.Tracker()
    t.start()
    want = [tuple(o) for r in rows for o in t.row(*r)]
    df = spark.createDataFrame([(k, *r) for k in (1, 2) for r in rows], FACE)
    got = V.track_faces(df, chunk_frames=chunk).orderBy("frame_idx", "det_no")
    for k in (1, 2):
        mine = got.filter(F.col("camera_id") == k).collect()
        assert [(r.frame_idx, r.det_no, r.track_id, r.is_new, r.match_distance) for r in mine] == want


def test_wrong_guesses_are_tracked_again(spark, monkeypatch):
    """A face that stays out of sight of the warm-up frames: the chunk after must not take it for a new one."""
    runs = []
    monkeypatch.setattr(V, "stored", lambda df, name, real=V.stored: (runs.append(name), real(df, name))[1])
    # two faces alternate so that each is seen every tenth frame only; which one took a sighting depends on all before
    rows = [(f, 0, 0 if f % 2 else 50 * (f % 3), 0, 60) for f in range(1, 400)]
    t = V.Tracker()
    t.start()
    want = [o[2] for r in rows for o in t.row(*r)]
    assert tracked(spark, rows, chunk_frames=16, timeout=12) == want
    rows = crowded(random.Random(5), 400)
    t.start()
    want = [o[2] for r in rows for o in t.row(*r)]
    runs.clear()
    assert tracked(spark, rows, chunk_frames=8) == want
    assert 2 <= runs.count("tracked-chunks") < 12  # some guesses were wrong, and were set right in a few rounds


def test_an_unbroken_camera_runs_in_many_tasks(spark):
    df = spark.range(40_000).select(
        F.lit(1).cast("bigint").alias("camera_id"), (F.col("id") + 1).alias("frame_idx"), F.lit(0).alias("det_no"),
        (F.col("id") % 7).cast("int").alias("cx"), F.lit(0).alias("cy"), F.lit(60).alias("w"))
    out = V.track_faces(df, chunk_frames=512)
    assert out.agg(F.count("*"), F.count_distinct("track_id")).first() == (40_000, 1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions would share a task here
    tasks = V.fold_sorted(
        df.withColumn("chunk", F.expr("frame_idx div 512")), ["camera_id", "chunk"], ["frame_idx"], ["frame_idx"], _Task, "camera_id bigint, chunk bigint, part int")
    per = [r["n"] for r in tasks.groupBy("part").agg(F.count("*").alias("n")).collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(per) == 4 and max(per) < 40


class _Task(V.Rule):
    """The partition in which a group is handled."""

    def finish(self):
        from pyspark import TaskContext
        return [(TaskContext.get().partitionId(),)]


def test_tracking_nothing(spark):
    assert V.track_faces(spark.createDataFrame([], FACE)).count() == 0


TIMED = FACE + ", ear double, mouth_w_ratio double, mouth_open_ratio double, is_fake boolean, at timestamp"


def timed_row(camera, frame, cx, second=None, det=0):
    import datetime as dt
    at = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=frame if second is None else second)
    return (camera, frame, det, cx, 0, 60, 0.4, 0.1, 0.1, True, at)


def fed(spark, base, batches, make, schema=TIMED):
    """Run a stream once after each batch of rows; (rows written, state rows after each run)."""
    sizes = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = make(spark.readStream.schema(schema).parquet(f"{base}/in"))
        q = ST.write_events(stream, f"{base}/out", f"{base}/cp")
        q.awaitTermination()
        sizes.append(sum(o["numRowsTotal"] for o in q.lastProgress["stateOperators"]))
    return spark.read.schema(stream.schema).parquet(f"{base}/out").collect(), sizes


def test_frames_out_of_order_wait_for_the_watermark(spark):
    """Frames of 20 seconds in any order, over micro-batches, give the tracks of the ordered frames."""
    rng = random.Random(1)
    rows = [timed_row(c, f, 10 * ((f // 9) % 3) * 8) for c in (1, 2) for f in range(1, 120) if f % 40 < 25]
    late_by = sorted(rows, key=lambda r: r[1] + rng.random() * 18)
    cut = [late_by[i:i + 30] for i in range(0, len(late_by), 30)] + [[timed_row(9, 1, 0, second=400)]]
    got, sizes = fed(spark, shared_folder(spark, "order"), cut, lambda s: ST.track_timeout(s, "at", "20 seconds", "60 seconds"))
    want = []
    for c in (1, 2):
        t = V.Tracker()
        t.start()
        seen = {}
        for r in [r for r in rows if r[0] == c]:
            (f, _, track, _, _), = t.row(r[1], 0, r[3], 0, 60)
            seen.setdefault(track, []).append(f)
        want += [(c, track, f[0], f[-1], len(f)) for track, f in seen.items()]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 8
    # all of cameras 1 and 2 is gone; camera 9 has its value, its waiting frame and a timer, at most
    assert sizes[-1] <= 6 < max(sizes)


def test_state_does_not_grow_with_the_stream(spark):
    """Tracks come and go; the state holds the live ones only, and nothing of cameras that went away."""
    batches = [[timed_row(b, 100 * b + f, 100 * (f % 30)) for f in range(1, 90)] for b in range(1, 7)]
    got, sizes = fed(spark, shared_folder(spark, "grow"), batches, lambda s: ST.track_timeout(s, "at", "1 second", "30 seconds"))
    assert len({(r.camera_id, r.track_id) for r in got}) > 100
    assert max(sizes[1:]) <= 2 * min(sizes) and max(sizes) < 60


def test_time_to_live_without_event_time(spark):
    """Without an event time an absent camera's state goes by the clock; its tracks then start over."""
    import time
    base, schema = shared_folder(spark, "ttl"), TIMED.rpartition(",")[0]
    spark.createDataFrame([], schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
    events = ST.stream_tracks(spark.readStream.schema(schema).parquet(f"{base}/in"), forget="3 seconds")
    # by the clock, batches also run without rows, so the stream is watched by its output
    q = events.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp").trigger(
        processingTime="1 second").start()

    def feed(rows, n):
        spark.createDataFrame([r[:-1] for r in rows], schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        for _ in range(40):
            try:
                got = spark.read.schema(ST.EVENT_DDL).parquet(f"{base}/out").collect()
            except Exception:  # nothing has been written yet
                got = []
            if len(got) >= n:
                return got
            time.sleep(0.5)
        return got

    try:
        feed([timed_row(1, 100, 0), timed_row(1, 130, 300)], 2)
        time.sleep(4)
        got = feed([timed_row(1, 20, 0)], 3)  # late for a camera that is still known
    finally:
        q.stop()
    assert sorted((r.frame_idx, r.track_id) for r in got) == [(20, 0), (100, 0), (130, 1)]


def test_one_micro_batch_of_many_frames_in_any_order(spark):
    """Rows of a camera in one micro-batch, shuffled, in several Arrow batches."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        rows = [timed_row(1, f, 40 * ((f // 7) % 5)) for f in range(1, 700) if f % 50 < 30]
        random.Random(2).shuffle(rows)
        got, _ = fed(spark, shared_folder(spark, "any"), [rows], lambda s: ST.track_timeout(s))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    t = V.Tracker()
    t.start()
    seen, last = {}, max(r[1] for r in rows)
    for r in sorted(rows, key=lambda r: r[1]):
        (f, _, track, _, _), = t.row(r[1], 0, r[3], 0, 60)
        seen.setdefault(track, []).append(f)
    assert sorted(map(tuple, got)) == sorted((1, k, f[0], f[-1], len(f)) for k, f in seen.items() if last - f[-1] > 12)


def test_a_stream_of_one_file_uses_all_cores(spark, monkeypatch):
    """A batch read from one file of one row group is spread before it is classified."""
    from docketry.operators import classify as K

    base, seen, classify = shared_folder(spark, "wide"), [], K.classify
    monkeypatch.setattr(K, "classify", lambda batch, t: seen.append(batch.rdd.getNumPartitions()) or classify(batch, t))
    SD.stream_documents(X.scan_stream(spark, SF), f"{base}/out", f"{base}/cp").awaitTermination()
    assert seen == [spark.sparkContext.defaultParallelism]
