"""Face detections, tracks and events.

Counters that restart are runs of flags, so blinks, smiles and movement come from ordered scans that
split a hot track over many tasks.  Only nearest-track matching and the shared cool-down depend on
earlier decisions; both run over groups cut where their state is provably empty.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry import catalog as C
from docketry.functions import geometry as G
from docketry.operators.ordered import Rule, fold_sorted, ordered_scan
from docketry.sources.readers import stored

TRACK = ("camera_id", "track_id")
CHUNK_FRAMES = 4096


def frame_chunk(frame: str = "frame_idx", size: int = CHUNK_FRAMES) -> Column:
    return F.expr(f"{frame} div {size}")


# --- detections --------------------------------------------------------------------------------

def class_counts(objects: DataFrame, image: Sequence[str] = ("camera_id", "frame_idx")) -> DataFrame:
    """Detections per image and class."""
    return objects.groupBy(*image, "class_id", "class_name").agg(F.count("*").alias("n"))


def image_counts(objects: DataFrame, image: Sequence[str] = ("camera_id", "frame_idx")) -> DataFrame:
    """Detections and persons per image."""
    return objects.groupBy(*image).agg(
        F.count("*").alias("n_objects"), F.count_if(F.col("class_id") == C.PERSON_CLASS).alias("n_persons")
    )


def filter_detections(objects: DataFrame, min_conf: float = 0.25, classes: Sequence[int] | None = None) -> DataFrame:
    keep = F.col("conf") >= min_conf
    return objects.filter(keep & F.col("class_id").isin(*classes) if classes is not None else keep)


def rescale_boxes(objects: DataFrame, frame_w: int, frame_h: int, scale: float = C.FACE_SCALE) -> DataFrame:
    """Corner boxes of the small frame -> (x, y, w, h) in the full frame, truncated."""
    small_w, small_h = max(1, int(frame_w * scale)), max(1, int(frame_h * scale))

    def full(v: Column, small: int, whole: int) -> Column:
        return ((v / F.lit(float(small))) * whole).cast("int")

    return objects.withColumns(
        {
            "x": full(F.col("x1"), small_w, frame_w), "y": full(F.col("y1"), small_h, frame_h),
            "w": full(F.col("x2") - F.col("x1"), small_w, frame_w), "h": full(F.col("y2") - F.col("y1"), small_h, frame_h),
        }
    )


def screen_frame(frame: Column, every: int = C.SCREEN_EVERY) -> Column:
    """The frame whose screens are in force: the last multiple of ``every``; before the first there are none."""
    return frame - frame % every


def carry_forward(frames: DataFrame, screens: DataFrame, every: int = C.SCREEN_EVERY) -> DataFrame:
    """Screens in force on every frame: (camera_id, frame_idx, x, y, w, h).  An empty detection also replaces."""
    seen = screens.filter(F.col("frame_idx") % every == 0).select(
        "camera_id", F.col("frame_idx").alias("_at"), "obj_no", "x", "y", "w", "h"
    )
    keyed = frames.withColumn("_at", screen_frame(F.col("frame_idx"), every))
    return keyed.join(seen, ["camera_id", "_at"]).drop("_at")


def screen_containment(faces: DataFrame, screens: DataFrame, every: int = C.SCREEN_EVERY) -> DataFrame:
    """Adds ``is_fake``: the face box lies fully inside a screen in force on its frame."""
    seen = screens.filter(F.col("frame_idx") % every == 0).select(
        "camera_id", F.col("frame_idx").alias("_at"), *[F.col(c).alias(f"s_{c}") for c in ("x", "y", "w", "h")]
    )
    box = lambda p: tuple(F.col(f"{p}{c}") for c in ("x", "y", "w", "h"))
    keyed = faces.withColumn("_at", screen_frame(F.col("frame_idx"), every))
    hits = keyed.join(seen, ["camera_id", "_at"]).filter(G.contains(box("s_"), box("")))
    ids = ["camera_id", "frame_idx", "det_no"]
    flags = hits.groupBy(*ids).agg(F.lit(True).alias("_in"))
    return faces.join(flags, ids, "left").withColumn("is_fake", F.coalesce("_in", F.lit(False))).drop("_in")


def size_fake(faces: DataFrame, share: float = C.FAKE_WIDTH_SHARE) -> DataFrame:
    """Adds ``is_fake``: narrower than a share of the frame's widest face (a frame holds a few faces)."""
    widest = F.max("w").over(Window.partitionBy("camera_id", "frame_idx"))
    return faces.withColumn("is_fake", (widest > 0) & (F.col("w") < widest * F.lit(share)))


# --- tracking ----------------------------------------------------------------------------------

class Tracker(Rule):
    """Nearest-centre matching, one detection at a time, frames in order.

    Each detection takes the nearest known track within reach, the first on ties; a track found again
    moves at once, so a second detection of the frame sees its new place.  Tracks born in a frame are
    matched from the next frame on.  A track lives ``timeout`` frames unseen and can still be matched on
    the following one, since matching comes before forgetting.
    """

    def __init__(self, factor: float = 0.6, floor: int = 20, timeout: int = C.TRACK_TIMEOUT):
        self.factor, self.floor, self.timeout = factor, floor, timeout

    def start(self):
        self.tracks, self.next_id, self.frame, self.touched = [], 0, None, {}

    def end_frame(self):
        """Order tracks as the next frame will try them: this frame's in order of detection, then the others."""
        if self.touched:
            self.tracks = list(self.touched.values()) + [t for t in self.tracks if t[0] not in self.touched]
            self.touched = {}

    def row(self, frame, det, cx, cy, w):
        if frame != self.frame:
            self.end_frame()
            self.tracks = [t for t in self.tracks if frame - 1 - t[3] <= self.timeout]
            self.frame = frame
        reach = max(self.floor, w * self.factor)
        best, best_d = None, None
        for t in self.tracks:
            d = math.hypot(t[1] - cx, t[2] - cy)
            if d <= reach and (best_d is None or d < best_d):
                best, best_d = t, d
        born = best is None
        if born:
            best = [self.next_id, cx, cy, frame]
            self.next_id += 1
        else:
            best[1], best[2], best[3] = cx, cy, frame
        self.touched.setdefault(best[0], best)
        return [(frame, det, best[0], born, best_d)]


SEED, WARM, REAL = range(3)
_PLACED = ("camera_id bigint, chunk bigint, frame_idx bigint, det_no int, ref bigint, is_new boolean, match_distance double, "
           "before array<struct<cx:int,cy:int,seen:bigint>>, after array<struct<cx:int,cy:int,seen:bigint,ref:bigint>>")


class _TrackChunk(Rule):
    """Tracks one chunk of a camera from a state that is given (SEED rows) or guessed from the frames before it (WARM rows).

    A track the chunk starts with is called -1 - its place, one born in it by its number, so decisions need no ids from
    elsewhere.  The last output row (``det_no`` -1) holds the state assumed before the chunk's first frame, the state after
    its last one, and the number of births.
    """

    def __init__(self, factor: float, floor: int, timeout: int):
        self.tracker = Tracker(factor, floor, timeout)

    def start(self):
        self.tracker.start()
        self.first = None

    def row(self, kind, frame, det, cx, cy, w):
        t = self.tracker
        if kind == SEED:
            t.tracks.append([0, cx, cy, frame])
            return ()
        if kind == REAL and self.first is None:
            t.end_frame()
            t.tracks = [[-1 - i, *x[1:]] for i, x in enumerate(x for x in t.tracks if frame - 1 - x[3] <= t.timeout)]
            self.before = [{"cx": x[1], "cy": x[2], "seen": x[3]} for x in t.tracks]
            self.first, t.next_id = frame, 0
        (_, _, ref, born, distance), = t.row(frame, det, cx, cy, w)
        return [(frame, det, ref, born, distance, None, None)] if kind == REAL else ()

    def finish(self):
        if self.first is None:
            return []
        self.tracker.end_frame()
        after = [{"cx": x[1], "cy": x[2], "seen": x[3], "ref": x[0]} for x in self.tracker.tracks]
        return [(self.first, -1, self.tracker.next_id, False, None, self.before, after)]


class _ChunkIds(Rule):
    """Ids of the tracks each chunk of a camera starts with, and the first id born in it."""

    def __init__(self, timeout: int):
        self.timeout = timeout

    def start(self):
        self.born, self.last = 0, []

    def row(self, chunk, first, births, seen, refs):
        slots = [i for i, s in self.last if first - 1 - s <= self.timeout]
        self.last = [(self.born + r if r >= 0 else slots[-1 - r], s) for r, s in zip(refs, seen)]
        out = [(chunk, self.born, slots)]
        self.born += births
        return out


def _expected(timeout: int) -> Column:
    """What a chunk should have started from: the state its camera's chunk before ended with, but for what had timed out."""
    last = F.lag("after").over(Window.partitionBy("camera_id").orderBy("chunk"))
    alive = F.filter(last, lambda t: F.col("frame_idx") - 1 - t["seen"] <= timeout)
    states = F.transform(alive, lambda t: F.struct(t["cx"], t["cy"], t["seen"]))
    return F.coalesce(states, F.array().cast("array<struct<cx:int,cy:int,seen:bigint>>"))


def track_faces(
    faces: DataFrame, factor: float = 0.6, floor: int = 20, timeout: int = C.TRACK_TIMEOUT, chunk_frames: int = CHUNK_FRAMES
) -> DataFrame:
    """Adds ``track_id``, ``is_new`` and ``match_distance`` to detections.

    A camera is tracked in chunks of ``chunk_frames`` frames, all at once.  A chunk starts from a guess, the state that the
    frames before it (twice as many as a track survives unseen) lead to from nothing.  What tracks are there and where
    decides everything else, so if the guess is the state in which the chunk before ended, the chunk is right.  Chunks with
    a wrong guess are tracked again from the state they should have had, until none is left; every round settles at least
    the first of them, and usually all.  Then ids follow from the chunks' numbers of births, one small row a chunk.
    """
    rows = faces.select("camera_id", "frame_idx", "det_no", "cx", "cy", "w")
    reach = 2 * (timeout + 2)
    at = F.expr(f"frame_idx div {chunk_frames}")
    later = F.expr(f"sequence(frame_idx div {chunk_frames}, (frame_idx + {reach}) div {chunk_frames})")
    order, inputs = ["step", "det_no"], ["kind", "frame_idx", "det_no", "cx", "cy", "w"]

    def run(df: DataFrame, name: str) -> DataFrame:
        df = df.withColumn("step", F.when(F.col("kind") != SEED, F.col("frame_idx")))  # null, so before all frames, for a seed
        return stored(fold_sorted(df, ["camera_id", "chunk"], order, inputs, lambda: _TrackChunk(factor, floor, timeout), _PLACED), name)

    warm = rows.select("*", F.explode(later).alias("chunk")).withColumn("kind", F.when(F.col("chunk") == at, REAL).otherwise(WARM))
    placed = [run(warm, "tracked-chunks")]
    ends = placed[0].filter("det_no = -1")
    while True:
        judged = ends.withColumn("due", _expected(timeout))
        wrong = stored(judged.filter("NOT (before <=> due)").select("camera_id", "chunk", "due"), "wrong-starts")
        if wrong.isEmpty():
            break
        # a state's order is that in which its tracks are tried
        seeds = wrong.select("camera_id", "chunk", F.posexplode("due").alias("det_no", "t")).select(
            "camera_id", F.col("t.seen").alias("frame_idx"), "det_no", "t.cx", "t.cy", F.lit(0).alias("w"), "chunk", F.lit(SEED).alias("kind"))
        again = rows.withColumn("chunk", at).join(wrong.select("camera_id", "chunk"), ["camera_id", "chunk"], "left_semi")
        again = again.select("camera_id", "frame_idx", "det_no", "cx", "cy", "w", "chunk", F.lit(REAL).alias("kind"))
        keys = wrong.select("camera_id", "chunk")
        placed = [p.join(keys, ["camera_id", "chunk"], "left_anti") for p in placed]
        placed.append(run(again.unionByName(seeds), "tracked-chunks"))
        ends = ends.join(keys, ["camera_id", "chunk"], "left_anti").unionByName(placed[-1].filter("det_no = -1"))
    ids = fold_sorted(
        ends.select("camera_id", "chunk", F.col("frame_idx").alias("first"), F.col("ref").alias("births"), "after.seen", F.col("after.ref").alias("refs")),
        ["camera_id"], ["chunk"], ["chunk", "first", "births", "seen", "refs"], lambda: _ChunkIds(timeout),
        "camera_id bigint, chunk bigint, born bigint, slots array<bigint>")
    every = placed[0]
    for more in placed[1:]:
        every = every.unionByName(more)
    every = every.filter("det_no >= 0").join(stored(ids, "chunk-ids"), ["camera_id", "chunk"]).select(
        "camera_id", "frame_idx", "det_no",
        F.when(F.col("ref") >= 0, F.col("born") + F.col("ref")).otherwise(F.get("slots", (-1 - F.col("ref")).cast("int"))).alias("track_id"),
        "is_new", "match_distance")
    return faces.join(every, ["camera_id", "frame_idx", "det_no"])


def nearest_candidates(faces: DataFrame, factor: float = 0.6, floor: int = 20) -> DataFrame:
    """Each detection's nearest detection of the frame before, if within reach."""
    now = faces.select("camera_id", "frame_idx", "det_no", "cx", "cy", "w")
    before = faces.select(
        "camera_id", (F.col("frame_idx") + 1).alias("frame_idx"), F.col("det_no").alias("prev_det_no"),
        F.col("cx").alias("p_cx"), F.col("cy").alias("p_cy"),
    )
    d = F.hypot((F.col("cx") - F.col("p_cx")).cast("double"), (F.col("cy") - F.col("p_cy")).cast("double"))
    pairs = now.join(before, ["camera_id", "frame_idx"]).withColumn("distance", d)
    pairs = pairs.filter(F.col("distance") <= F.greatest(F.lit(float(floor)), F.col("w") * F.lit(factor)))
    best = F.min(F.struct("distance", "prev_det_no")).alias("b")
    return pairs.groupBy("camera_id", "frame_idx", "det_no").agg(best).select(
        "camera_id", "frame_idx", "det_no", "b.prev_det_no", "b.distance"
    )


def carry_stale(tracked: DataFrame, timeout: int = C.TRACK_TIMEOUT) -> DataFrame:
    """Adds the rows a tracker that keeps analysing lost faces would see (``stale`` = true).

    After a track's last sighting its data repeat on the following ``timeout`` frames of the camera, or
    until it is seen again.  Input: camera_id, track_id, frame_idx and feature columns.
    """
    feats = [c for c in tracked.columns if c not in {*TRACK, "frame_idx"}]
    scan = ordered_scan(tracked, TRACK, ["frame_idx"], frame_chunk(), prev=["frame_idx", *feats]).drop("row_no")
    gap_end = F.least(F.col("frame_idx") - 1, F.col("prev_frame_idx") + timeout)
    between = scan.filter(F.col("frame_idx") > F.col("prev_frame_idx") + 1).select(
        *TRACK, F.explode(F.sequence(F.col("prev_frame_idx") + 1, gap_end)).alias("frame_idx"),
        *[F.col(f"prev_{c}").alias(c) for c in feats],
    )
    last = tracked.groupBy(*TRACK).agg(F.max_by(F.struct("frame_idx", *feats), "frame_idx").alias("l"))
    ends = tracked.groupBy("camera_id").agg(F.max("frame_idx").alias("_end"))
    tail = last.join(ends, "camera_id").filter(F.col("_end") > F.col("l.frame_idx"))
    tail = tail.select(
        *TRACK,
        F.explode(F.sequence(F.col("l.frame_idx") + 1, F.least("_end", F.col("l.frame_idx") + timeout))).alias("frame_idx"),
        *[F.col(f"l.{c}").alias(c) for c in feats],
    )
    seen = tracked.select(*TRACK, "frame_idx", *feats).withColumn("stale", F.lit(False))
    return seen.unionByName(between.unionByName(tail).withColumn("stale", F.lit(True)))


# --- events ------------------------------------------------------------------------------------

def _scan(frames: DataFrame, chunk_frames: int = CHUNK_FRAMES, **what) -> DataFrame:
    return ordered_scan(frames, TRACK, ["frame_idx"], frame_chunk(size=chunk_frames), **what)


def is_closed(threshold: float = C.EAR_THRESHOLD) -> Column:
    return F.col("ear") < threshold


def is_smiling(
    width_ratio: float = C.SMILE_WIDTH_RATIO, open_ratio: float = C.SMILE_OPEN_RATIO,
    small_width: int | None = C.SMALL_FACE_WIDTH, small_share: float = C.SMALL_FACE_MOUTH_SHARE, fake: Column | None = None,
) -> Column:
    """Wide and nearly closed mouth; small faces are judged in pixels.  ``fake`` relaxes both widths."""
    ratio, share = F.lit(width_ratio), F.lit(small_share)
    if fake is not None:
        ratio = F.when(fake, F.lit(width_ratio * 0.90)).otherwise(ratio)
        share = F.when(fake, F.lit(small_share * 0.85)).otherwise(share)
    wide = F.col("mouth_w_ratio") >= ratio
    if small_width is not None:
        need = F.greatest(F.lit(14), (F.col("bw") * share).cast("int"))
        pixels = F.col("mouth_w_ratio") * (F.col("bw") + F.lit(1e-6))
        wide = F.when(F.col("bw") < small_width, pixels >= need).otherwise(wide)
    return wide & (F.col("mouth_open_ratio") < open_ratio)


def has_moved(ratio: float = C.MOVE_RATIO) -> Column:
    """Needs prev_cx and prev_cy."""
    return F.coalesce(_shift() > F.col("bw") * F.lit(ratio), F.lit(False))


def _shift() -> Column:
    return F.hypot((F.col("cx") - F.col("prev_cx")).cast("double"), (F.col("cy") - F.col("prev_cy")).cast("double"))


def blink_events(frames: DataFrame, threshold: float = C.EAR_THRESHOLD, needed: int = C.EAR_FRAMES, moved: str | None = None,
                 chunk_frames: int = CHUNK_FRAMES) -> DataFrame:
    """(camera_id, track_id, frame_idx, run_length): the open-eye frame that ends a long enough closure.

    ``moved`` names a boolean column that suppresses blinks on its frames.
    """
    cols = [*TRACK, "frame_idx", is_closed(threshold).alias("closed"), *([moved] if moved else [])]
    df = _scan(frames.select(*cols), chunk_frames, runs={"closed": F.col("closed")})
    hit = (F.col("closed_pos") == 0) & (F.col("closed_before") >= needed)
    if moved:
        hit = hit & ~F.col(moved)
    return df.filter(hit).select(*TRACK, "frame_idx", F.col("closed_before").alias("run_length"))


def blink_counts(frames: DataFrame, events: DataFrame, chunk_frames: int = CHUNK_FRAMES) -> DataFrame:
    """Running number of blinks of a track on every frame."""
    marked = frames.select(*TRACK, "frame_idx").join(
        events.select(*TRACK, "frame_idx", F.lit(True).alias("_b")), [*TRACK, "frame_idx"], "left"
    )
    return _scan(marked, chunk_frames, counts={"blink_count": F.col("_b")}).select(*TRACK, "frame_idx", "blink_count")


def smile_events(frames: DataFrame, smiling: Column | None = None, needed: int = C.SMILE_FRAMES, chunk_frames: int = CHUNK_FRAMES) -> DataFrame:
    """Every ``needed``-th frame of a smile: the counter restarts after each event."""
    flag = is_smiling() if smiling is None else smiling
    df = _scan(frames.select(*TRACK, "frame_idx", flag.alias("smile")), chunk_frames, runs={"smile": F.col("smile")})
    return df.filter((F.col("smile_pos") > 0) & (F.col("smile_pos") % needed == 0)).select(*TRACK, "frame_idx", "smile_pos")


def motion_events(frames: DataFrame, ratio: float = C.MOVE_RATIO, chunk_frames: int = CHUNK_FRAMES) -> DataFrame:
    """Frames on which the centre moved more than a share of the face width."""
    df = _scan(frames.select(*TRACK, "frame_idx", "cx", "cy", "bw"), chunk_frames, prev=["cx", "cy"])
    return df.filter(has_moved(ratio)).select(*TRACK, "frame_idx", _shift().alias("distance"))


def frames_needed(base: int, reference: float, low: int, high: int, width: str = "bw") -> Column:
    """Frames a signal must last, more for smaller faces."""
    n = F.bround(F.lit(base) * (F.lit(reference) / F.greatest(F.col(width), F.lit(20))))
    return F.least(F.greatest(n.cast("int"), F.lit(low)), F.lit(high))


class _Adaptive(Rule):
    """Counts frames; an event when the count reaches the frame's own need, then from zero again."""

    def start(self):
        self.count = 0

    def row(self, frame, needed):
        self.count += 1
        if self.count >= needed:
            self.count = 0
            return [(frame,)]
        return ()


_RUN_DDL = "camera_id bigint, track_id bigint, run_start bigint, frame_idx bigint"


def adaptive_events(frames: DataFrame, flag: Column, needed: Column, chunk_frames: int = CHUNK_FRAMES) -> DataFrame:
    """Events of a flag that must last as many frames as each frame's width asks for.

    A frame without the flag resets the count, so each run of flagged frames is folded on its own.
    """
    df = frames.select(*TRACK, "frame_idx", needed.alias("_need"), flag.alias("on"))
    df = _scan(df, chunk_frames, runs={"on": F.col("on")}).filter(F.col("on_pos") > 0)
    df = df.withColumn("run_start", F.col("row_no") - F.col("on_pos"))
    out = fold_sorted(df, [*TRACK, "run_start"], ["frame_idx"], ["frame_idx", "_need"], _Adaptive, _RUN_DDL)
    return out.drop("run_start")


def blink_adaptive(frames: DataFrame, no_eyes: Column, base: int = 5, reference: float = 250.0) -> DataFrame:
    return adaptive_events(frames, no_eyes, frames_needed(base, reference, 2, 10))


def smile_adaptive(frames: DataFrame, wide_smile: Column, base: int = 5, reference: float = 250.0) -> DataFrame:
    return adaptive_events(frames, wide_smile, frames_needed(base, reference, 2, 8))


class _SmileWithTeeth(Rule):
    """A frame that does not smile clears the count; visible teeth add one when the count is short."""

    def __init__(self, needed):
        self.needed = needed

    def start(self):
        self.count = 0

    def row(self, frame, smiling, teeth):
        self.count = self.count + 1 if smiling else 0
        if self.count < self.needed and teeth:
            self.count += 1
        if self.count >= self.needed:
            self.count = 0
            return [(frame,)]
        return ()


def smile_events_teeth(frames: DataFrame, teeth: Column, fake: Column, needed: int = C.SMILE_FRAMES, every: int = 4,
                       chunk_frames: int = CHUNK_FRAMES) -> DataFrame:
    """Smiles with relaxed widths for fake faces and a teeth check every fourth frame.

    Each frame that does not smile starts from zero, so a group is one such frame and the smiles after it.
    """
    smiling = F.coalesce(is_smiling(0.45, 0.28, fake=fake), F.lit(False))
    check = F.coalesce(teeth, F.lit(False)) & (F.col("frame_idx") % every == 0)
    df = frames.select(*TRACK, "frame_idx", smiling.alias("_s"), check.alias("_t"))
    df = _scan(df, chunk_frames, counts={"run_start": ~F.col("_s")})
    out = fold_sorted(
        df, [*TRACK, "run_start"], ["frame_idx"], ["frame_idx", "_s", "_t"], lambda: _SmileWithTeeth(needed), _RUN_DDL
    )
    return out.drop("run_start")


class _Cooldown(Rule):
    """Keeps an event when more than ``gap`` frames lie since the last kept one."""

    def __init__(self, gap, blocked_start):
        self.gap, self.blocked_start = gap, blocked_start

    def start(self):
        self.last = None

    def row(self, frame, kind):
        if self.last is None:
            # before any event the last one counts as frame 0
            ok = not self.blocked_start or frame > self.gap
        else:
            ok = frame - self.last > self.gap
        if ok:
            self.last = frame
            return [(frame, kind)]
        return ()


def cooldown(events: DataFrame, gap: int = C.COOLDOWN_FRAMES, blocked_start: bool = True, chunk_frames: int = CHUNK_FRAMES) -> DataFrame:
    """Thin a track's events (camera_id, track_id, frame_idx, event_kind), one per frame, all kinds sharing the gap.

    An event more than ``gap`` frames after its predecessor is kept whatever was kept before, so tracks
    are cut there and the pieces are thinned independently.
    """
    apart = lambda last, now: now["frame_idx"] - last["frame_idx"] > gap
    df = _scan(events.select(*TRACK, "frame_idx", "event_kind"), chunk_frames, breaks={"piece": apart})
    # a piece after the first starts beyond the gap, so the same rule fits every piece
    out = fold_sorted(
        df, [*TRACK, "piece"], ["frame_idx"], ["frame_idx", "event_kind"], lambda: _Cooldown(gap, blocked_start),
        "camera_id bigint, track_id bigint, piece bigint, frame_idx bigint, event_kind string",
    )
    return out.drop("piece")


def event_candidates(frames: DataFrame, chunk_frames: int = CHUNK_FRAMES) -> DataFrame:
    """Frames on which something may be reported, with the kind that would be.

    Counters run on regardless of what is reported, so candidates do not depend on the cool-down.  On one
    frame a fake face comes first, then a smile, then movement, which hides a blink.
    Input: camera_id, track_id, frame_idx, ear, cx, cy, bw, mouth_w_ratio, mouth_open_ratio, is_fake.
    """
    df = frames.select(
        *TRACK, "frame_idx", "cx", "cy", "bw", "is_fake", is_closed().alias("closed"), is_smiling().alias("smile")
    )
    df = _scan(df, chunk_frames, prev=["cx", "cy"], runs={"closed": F.col("closed"), "smile": F.col("smile")})
    blink = (F.col("closed_pos") == 0) & (F.col("closed_before") >= C.EAR_FRAMES)
    smile = (F.col("smile_pos") > 0) & (F.col("smile_pos") % C.SMILE_FRAMES == 0)
    kind = (
        F.when(F.col("is_fake"), "fake_face").when(smile, F.lit("smile")).when(has_moved(), "motion").when(blink, "blink")
    )
    return df.withColumns({"event_kind": kind, "is_blink": blink, "is_move": has_moved()}).filter("event_kind IS NOT NULL")


def fused_events(
    frames: DataFrame, gap: int = C.COOLDOWN_FRAMES, chunk_frames: int = CHUNK_FRAMES
) -> DataFrame:
    """Reported events of all kinds under the shared cool-down: (camera_id, track_id, frame_idx, event_kind)."""
    found = event_candidates(frames, chunk_frames).select(*TRACK, "frame_idx", "event_kind")
    return cooldown(found, gap, True, chunk_frames)


def coupled_blinks(frames: DataFrame, gap: int = C.COOLDOWN_FRAMES, chunk_frames: int = CHUNK_FRAMES) -> DataFrame:
    """Blinks that count, reported or not: (camera_id, track_id, frame_idx).

    Movement hides a blink only on a frame where the cool-down would let the movement through; that is a frame whose kept
    event is the movement itself or a smile.  A fake face reported first keeps movement back.
    """
    found = event_candidates(frames, chunk_frames)
    return _hidden_blinks_out(found, cooldown(found.select(*TRACK, "frame_idx", "event_kind"), gap, True, chunk_frames))


def _hidden_blinks_out(found: DataFrame, kept: DataFrame) -> DataFrame:
    """Blinks among the candidates ``found``, without those on frames where ``kept`` events let a movement through."""
    kept = kept.filter(F.col("event_kind").isin("motion", "smile")).select(*TRACK, "frame_idx", F.lit(True).alias("_through"))
    rows = found.filter("is_blink").select(*TRACK, "frame_idx", "is_move").join(kept, [*TRACK, "frame_idx"], "left")
    return rows.filter(~(F.col("is_move") & F.coalesce("_through", F.lit(False)))).select(*TRACK, "frame_idx")


def events_and_blinks(frames: DataFrame, gap: int = C.COOLDOWN_FRAMES, chunk_frames: int = CHUNK_FRAMES) -> tuple[DataFrame, DataFrame]:
    """(``fused_events``, ``coupled_blinks``) from one pass over the frames: candidates and kept events are stored."""
    found = stored(
        event_candidates(frames, chunk_frames).select(*TRACK, "frame_idx", "event_kind", "is_blink", "is_move"), "event-candidates")
    kept = stored(cooldown(found.select(*TRACK, "frame_idx", "event_kind"), gap, True, chunk_frames), "kept-events")
    return kept, _hidden_blinks_out(found, kept)


def smile_label(teeth: Column, squint: Column) -> Column:
    """Visible teeth are real; hidden teeth with squinting eyes are fake; anything else is real."""
    return F.when(teeth, "REAL_SMILE").when(squint, "FAKE_SMILE").otherwise("REAL_SMILE")


def smile_label_by_face(is_fake: Column) -> Column:
    return F.when(is_fake, "FAKE_SMILE").otherwise("REAL_SMILE")


def teeth_flag(bright: Column, total: Column, share: float = C.TEETH_SHARE) -> Column:
    return F.coalesce(F.when(total > 0, bright / total).otherwise(F.lit(0.0)) >= share, F.lit(False))


def route_events(events: DataFrame) -> DataFrame:
    """One row per destination: an event's own kind, labelled smiles also under ``smile``."""
    also = F.when(F.col("event_kind").isin("REAL_SMILE", "FAKE_SMILE"), F.array("event_kind", F.lit("smile")))
    return events.withColumn("event_kind", F.explode(F.coalesce(also, F.array("event_kind"))))


def track_summary(frames: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """One row per track: life span, frames seen, events of each kind, share of fake frames, and all blinks that count.

    Events that are not given are found in the same pass as the blinks.
    """
    blinks = None
    if events is None:
        events, blinks = events_and_blinks(frames)
    seen = frames.groupBy(*TRACK).agg(
        F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"), F.count("*").alias("n_frames"),
        F.avg(F.col("is_fake").cast("double")).alias("fake_share"),
    )
    kinds = events.groupBy(*TRACK).agg(
        *[F.count_if(F.col("event_kind") == k).alias(f"n_{k}") for k in ("blink", "smile", "motion", "fake_face")]
    )
    blinks = coupled_blinks(frames) if blinks is None else blinks
    blinks = blinks.groupBy(*TRACK).agg(F.count("*").alias("_blinks"))
    zero = F.lit(0).cast("bigint")
    return seen.join(kinds, list(TRACK), "left").join(blinks, list(TRACK), "left").select(
        *TRACK, "first_frame", "last_frame", "n_frames", "fake_share", F.coalesce("_blinks", zero).alias("blink_count"),
        *[F.coalesce(f"n_{k}", zero).alias(f"n_{k}") for k in ("blink", "smile", "motion", "fake_face")],
    )
