"""Face tracking and events over a stream of detections, one keyed state per camera.

A camera's state is a map from track to its place, last frame and counters, a small value (next id, last frame handled), and
a map of the frames that still wait, in blocks.  A micro-batch's rows may come in any order: they first go to the waiting
frames, batch by batch, and are then handled frame by frame, so a task never holds a camera's micro-batch.

Without an event time, all frames of a micro-batch are handled with it; a frame not newer than the last one handled is late
and dropped.  With one, a frame waits in the state until the watermark has passed it, so frames may also come in any order
within the lateness allowed.

State goes in three ways.  A track that has not been seen for ``timeout`` frames of its camera is removed.  A camera of which
no frame came for ``forget`` loses all its state: with an event time by a timer behind the watermark, otherwise by a time to
live.  It is a new camera after that, and its track numbers start over.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from docketry import catalog as C
from docketry.operators.tracks import Tracker

EVENT_DDL = "camera_id bigint, track_id bigint, frame_idx bigint, event_kind string"
END_DDL = "camera_id bigint, track_id bigint, first_frame bigint, last_frame bigint, n_seen bigint"
#: Frames of a camera that wait together in one value of the state.
BLOCK = 256
_FEATURES = ("closed", "smile", "px", "py", "saved", "first", "seen")
_TRACK = "cx bigint, cy bigint, frame bigint, place int, " + ", ".join(f"{f} bigint" for f in _FEATURES)
_FACE = {"frame_idx": "bigint", "ms": "bigint", "det_no": "bigint", "cx": "bigint", "cy": "bigint", "w": "bigint", "ear": "double",
         "mouth_w_ratio": "double", "mouth_open_ratio": "double", "is_fake": "boolean"}
_BLOCK = ", ".join(f"{k} array<{v}>" for k, v in _FACE.items())


def track_frame(feat: dict, frame: int, face: dict) -> str | None:
    """Update one track's counters with its face on one frame; the kind of event to report, if any."""
    bw, width, gap = face["w"], face["mouth_w_ratio"], face["mouth_open_ratio"]
    px, py = feat.get("px"), feat.get("py")
    moved = px is not None and math.hypot(face["cx"] - px, face["cy"] - py) > bw * C.MOVE_RATIO
    closed = feat.get("closed") or 0
    blink = face["ear"] >= C.EAR_THRESHOLD and closed >= C.EAR_FRAMES
    feat["closed"] = closed + 1 if face["ear"] < C.EAR_THRESHOLD else 0
    if bw < C.SMALL_FACE_WIDTH:
        wide = width * (bw + 1e-6) >= max(14, int(bw * C.SMALL_FACE_MOUTH_SHARE))
    else:
        wide = width >= C.SMILE_WIDTH_RATIO
    count = (feat.get("smile") or 0) + 1 if wide and gap < C.SMILE_OPEN_RATIO else 0
    smile = count >= C.SMILE_FRAMES
    feat["smile"] = 0 if smile else count
    feat["px"], feat["py"] = face["cx"], face["cy"]
    kind = "fake_face" if face["is_fake"] else "smile" if smile else "motion" if moved else "blink" if blink else None
    if kind is None or frame - (feat.get("saved") or 0) <= C.COOLDOWN_FRAMES:
        return None
    feat["saved"] = frame
    return kind


class FaceEvents(StatefulProcessor):
    """Detections of one camera -> reported events, or the tracks that were forgotten (``ends``)."""

    def __init__(self, timed: bool, forget_ms: int | None, ends: bool, timeout: int):
        self.timed, self.forget_ms, self.ends, self.timeout = timed, forget_ms, ends, timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        live = None if self.timed else self.forget_ms
        self.handle = handle
        self.camera = handle.getValueState("camera", "next_id bigint, frame bigint, ms bigint, timer bigint", live)
        self.tracks = handle.getMapState("tracks", "track_id bigint", _TRACK, live)
        self.waiting = handle.getMapState("waiting", "block bigint", _BLOCK, live)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self._camera()
        for batch in rows:
            batch = batch[batch["frame_idx"] > state["frame"]]
            for block, part in batch.groupby(batch["frame_idx"] // BLOCK):
                held = self._held(int(block))
                for name, values in zip(_FACE, held):
                    values.extend(part[name].tolist())
                self.waiting.updateValue((int(block),), tuple(held))
        yield from self._work(key, state, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self._camera()
        if state["timer"] == expiredTimerInfo.getExpiryTimeInMs():
            state["timer"] = None
        yield from self._work(key, state, timerValues)

    def close(self) -> None:
        pass

    def _camera(self) -> dict:
        if not self.camera.exists():
            return {"next_id": 0, "frame": -1, "ms": -1, "timer": None}
        return dict(zip(("next_id", "frame", "ms", "timer"), self.camera.get()))

    def _held(self, block: int) -> list[list]:
        if not self.waiting.containsKey((block,)):
            return [[] for _ in _FACE]
        return [list(v) for v in self.waiting.getValue((block,))]

    def _work(self, key, state: dict, timerValues) -> Iterator[pd.DataFrame]:
        """Handle the frames that need not wait any longer, one by one; then see to the next timer, or forget the camera."""
        now = timerValues.getCurrentWatermarkInMs() if self.timed else None
        tracker = Tracker(timeout=self.timeout)
        tracker.start()
        feats, known = {}, {}
        for (track,), value in self.tracks.iterator():
            known[track] = tuple(value)
            feats[track] = dict(zip(_FEATURES, value[4:]), last=value[2])
        tracker.tracks = [[t, *v[:3]] for t, v in sorted(known.items(), key=lambda x: x[1][3])]
        tracker.next_id, tracker.frame = state["next_id"], state["frame"]
        out, least = [], None
        for block in sorted(k[0] for k in self.waiting.keys()):
            held = self._held(block)
            order = sorted(range(len(held[0])), key=lambda i: (held[0][i], held[2][i]))
            done, at = 0, 0
            while at < len(order):
                end = at
                while end < len(order) and held[0][order[end]] == held[0][order[at]]:
                    end += 1
                faces = [{n: held[k][i] for k, n in enumerate(_FACE)} for i in order[at:end]]
                if now is not None and max(f["ms"] for f in faces) > now:
                    break
                out += self._frame(key, tracker, feats, state, faces)
                done = at = end
            if done == len(order):
                self.waiting.removeKey((block,))
                continue
            least = min(held[1][i] for i in order[done:])
            if done:
                self.waiting.updateValue((block,), tuple([v[i] for i in order[done:]] for v in held))
            break  # later frames wait behind this one
        places = {t[0]: (*t[1:4], n) for n, t in enumerate(tracker.tracks) if t[0] in feats}
        if self.timed and least is None and state["ms"] >= 0 and self.forget_ms is not None and state["ms"] + self.forget_ms <= now:
            out += [self._end(key, t, feats[t]) for t in places]
            self._forget(state)
        else:
            for track in known.keys() - places.keys():
                self.tracks.removeKey((track,))
            for track, place in places.items():
                value = (*place, *(feats[track].get(f) for f in _FEATURES))
                if known.get(track) != value:
                    self.tracks.updateValue((track,), value)
            self._set_timer(state, least)
            self.camera.update((tracker.next_id, state["frame"], state["ms"], state["timer"]))
        out = [o for o in out if (len(o) == 5) == self.ends]
        if out:
            names = [f.split()[0] for f in (END_DDL if self.ends else EVENT_DDL).split(", ")]
            yield pd.DataFrame(out, columns=names)

    def _frame(self, key, tracker: Tracker, feats: dict, state: dict, faces: list[dict]) -> list[tuple]:
        """Events of one frame, and the tracks it makes obsolete."""
        frame, at, out = int(faces[0]["frame_idx"]), {}, []
        if frame <= state["frame"]:
            return out
        for face in faces:
            (_, _, track, _, _), = tracker.row(frame, face["det_no"], int(face["cx"]), int(face["cy"]), int(face["w"]))
            at[track] = face  # two faces on one track: the later one counts
            feat = feats.setdefault(track, {"first": frame, "seen": 0})
            feat["seen"], feat["last"] = feat["seen"] + 1, frame
        for track, face in at.items():
            kind = track_frame(feats[track], frame, face)
            if kind:
                out.append((key[0], track, frame, kind))
        state["frame"], state["ms"] = frame, max([state["ms"], *(f["ms"] or 0 for f in faces)])
        tracker.end_frame()
        for track in [t for t, feat in feats.items() if frame - feat["last"] > tracker.timeout]:
            out.append(self._end(key, track, feats.pop(track)))
        return out

    def _end(self, key, track: int, feat: dict) -> tuple:
        return key[0], track, feat["first"], feat["last"], feat["seen"]

    def _set_timer(self, state: dict, least: int | None) -> None:
        """One timer a camera: when its first waiting frame is due, or else when it is to be forgotten."""
        if not self.timed:
            return
        due = least if least is not None else state["ms"] + self.forget_ms if self.forget_ms is not None and state["ms"] >= 0 else None
        if due != state["timer"]:
            if state["timer"] is not None:
                self.handle.deleteTimer(state["timer"])
            if due is not None:
                self.handle.registerTimer(due)
            state["timer"] = due

    def _forget(self, state: dict) -> None:
        if state["timer"] is not None:
            self.handle.deleteTimer(state["timer"])
        self.tracks.clear()
        self.waiting.clear()
        self.camera.clear()


def _stream(faces: DataFrame, event_time: str | None, lateness: str, forget: str | None, ends: bool, timeout: int) -> DataFrame:
    timed = event_time is not None
    ms = F.lit(0).cast("bigint")
    if timed:
        faces = faces.withWatermark(event_time, lateness)
        ms = F.unix_millis(event_time)
    forget_ms = None
    if forget is not None:
        forget_ms = int(pd.Timedelta(forget).total_seconds() * 1000)
    columns = [c for c in _FACE if c != "ms"]
    rows = faces.select("camera_id", *columns, ms.alias("ms"), *([event_time] if timed else []))
    return rows.groupBy("camera_id").transformWithStateInPandas(
        statefulProcessor=FaceEvents(timed, forget_ms, ends, timeout), outputStructType=END_DDL if ends else EVENT_DDL, outputMode="Append",
        timeMode="EventTime" if timed else "ProcessingTime" if forget_ms else "None")


def stream_tracks(faces: DataFrame, event_time: str | None = None, lateness: str = "0 seconds", forget: str | None = None,
                  timeout: int = C.TRACK_TIMEOUT) -> DataFrame:
    """Events of a stream of detections.

    Input: camera_id, frame_idx, det_no, cx, cy, w, ear, mouth_w_ratio, mouth_open_ratio, is_fake, and the timestamp
    ``event_time`` if one is named.  ``forget`` is the time after which an absent camera's state goes, such as "10 minutes";
    without an event time it is told by the clock, and such a stream does not end by itself (no ``availableNow`` trigger).
    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    return _stream(faces, event_time, lateness, forget, False, timeout)


def track_timeout(faces: DataFrame, event_time: str | None = None, lateness: str = "0 seconds", forget: str | None = None,
                  timeout: int = C.TRACK_TIMEOUT) -> DataFrame:
    """(camera_id, track_id, first_frame, last_frame, n_seen) of each track as it is forgotten; input as for ``stream_tracks``."""
    return _stream(faces, event_time, lateness, forget, True, timeout)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def write_events(events: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    writer = events.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
