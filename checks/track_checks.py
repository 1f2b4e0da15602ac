"""Comparison queries for detections, tracks, events and event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.sqlbase import FACES, FRAMES, OBJECTS
from docketry import catalog as C
from docketry import fixtures as X
from docketry.functions import geometry as G
from docketry.operators import tracks as V
from docketry.plans import faces as PF
from docketry.streaming import windows as SW

QUERIES, SQL = {}, {}
W, H = 640, 480


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


# --- detections --------------------------------------------------------------------------------

@query("v1_class_counts", f"WITH {OBJECTS} SELECT camera_id, frame_idx, class_id, class_name, count(*) AS n FROM objects GROUP BY ALL")
def v1(spark, sf):
    return V.class_counts(X.objects(spark, sf))


@query("v1_image_counts", f"WITH {OBJECTS} SELECT camera_id, frame_idx, count(*) AS n_objects, count(*) FILTER (class_id = 0) AS n_persons FROM objects GROUP BY ALL")
def v1i(spark, sf):
    return V.image_counts(X.objects(spark, sf))


@query("v2_filter_detections", f"WITH {OBJECTS} SELECT camera_id, frame_idx, obj_no, class_id, conf FROM objects WHERE conf >= 0.25 AND class_id IN (62, 63, 67)")
def v2(spark, sf):
    return V.filter_detections(X.objects(spark, sf), 0.25, C.SCREEN_CLASSES).select("camera_id", "frame_idx", "obj_no", "class_id", "conf")


_FULL = f"""full_objects AS (SELECT *, CAST(trunc(x1 / 384.0::DOUBLE * {W}) AS INTEGER) AS x, CAST(trunc(y1 / 288.0::DOUBLE * {H}) AS INTEGER) AS y,
 CAST(trunc((x2 - x1) / 384.0::DOUBLE * {W}) AS INTEGER) AS w, CAST(trunc((y2 - y1) / 288.0::DOUBLE * {H}) AS INTEGER) AS h FROM objects)"""


@query("v3_rescale_boxes", f"WITH {OBJECTS}, {_FULL} SELECT camera_id, frame_idx, obj_no, x, y, w, h FROM full_objects")
def v3(spark, sf):
    return V.rescale_boxes(X.objects(spark, sf), W, H).select("camera_id", "frame_idx", "obj_no", "x", "y", "w", "h")


def screens(spark, sf):
    return V.rescale_boxes(V.filter_detections(X.objects(spark, sf), 0.0, C.SCREEN_CLASSES), W, H)


_SCREENS = f"{OBJECTS}, {_FULL}, screens AS (SELECT * FROM full_objects WHERE class_id IN (62, 63, 67))"


@query("v14_screen_containment", f"""WITH {FACES}, {_SCREENS}
SELECT camera_id, frame_idx, det_no, EXISTS (SELECT 1 FROM screens s WHERE s.camera_id = f.camera_id AND s.frame_idx = f.frame_idx - f.frame_idx % 6
  AND f.x >= s.x AND f.y >= s.y AND f.x + f.w <= s.x + s.w AND f.y + f.h <= s.y + s.h) AS is_fake FROM faces f""")
def v14(spark, sf):
    return V.screen_containment(X.faces(spark, sf), screens(spark, sf)).select("camera_id", "frame_idx", "det_no", "is_fake")


@query("v15_carry_forward", f"""WITH {FACES}, {_SCREENS}, fr AS (SELECT DISTINCT camera_id, frame_idx FROM faces)
SELECT fr.camera_id, fr.frame_idx, s.obj_no, s.x, s.y, s.w, s.h FROM fr JOIN screens s ON s.camera_id = fr.camera_id AND s.frame_idx = fr.frame_idx - fr.frame_idx % 6""")
def v15(spark, sf):
    fr = X.faces(spark, sf).select("camera_id", "frame_idx").distinct()
    return V.carry_forward(fr, screens(spark, sf))


@query("v16_size_fake", f"""WITH {FACES} SELECT camera_id, frame_idx, det_no, w < max(w) OVER (PARTITION BY camera_id, frame_idx) * 0.40::DOUBLE AS is_fake FROM faces""")
def v16(spark, sf):
    return V.size_fake(X.faces(spark, sf)).select("camera_id", "frame_idx", "det_no", "is_fake")


# --- landmarks ---------------------------------------------------------------------------------

LM = """lm AS (SELECT event_id, i, CAST(trunc((200 + (event_id * 7 + i * 37) % 240) / 640.0::DOUBLE * 640) AS INTEGER) AS x,
  CAST(trunc((100 + (event_id * 5 + i * 53) % 280) / 480.0::DOUBLE * 480) AS INTEGER) AS y FROM events, range(468) r(i)),
lb AS (SELECT event_id, min(x) AS x, min(y) AS y, max(x) - min(x) AS w, max(y) - min(y) AS h, (min(x) + max(x)) // 2 AS cx, (min(y) + max(y)) // 2 AS cy FROM lm GROUP BY 1)"""


def _pt(i):
    return f"max(x) FILTER (i = {i}) AS x{i}, max(y) FILTER (i = {i}) AS y{i}"


def _d(a, b):
    return f"sqrt(power(x{a} - x{b}, 2) + power(y{a} - y{b}, 2))"


def _eye(ix):
    p1, p2, p3, p4, p5, p6 = ix
    return f"CASE WHEN {_d(p1, p4)} > 0 THEN ({_d(p2, p6)} + {_d(p3, p5)}) / (2 * {_d(p1, p4)}) ELSE 0 END"


@query("v4_landmark_box", f"WITH {LM} SELECT event_id, x, y, w, h, CAST(cx AS INTEGER) AS cx, CAST(cy AS INTEGER) AS cy FROM lb")
def v4(spark, sf):
    d = X.landmarks(spark, sf)
    return d.select("event_id", G.landmark_box(F.col("landmarks"), F.col("frame_w"), F.col("frame_h")).alias("b")).select("event_id", "b.*")


_EYES = C.RIGHT_EYE + C.LEFT_EYE


@query("v5_eye_aspect_ratio", f"""WITH {LM}, p AS (SELECT event_id, {', '.join(_pt(i) for i in _EYES)} FROM lm WHERE i IN {_EYES} GROUP BY 1)
SELECT event_id, round(({_eye(C.RIGHT_EYE)} + {_eye(C.LEFT_EYE)}) / 2, 6) AS ear FROM p""")
def v5(spark, sf):
    d = X.landmarks(spark, sf)
    return d.select("event_id", F.round(G.eye_aspect_ratio(F.col("landmarks"), F.col("frame_w"), F.col("frame_h")), 6).alias("ear"))


@query("v6_mouth_ratios", f"""WITH {LM}, p AS (SELECT event_id, {', '.join(_pt(i) for i in (61, 291, 13, 14))} FROM lm WHERE i IN (61, 291, 13, 14) GROUP BY 1)
SELECT event_id, round({_d(61, 291)}, 6) AS mouth_w, round({_d(13, 14)}, 6) AS mouth_open, round({_d(61, 291)} / (w + 1e-6), 6) AS mouth_w_ratio,
 round({_d(13, 14)} / ({_d(61, 291)} + 1e-6), 6) AS mouth_open_ratio FROM p JOIN lb USING (event_id)""")
def v6(spark, sf):
    d = X.landmarks(spark, sf)
    lm, w, h = F.col("landmarks"), F.col("frame_w"), F.col("frame_h")
    m = d.select("event_id", G.mouth_ratios(lm, w, h, G.landmark_box(lm, w, h)["w"]).alias("m"))
    return m.select("event_id", *[F.round(f"m.{c}", 6).alias(c) for c in ("mouth_w", "mouth_open", "mouth_w_ratio", "mouth_open_ratio")])


# --- tracking ----------------------------------------------------------------------------------

def track_sql(factor: float, floor: int) -> str:
    """One detection per step: tracks in trying order, the ids touched in this frame, the tracks born in it."""
    return f"""fo AS (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY frame_idx, det_no) AS k FROM faces),
tr AS (
 SELECT camera_id, k, frame_idx, det_no, []::STRUCT(id BIGINT, cx INTEGER, cy INTEGER, seen BIGINT)[] AS trk, [{{'id': 0::BIGINT, 'cx': cx, 'cy': cy, 'seen': frame_idx}}] AS born, [0::BIGINT] AS touched,
  1::BIGINT AS next_id, 0::BIGINT AS track_id, true AS is_new, NULL::DOUBLE AS match_distance FROM fo WHERE k = 1
 UNION ALL
 SELECT camera_id, k, frame_idx, det_no,
  CASE WHEN b IS NULL THEN ts0 ELSE list_transform(ts0, lambda t, i: CASE WHEN i = b.i THEN {{'id': t.id, 'cx': cx, 'cy': cy, 'seen': frame_idx}} ELSE t END) END,
  CASE WHEN b IS NULL THEN list_append(born0, {{'id': next_id, 'cx': cx, 'cy': cy, 'seen': frame_idx}}) ELSE born0 END,
  CASE WHEN b IS NULL THEN list_append(touched0, next_id) WHEN list_contains(touched0, ts0[b.i].id) THEN touched0 ELSE list_append(touched0, ts0[b.i].id) END,
  CASE WHEN b IS NULL THEN next_id + 1 ELSE next_id END, CASE WHEN b IS NULL THEN next_id ELSE ts0[b.i].id END, b IS NULL, b.d
 FROM (SELECT *, list_min(list_filter(list_transform(ts0, lambda t, i: {{'d': sqrt((power(t.cx - cx, 2) + power(t.cy - cy, 2))::DOUBLE), 'i': i}}), lambda z: z.d <= greatest({floor}, w * {factor}::DOUBLE))) AS b
  FROM (SELECT f.camera_id, f.k, f.frame_idx, f.det_no, f.cx, f.cy, f.w, next_id,
    CASE WHEN f.frame_idx = tr.frame_idx THEN trk ELSE list_filter(list_concat(
       list_transform(touched, lambda id: coalesce(list_filter(born, lambda t: t.id = id)[1], list_filter(trk, lambda t: t.id = id)[1])),
       list_filter(trk, lambda t: NOT list_contains(touched, t.id))), lambda t: f.frame_idx - 1 - t.seen <= 12) END AS ts0,
    CASE WHEN f.frame_idx = tr.frame_idx THEN born ELSE [] END AS born0, CASE WHEN f.frame_idx = tr.frame_idx THEN touched ELSE [] END AS touched0
   FROM tr JOIN fo f ON f.camera_id = tr.camera_id AND f.k = tr.k + 1)))"""


@query("v7_track_faces", f"WITH RECURSIVE {FACES}, {track_sql(0.6, 20)} SELECT camera_id, frame_idx, det_no, track_id, is_new, round(match_distance, 6) AS match_distance FROM tr")
def v7(spark, sf):
    t = V.track_faces(X.faces(spark, sf))
    return t.select("camera_id", "frame_idx", "det_no", "track_id", "is_new", F.round("match_distance", 6).alias("match_distance"))


@query("v7_track_faces_half_width", f"WITH RECURSIVE {FACES}, {track_sql(0.5, 0)} SELECT camera_id, frame_idx, det_no, track_id, is_new FROM tr")
def v7h(spark, sf):
    t = V.track_faces(X.faces(spark, sf), factor=0.5, floor=0)
    return t.select("camera_id", "frame_idx", "det_no", "track_id", "is_new")


@query("v7j_nearest_candidates", f"""WITH {FACES}, c AS (
 SELECT a.camera_id, a.frame_idx, a.det_no, b.det_no AS prev_det_no, sqrt(power(a.cx - b.cx, 2) + power(a.cy - b.cy, 2)) AS d, a.w FROM faces a JOIN faces b ON a.camera_id = b.camera_id AND a.frame_idx = b.frame_idx + 1)
SELECT camera_id, frame_idx, det_no, arg_min(prev_det_no, d * 10 + prev_det_no * 1e-6) AS prev_det_no, round(min(d), 6) AS distance FROM c WHERE d <= greatest(20, w * 0.6::DOUBLE) GROUP BY ALL""")
def v7j(spark, sf):
    return V.nearest_candidates(X.faces(spark, sf)).withColumn("distance", F.round("distance", 6))


@query("v7_carry_stale", f"""WITH {FRAMES}, f AS (SELECT camera_id, track_id, frame_idx * 5 AS frame_idx, ear FROM frames),
n AS (SELECT *, lead(frame_idx) OVER (PARTITION BY camera_id, track_id ORDER BY frame_idx) AS nx, max(frame_idx) OVER (PARTITION BY camera_id) AS e FROM f)
SELECT camera_id, track_id, frame_idx, ear, false AS stale FROM f
UNION ALL SELECT camera_id, track_id, frame_idx + k, ear, true FROM n, range(1, 13) r(k) WHERE frame_idx + k < coalesce(nx, e + 1)""")
def v7s(spark, sf):
    f = X.frames(spark, sf).select("camera_id", "track_id", (F.col("frame_idx") * 5).alias("frame_idx"), "ear")
    return V.carry_stale(f)


# --- events ------------------------------------------------------------------------------------

_W = "WINDOW w AS (PARTITION BY camera_id, track_id ORDER BY frame_idx)"
ISL = f"""a0 AS (SELECT *, mouth_w_ratio * (bw + 1e-6) AS mouth_px_w, lag(cx) OVER w AS pcx, lag(cy) OVER w AS pcy FROM frames {_W}),
a1 AS (SELECT *, ear < 0.25 AS closed, ear < 0.21 AS closed21, CASE WHEN bw < 140 THEN mouth_px_w >= greatest(14, CAST(trunc(bw * 0.30::DOUBLE) AS INTEGER)) ELSE mouth_w_ratio >= 0.4 END AND mouth_open_ratio < 0.25 AS smiling,
  coalesce(sqrt(power(cx - pcx, 2) + power(cy - pcy, 2)) > bw * 0.05::DOUBLE, false) AS moved, sqrt(power(cx - pcx, 2) + power(cy - pcy, 2)) AS shift FROM a0)"""


def isl(flag, name, src="a1"):
    """Position in the current run of ``flag`` and the length of the run that ended on the previous frame."""
    return f"""{name} AS (SELECT *, CASE WHEN {flag} THEN row_number() OVER (PARTITION BY camera_id, track_id, {flag}, g ORDER BY frame_idx) ELSE 0 END AS pos,
  0 AS z FROM (SELECT *, row_number() OVER (PARTITION BY camera_id, track_id ORDER BY frame_idx) - row_number() OVER (PARTITION BY camera_id, track_id, {flag} ORDER BY frame_idx) AS g FROM {src})),
{name}b AS (SELECT *, coalesce(lag(pos) OVER w, 0) AS before FROM {name} {_W})"""


@query("v8_blink_events", f"WITH {FRAMES}, {ISL}, {isl('closed', 'c')} SELECT camera_id, track_id, frame_idx, before AS run_length FROM cb WHERE NOT closed AND before >= 3")
def v8(spark, sf):
    return V.blink_events(X.frames(spark, sf))


@query("v8v_blink_events_021", f"WITH {FRAMES}, {ISL}, {isl('closed21', 'c')} SELECT camera_id, track_id, frame_idx, before AS run_length FROM cb WHERE NOT closed21 AND before >= 3")
def v8v(spark, sf):
    return V.blink_events(X.frames(spark, sf), threshold=0.21)


@query("v8_blink_events_unmoved", f"WITH {FRAMES}, {ISL}, {isl('closed', 'c')} SELECT camera_id, track_id, frame_idx, before AS run_length FROM cb WHERE NOT closed AND before >= 3 AND NOT coalesce(shift > bw * 2.0::DOUBLE, false)")
def v8m(spark, sf):
    """Movement of more than two face widths hides a blink; by the usual share hardly a frame stands still."""
    f = X.frames(spark, sf)
    key = ["camera_id", "track_id", "frame_idx"]
    moved = V.motion_events(f, 2.0).select(*key, F.lit(True).alias("moved"))
    return V.blink_events(f.join(moved, key, "left").withColumn("moved", F.coalesce("moved", F.lit(False))), moved="moved")


@query("v8_blink_counts", f"""WITH {FRAMES}, {ISL}, {isl('closed', 'c')}
SELECT camera_id, track_id, frame_idx, CAST(sum(CASE WHEN NOT closed AND before >= 3 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS blink_count FROM cb {_W}""")
def v8c(spark, sf):
    f = X.frames(spark, sf)
    return V.blink_counts(f, V.blink_events(f))


@query("v10_smile_events", f"WITH {FRAMES}, {ISL}, {isl('smiling', 'c')} SELECT camera_id, track_id, frame_idx, pos AS smile_pos FROM c WHERE pos > 0 AND pos % 3 = 0")
def v10(spark, sf):
    return V.smile_events(X.frames(spark, sf))


@query("v10v_smile_events_ratio", f"""WITH {FRAMES}, a1 AS (SELECT *, mouth_w_ratio >= 0.45 AND mouth_open_ratio < 0.28 AS smiling FROM frames), {isl('smiling', 'c')}
SELECT camera_id, track_id, frame_idx, pos AS smile_pos FROM c WHERE pos > 0 AND pos % 3 = 0""")
def v10r(spark, sf):
    return V.smile_events(X.frames(spark, sf), V.is_smiling(0.45, 0.28, small_width=None))


@query("v12_motion_events", f"WITH {FRAMES}, {ISL} SELECT camera_id, track_id, frame_idx, round(shift, 6) AS distance FROM a1 WHERE moved")
def v12(spark, sf):
    return V.motion_events(X.frames(spark, sf)).withColumn("distance", F.round("distance", 6))


@query("v12v_motion_events_haar", f"""WITH RECURSIVE {FRAMES}, {ISL}, ev AS (SELECT camera_id, track_id, frame_idx FROM a1 WHERE shift > 15 * (bw / 250.0::DOUBLE)),
k AS (SELECT camera_id, track_id, min(frame_idx) AS frame_idx FROM ev WHERE frame_idx > 10 GROUP BY ALL
 UNION ALL SELECT k.camera_id, k.track_id, (SELECT min(ev.frame_idx) FROM ev WHERE ev.camera_id = k.camera_id AND ev.track_id = k.track_id AND ev.frame_idx > k.frame_idx + 10) AS n FROM k
  WHERE EXISTS (SELECT 1 FROM ev WHERE ev.camera_id = k.camera_id AND ev.track_id = k.track_id AND ev.frame_idx > k.frame_idx + 10))
SELECT * FROM k""")
def v12h(spark, sf):
    """Movement beyond 15 pixels per 250 of face width, at most one report in ten frames."""
    ev = V.motion_events(X.frames(spark, sf), ratio=15 / 250.0).select("camera_id", "track_id", "frame_idx", F.lit("motion").alias("event_kind"))
    return V.cooldown(ev, gap=10).drop("event_kind")


def _adaptive_sql(flag, base, ref, hi):
    need = f"least({hi}, greatest(2, CAST(round_even({base} * ({ref}::DOUBLE / greatest(bw, 20)), 0) AS INTEGER)))"
    return f"""WITH RECURSIVE {FRAMES}, a1 AS (SELECT *, {flag} AS fl, {need} AS need FROM frames), {isl('fl', 'c')},
r AS (SELECT camera_id, track_id, frame_idx, pos, need, frame_idx - pos AS s FROM c WHERE pos > 0),
f AS (SELECT camera_id, track_id, s, pos, frame_idx, CASE WHEN 1 >= need THEN 0 ELSE 1 END AS cnt FROM r WHERE pos = 1
 UNION ALL SELECT r.camera_id, r.track_id, r.s, r.pos, r.frame_idx, CASE WHEN f.cnt + 1 >= r.need THEN 0 ELSE f.cnt + 1 END
 FROM f JOIN r ON r.camera_id = f.camera_id AND r.track_id = f.track_id AND r.s = f.s AND r.pos = f.pos + 1)
SELECT camera_id, track_id, frame_idx FROM f WHERE cnt = 0"""


@query("v9_blink_adaptive", _adaptive_sql("ear < 0.3", 5, 250.0, 10))
def v9(spark, sf):
    return V.blink_adaptive(X.frames(spark, sf), F.col("ear") < 0.3)


@query("v9v_blink_adaptive_200", _adaptive_sql("ear < 0.3", 6, 200.0, 10))
def v9v(spark, sf):
    return V.blink_adaptive(X.frames(spark, sf), F.col("ear") < 0.3, 6, 200.0)


@query("v11_smile_adaptive", _adaptive_sql("mouth_w_ratio >= 0.2", 5, 250.0, 8))
def v11(spark, sf):
    """The width ratio of the frame's widest smile candidate; 0.58 fits real detectors, the given ratios are smaller."""
    return V.smile_adaptive(X.frames(spark, sf), F.col("mouth_w_ratio") >= 0.2)


_TEETH = "coalesce(CASE WHEN mouth_px > 0 THEN bright_px::DOUBLE / mouth_px ELSE 0 END >= 0.12, false)"


@query("v10v_smile_events_teeth", f"""WITH RECURSIVE {FRAMES}, a1 AS (SELECT *, CASE WHEN bw < 140 THEN mouth_w_ratio * (bw + 1e-6) >= greatest(14, CAST(trunc(bw * CASE WHEN is_fake THEN 0.30::DOUBLE * 0.85 ELSE 0.30::DOUBLE END) AS INTEGER))
   ELSE mouth_w_ratio >= CASE WHEN is_fake THEN 0.45::DOUBLE * 0.90 ELSE 0.45::DOUBLE END END AND mouth_open_ratio < 0.28 AS sm, {_TEETH} AND frame_idx % 4 = 0 AS th FROM frames),
n AS (SELECT *, row_number() OVER w AS k FROM a1 {_W}),
f AS (SELECT camera_id, track_id, k, frame_idx, 0 AS ev, CASE WHEN sm THEN 1 ELSE 0 END + CASE WHEN th THEN 1 ELSE 0 END AS cnt FROM n WHERE k = 1
 UNION ALL SELECT camera_id, track_id, k, frame_idx, CASE WHEN c2 >= 3 THEN 1 ELSE 0 END, CASE WHEN c2 >= 3 THEN 0 ELSE c2 END FROM (
  SELECT camera_id, track_id, k, frame_idx, CASE WHEN c1 < 3 AND th THEN c1 + 1 ELSE c1 END AS c2 FROM (
   SELECT n.camera_id, n.track_id, n.k, n.frame_idx, n.th, CASE WHEN n.sm THEN f.cnt + 1 ELSE 0 END AS c1
   FROM f JOIN n ON n.camera_id = f.camera_id AND n.track_id = f.track_id AND n.k = f.k + 1)))
SELECT camera_id, track_id, frame_idx FROM f WHERE ev = 1""")
def v10t(spark, sf):
    f = X.frames(spark, sf)
    return V.smile_events_teeth(f, V.teeth_flag(F.col("bright_px"), F.col("mouth_px")), F.col("is_fake"))


_CAND_OF = f"""{ISL}, {isl('closed', 'c')}, {isl('smiling', 's')},
cand AS (SELECT camera_id, track_id, frame_idx, CASE WHEN is_fake THEN 'fake_face' WHEN s.pos > 0 AND s.pos % 3 = 0 THEN 'smile' WHEN moved THEN 'motion' WHEN NOT closed AND cb.before >= 3 THEN 'blink' END AS event_kind
  FROM cb JOIN (SELECT camera_id, track_id, frame_idx, pos FROM s) s USING (camera_id, track_id, frame_idx))"""
_CAND = f"{FRAMES}, {_CAND_OF}"
_THIN = """ev AS (SELECT * FROM cand WHERE event_kind IS NOT NULL),
k AS (SELECT camera_id, track_id, min(frame_idx) AS frame_idx FROM ev WHERE frame_idx > 12 GROUP BY ALL
 UNION ALL SELECT k.camera_id, k.track_id, (SELECT min(ev.frame_idx) FROM ev WHERE ev.camera_id = k.camera_id AND ev.track_id = k.track_id AND ev.frame_idx > k.frame_idx + 12) FROM k
  WHERE EXISTS (SELECT 1 FROM ev WHERE ev.camera_id = k.camera_id AND ev.track_id = k.track_id AND ev.frame_idx > k.frame_idx + 12)),
fused AS (SELECT ev.* FROM ev JOIN k USING (camera_id, track_id, frame_idx))"""


@query("v13_cooldown", f"WITH RECURSIVE {_CAND}, {_THIN} SELECT camera_id, track_id, frame_idx, event_kind FROM fused")
def v13(spark, sf):
    return V.fused_events(X.frames(spark, sf))


_COUNTED = """counted AS (SELECT cb.camera_id, cb.track_id, cb.frame_idx FROM cb
  LEFT JOIN fused e ON e.camera_id = cb.camera_id AND e.track_id = cb.track_id AND e.frame_idx = cb.frame_idx AND e.event_kind IN ('smile', 'motion')
  WHERE NOT closed AND cb.before >= 3 AND NOT (moved AND e.frame_idx IS NOT NULL))"""


@query("v8_blink_counts_coupled", f"""WITH RECURSIVE {_CAND}, {_THIN}, {_COUNTED}
SELECT camera_id, track_id, frame_idx, CAST(count(c.frame_idx) OVER (PARTITION BY camera_id, track_id ORDER BY frame_idx) AS BIGINT) AS blink_count
FROM frames LEFT JOIN counted c USING (camera_id, track_id, frame_idx)""")
def v8cc(spark, sf):
    f = X.frames(spark, sf)
    return V.blink_counts(f, V.coupled_blinks(f))


@query("v17_smile_label", f"""WITH {FRAMES} SELECT camera_id, track_id, frame_idx, CASE WHEN {_TEETH} THEN 'REAL_SMILE' WHEN ear < 0.25 THEN 'FAKE_SMILE' ELSE 'REAL_SMILE' END AS label,
 CASE WHEN is_fake THEN 'FAKE_SMILE' ELSE 'REAL_SMILE' END AS label_by_face FROM frames""")
def v17(spark, sf):
    f = X.frames(spark, sf)
    teeth = V.teeth_flag(F.col("bright_px"), F.col("mouth_px"))
    return f.select("camera_id", "track_id", "frame_idx", V.smile_label(teeth, F.col("ear") < C.SQUINT_EAR).alias("label"),
                    V.smile_label_by_face(F.col("is_fake")).alias("label_by_face"))


@query("v18_teeth_flag", f"""WITH {FRAMES} SELECT camera_id, track_id, frame_idx, {_TEETH} AS teeth, {_TEETH.replace('0.12', '0.25')} AS teeth_haar FROM frames""")
def v18(spark, sf):
    b, t = F.col("bright_px"), F.col("mouth_px")
    return X.frames(spark, sf).select("camera_id", "track_id", "frame_idx", V.teeth_flag(b, t).alias("teeth"), V.teeth_flag(b, t, 0.25).alias("teeth_haar"))


_LABELLED = f"""lab AS (SELECT camera_id, track_id, frame_idx, CASE WHEN event_kind = 'smile' THEN CASE WHEN is_fake THEN 'FAKE_SMILE' ELSE 'REAL_SMILE' END ELSE event_kind END AS event_kind FROM fused JOIN frames USING (camera_id, track_id, frame_idx))"""


@query("v19_route_events", f"""WITH RECURSIVE {_CAND}, {_THIN}, {_LABELLED}
SELECT * FROM lab UNION ALL SELECT camera_id, track_id, frame_idx, 'smile' FROM lab WHERE event_kind LIKE '%SMILE'""")
def v19(spark, sf):
    return V.route_events(PF.labelled_events(X.frames(spark, sf)))


@query("v20_track_summary", f"""WITH RECURSIVE {_CAND}, {_THIN}, {_COUNTED},
life AS (SELECT camera_id, track_id, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame, count(*) AS n_frames, avg(CAST(is_fake AS DOUBLE)) AS fake_share FROM frames GROUP BY ALL)
SELECT life.*, (SELECT count(*) FROM counted e WHERE e.camera_id = life.camera_id AND e.track_id = life.track_id) AS blink_count, {', '.join(f"(SELECT count(*) FROM fused e WHERE e.camera_id = life.camera_id AND e.track_id = life.track_id AND event_kind = '{k}') AS n_{k}" for k in ('blink', 'smile', 'motion', 'fake_face'))} FROM life""")
def v20(spark, sf):
    return V.track_summary(X.frames(spark, sf))


REPORTED = f"""RECURSIVE {FACES}, {track_sql(0.6, 20)},
frames AS (SELECT camera_id, track_id, frame_idx, arg_max(cx, det_no) AS cx, arg_max(cy, det_no) AS cy, arg_max(w, det_no) AS bw, arg_max(ear, det_no) AS ear,
  arg_max(mouth_w_ratio, det_no) AS mouth_w_ratio, arg_max(mouth_open_ratio, det_no) AS mouth_open_ratio, arg_max(is_fake, det_no) AS is_fake
  FROM faces JOIN (SELECT camera_id, frame_idx, det_no, track_id FROM tr) USING (camera_id, frame_idx, det_no) GROUP BY ALL),
{_CAND_OF}, {_THIN}"""


@query("v_camera_report", f"""WITH RECURSIVE {FACES}, {_SCREENS}, {track_sql(0.6, 20)},
fl AS (SELECT camera_id, frame_idx, det_no, EXISTS (SELECT 1 FROM screens s WHERE s.camera_id = f.camera_id AND s.frame_idx = f.frame_idx - f.frame_idx % 6
  AND f.x >= s.x AND f.y >= s.y AND f.x + f.w <= s.x + s.w AND f.y + f.h <= s.y + s.h) AS in_screen, w < max(w) OVER (PARTITION BY camera_id, frame_idx) * 0.40::DOUBLE AS small FROM faces f)
SELECT camera_id, count(*) AS n_detections, count(*) FILTER (is_new) AS n_tracks, count(*) FILTER (in_screen) AS n_in_screen, count(*) FILTER (small) AS n_small
FROM tr JOIN fl USING (camera_id, frame_idx, det_no) GROUP BY 1""")
def vcam(spark, sf):
    """Detections of every camera: screens, fake faces, tracks."""
    return PF.camera_report(X.faces(spark, sf), screens(spark, sf))


# --- event windows -----------------------------------------------------------------------------

@query("t4_event_windows_tumbling", """SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS window_start, event_type AS event_kind, count(*) AS n FROM events GROUP BY ALL""")
def t4(spark, sf):
    ev = X.table(spark, sf, "events").select("ts", F.col("event_type").alias("event_kind"))
    return SW.event_windows(ev, "10 minutes").select("window_start", "event_kind", "n")


@query("t4_event_windows_sliding", """WITH s AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE * k AS window_start, event_type AS event_kind FROM events, range(2) r(k))
SELECT window_start, event_kind, count(*) AS n FROM s GROUP BY ALL""")
def t4s(spark, sf):
    ev = X.table(spark, sf, "events").select("ts", F.col("event_type").alias("event_kind"))
    return SW.event_windows(ev, "10 minutes", "5 minutes").select("window_start", "event_kind", "n")


@query("t4_event_windows_session", """WITH s AS (SELECT user_id AS track_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT track_id, ts, sum(b) OVER (PARTITION BY track_id ORDER BY ts) AS g FROM s)
SELECT track_id, min(ts) AS window_start, count(*) AS n FROM g GROUP BY track_id, g.g""")
def t4g(spark, sf):
    ev = X.table(spark, sf, "events").select("ts", F.col("user_id").alias("track_id"))
    return SW.event_sessions(ev, "30 minutes").select("track_id", "window_start", "n")
