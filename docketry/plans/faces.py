"""Face jobs: detections and frame features -> tracks, fake flags, reported events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.operators import tracks as V
from docketry.sources.readers import stored


def labelled_events(frames: DataFrame) -> DataFrame:
    """Reported events, smiles labelled by whether the face is fake."""
    events = V.fused_events(frames)
    flags = frames.select(*V.TRACK, "frame_idx", "is_fake")
    df = events.join(flags, [*V.TRACK, "frame_idx"])
    label = F.when(F.col("event_kind") == "smile", V.smile_label_by_face(F.col("is_fake"))).otherwise(F.col("event_kind"))
    return df.select(*V.TRACK, "frame_idx", label.alias("event_kind"))


def camera_report(faces: DataFrame, screens: DataFrame) -> DataFrame:
    """Per camera: detections, tracks, faces inside a screen, faces much smaller than the widest."""
    tracked = V.track_faces(faces).select("camera_id", "frame_idx", "det_no", "is_new")
    screen = V.screen_containment(faces, screens).select("camera_id", "frame_idx", "det_no", F.col("is_fake").alias("in_screen"))
    small = V.size_fake(faces).select("camera_id", "frame_idx", "det_no", F.col("is_fake").alias("is_small"))
    ids = ["camera_id", "frame_idx", "det_no"]
    return tracked.join(screen, ids).join(small, ids).groupBy("camera_id").agg(
        F.count("*").alias("n_detections"), F.count_if("is_new").alias("n_tracks"),
        F.count_if("in_screen").alias("n_in_screen"), F.count_if("is_small").alias("n_small"),
    )


def track_and_report(faces: DataFrame) -> DataFrame:
    """Detections with features -> tracks -> reported events, the batch form of the camera stream.

    Two detections of a frame on one track count as one, the later.  The tracked frames are stored, since
    finding events passes over them more than once.
    """
    feats = ["cx", "cy", "w", "ear", "mouth_w_ratio", "mouth_open_ratio", "is_fake"]
    tracked = V.track_faces(faces)
    one = tracked.groupBy(*V.TRACK, "frame_idx").agg(F.max_by(F.struct(*feats), "det_no").alias("f"))
    one = one.select(*V.TRACK, "frame_idx", "f.*").withColumnRenamed("w", "bw")
    return V.fused_events(stored(one, "tracked-frames"))
