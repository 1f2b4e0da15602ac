"""Page segmentation: candidate boxes of every kind -> numbered segments and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.operators import layout as L
from docketry.sources import sinks as S
from docketry.sources.readers import stored


def segment_pages(boxes: DataFrame, page_w: int, page_h: int) -> DataFrame:
    """Boxes with ``kind`` -> (page_id, id, type, x, y, w, h).

    Text boxes are filtered, merged and dropped where a table covers them; photo candidates are tested.
    The merged text boxes are stored, since dropping covered ones reads them twice.
    """
    tables = boxes.filter("kind = 'table'")
    text = L.box_filter(boxes.filter("kind = 'text_block'"), page_w, page_h, min_area=300)
    merged = stored(L.merge_overlaps(text).drop("n_merged"), "merged-text")
    text = L.suppress_overlaps(merged, tables)
    photos = L.photo_rule(boxes.filter((F.col("kind") == "photo") & (F.col("w") * F.col("h") >= 1000)))
    parts = [
        df.select("page_id", "box_no", *L.BOX, F.lit(t).alias("type"))
        for df, t in ((tables, "table"), (text, "text_block"), (photos, "photo"))
    ]
    segments = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return L.number_segments(segments).select("page_id", "id", "type", *L.BOX)


def manifests(segments: DataFrame) -> DataFrame:
    """One row per page file."""
    named = segments.withColumn("filename", F.format_string("page_%d.png", "page_id"))
    return S.build_manifest(named)
