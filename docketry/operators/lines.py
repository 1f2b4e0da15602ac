"""Operators over line tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedup_keep_first(lines: DataFrame, keys: Sequence[str], text: str, order: str) -> DataFrame:
    """First row of each distinct text per key.  The partial aggregate drops repeats before the shuffle."""
    rest = [c for c in lines.columns if c not in {*keys, text, order}]
    first = F.min_by(F.struct(order, *rest), F.col(order))
    return lines.groupBy(*keys, text).agg(first.alias("_f")).select(*keys, text, "_f.*")


def union_missing_lines(first: DataFrame, second: DataFrame) -> DataFrame:
    """Lines of ``second`` whose exact text ``first`` lacks, appended behind ``first``.

    Both: doc_id, line_no, text.  Appended lines keep their order behind the last line of ``first``.
    """
    extra = second.join(first.select("doc_id", "text"), ["doc_id", "text"], "left_anti")
    extra = dedup_keep_first(extra, ["doc_id"], "text", "line_no")
    ends = first.groupBy("doc_id").agg((F.max("line_no") + 1).alias("_end"))
    extra = extra.join(ends, "doc_id", "left").select(
        "doc_id", (F.coalesce("_end", F.lit(0)) + F.col("line_no")).cast("int").alias("line_no"), "text"
    )
    return first.select("doc_id", "line_no", "text", F.lit("first").alias("origin")).unionByName(
        extra.withColumn("origin", F.lit("second"))
    )
