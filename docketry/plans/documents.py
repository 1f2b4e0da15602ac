"""Document jobs: from files or engine output to classified documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import text as T
from docketry import catalog as C
from docketry.operators import classify as K
from docketry.operators import lines as L
from docketry.operators import ocr as O


def assign_txn(files: DataFrame, run_id: str, digits: int = 12) -> DataFrame:
    """Transaction id and names per file.  Ids derive from path, length and run, so a retried task repeats them."""
    clean = T.clean_filename(T.basename(F.col("path")))
    txn = F.substring(F.sha2(F.concat_ws("#", "path", "length", F.lit(run_id)), 256), 1, digits)
    df = files.withColumns({"stem": T.stem(clean), "txn_id": txn})
    return df.withColumns(
        {
            "base_dir": F.concat_ws("_", "stem", "txn_id"),
            "stamped": F.concat_ws("_", "stem", F.date_format("modificationTime", "yyyyMMdd_HHmmss")),
        }
    )


def child_name(stem: Column, page_no: Column, doc_no: Column) -> Column:
    return F.format_string("%s_page_%02d_doc_%02d.png", stem, page_no, doc_no)


def type_report(docs: DataFrame) -> DataFrame:
    """Documents per type and how many carry each kind of number; regex and detectors only, one shuffle."""
    return K.classify_regex(docs).groupBy("best_type").agg(
        F.count("*").alias("n_docs"),
        *[F.count_if(F.col(f"numbers.{n}.found")).alias(f"n_{n}") for n in ("pan", "digit12", "voter", "account11")],
    )


def stage_request(docs: DataFrame) -> DataFrame:
    """Audit row per document.  Input: txn_id, path, modificationTime, text, best_type (null text = failed)."""
    lines = T.match_lines(F.col("text"), split_short=False)
    return docs.select(
        "txn_id", F.date_format("modificationTime", "yyyyMMdd_HHmmss").alias("timestamp"), F.col("path").alias("filename"),
        F.when(F.col("text").isNull(), "ERROR").otherwise(F.col("best_type")).alias("document_type"),
        F.size(lines).alias("n_lines"), F.length("text").alias("n_chars"),
        F.when(F.col("text").isNull(), "no text").alias("error"),
    )


def stage_detection(docs: DataFrame, words: DataFrame) -> DataFrame:
    """Audit row of what was detected: words, words with a box, and where the drawn page and the sorted text go.

    ``docs``: doc_id, txn_id, path, modificationTime, base_dir, stamped.  ``words``: doc_id, vertices.
    """
    counts = words.groupBy("doc_id").agg(F.count("*").alias("words_count"), F.count_if(F.size("vertices") > 0).alias("boxes_count"))
    none = F.lit(0).cast("long")
    return docs.join(counts, "doc_id", "left").select(
        "txn_id", F.date_format("modificationTime", "yyyyMMdd_HHmmss").alias("timestamp"), F.col("path").alias("filename"),
        F.coalesce("words_count", none).alias("words_count"), F.coalesce("boxes_count", none).alias("boxes_count"),
        F.concat_ws("/", "base_dir", F.lit("OCR_IMAGE"), F.concat("stamped", F.lit(".png"))).alias("annotated_image_path"),
        F.concat_ws("/", "base_dir", F.lit("OCR_SORTED"), F.concat("stamped", F.lit(".txt"))).alias("sorted_text_path"),
    )


def stage_response(docs: DataFrame) -> DataFrame:
    """Audit row of what is answered.  Input: txn_id, text, best_type, base_dir, stamped."""
    return docs.select(
        "txn_id", F.when(F.col("text").isNull(), "ERROR").otherwise(F.col("best_type")).alias("document_type"),
        F.coalesce(T.match_lines(F.col("text"), split_short=False), F.array().cast("array<string>")).alias("detected_text"),
        F.concat_ws("/", "base_dir", F.lit("OCR_SORTED"), F.concat("stamped", F.lit(".txt"))).alias("sorted_text_path"),
    )


def error_record(read: DataFrame, runs: DataFrame, types: DataFrame) -> DataFrame:
    """A row for every document: its type, or ERROR and the reason when no engine gave text."""
    reasons = runs.groupBy("doc_id").agg(F.max("error").alias("reason"))
    df = read.join(reasons, "doc_id", "left").join(types, "doc_id", "left")
    failed = F.col("engine").isNull()
    return df.select(
        "doc_id",
        F.when(failed, "ERROR").otherwise(F.coalesce("best_type", F.lit(C.UNKNOWN))).alias("document_type"),
        F.when(failed, F.coalesce("reason", F.lit("no engine returned text"))).alias("error"),
    )


def documents_from_lines(lines: DataFrame) -> DataFrame:
    """OCR lines (doc_id, line_no, text) -> (doc_id, lines, text): textual lines once each, in order, and joined.

    Repeats are dropped before lines of a document meet.
    """
    kept = K.text_filter(lines).select("doc_id", "line_no", T.strip(F.col("text")).alias("text"))
    kept = L.dedup_keep_first(kept, ["doc_id"], "text", "line_no")
    docs = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("l"))
    docs = docs.select("doc_id", F.transform("l", lambda e: e["text"]).alias("lines"))
    return docs.withColumn("text", F.array_join("lines", "\n"))


def classify_lines(lines: DataFrame, threshold: float = C.FUZZY_THRESHOLD) -> DataFrame:
    """OCR lines -> classification of their documents."""
    return K.classify(documents_from_lines(lines), threshold)


def read_and_classify(runs: DataFrame, threshold: float = C.FUZZY_THRESHOLD) -> DataFrame:
    """Engine runs -> best engine's text -> cleaned lines -> classification, failures kept as rows."""
    read = O.engine_fallback(runs)
    docs = read.filter("engine IS NOT NULL").select(
        "doc_id", F.col("full_text").alias("text"), T.drop_ocr_noise(T.text_lines(F.col("full_text"))).alias("lines")
    )
    return K.classify(docs, threshold)
