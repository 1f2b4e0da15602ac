"""Writers.  Each run has its own ``run_id`` folder: repeating a run replaces it, other runs are not touched.

A run is first written whole beside the folder, under a name that readers skip, and only then put in its place: by renames,
which move no data, so a reader sees the old run or the new one.  A job that fails or is killed leaves the old run as it is; one
that is killed between the renames is set right by the next write of that run, or by ``recover``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from docketry import catalog as C
from docketry.functions import text as T


def _run(path: str, run_id: str) -> str:
    return f"{path.rstrip('/')}/run_id={run_id}"


def _files(spark: SparkSession, path: str):
    """(file system, function from a name to its path) of a folder."""
    jvm = spark.sparkContext._jvm
    at = lambda name: jvm.org.apache.hadoop.fs.Path(name)
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _aside(path: str, run_id: str) -> str:
    return f"{path.rstrip('/')}/_replaced/run-{run_id}"


def recover(spark: SparkSession, path: str, run_id: str) -> bool:
    """Put back a run that a killed rewrite had already moved aside; whether there was one."""
    fs, at = _files(spark, path)
    aside, run = at(_aside(path, run_id)), at(_run(path, run_id))
    if not fs.exists(aside):
        return False
    if fs.exists(run):  # the new run was already in its place
        fs.delete(aside, True)
        return False
    return fs.rename(aside, run)


def _put(writer: DataFrameWriter, kind: str, path: str, run_id: str) -> None:
    """Write a run in the format ``kind`` and put it in the place of the one before."""
    spark = writer._spark
    recover(spark, path, run_id)
    staging = f"{path.rstrip('/')}/_staging/{uuid.uuid4().hex}"
    fs, at = _files(spark, path)
    try:
        getattr(writer.mode("errorifexists"), kind)(staging)
    except Exception:
        fs.delete(at(staging), True)
        raise
    run, aside = at(_run(path, run_id)), at(_aside(path, run_id))
    if fs.exists(run):
        fs.mkdirs(aside.getParent())
        if not fs.rename(run, aside):
            raise OSError(f"{run.toString()} can't be moved")
    if not fs.rename(at(staging), run):
        recover(spark, path, run_id)
        raise OSError(f"{staging} can't be moved to {run.toString()}")
    fs.delete(aside, True)


def bucket_of(name: Column, buckets: int = 64) -> Column:
    """A folder number, so that many names share few folders."""
    return F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int")


def with_top_score(classified: DataFrame) -> DataFrame:
    """Adds the chosen type's score, 0 for unknown documents."""
    chosen = F.filter("scores", lambda s: s["doc_type"] == F.col("best_type"))
    return classified.withColumn("score", F.coalesce(F.get(chosen, F.lit(0))["score"], F.lit(0)))


def results_to_write(classified: DataFrame) -> DataFrame:
    """Detected documents with a positive score."""
    return with_top_score(classified).filter((F.col("best_type") != C.UNKNOWN) & (F.col("score") > 0))


def write_results_json(classified: DataFrame, path: str, run_id: str) -> None:
    _put(results_to_write(classified).write, "json", path, run_id)


def route_results(results: DataFrame) -> DataFrame:
    """Adds ``route`` and ``out_name``: detected documents at their minimum score stay, the rest go to Others.

    Input: best_type, score, file_name.
    """
    need = F.lit(1)
    for doc_type, (min_score, _) in C.RULES.items():
        need = F.when(F.col("best_type") == doc_type, F.lit(min_score)).otherwise(need)
    good = (F.col("best_type") != C.UNKNOWN) & (F.col("score") >= need)
    name = T.clean_filename(T.stem(F.col("file_name")))
    return results.withColumn("route", F.when(good, "main").otherwise("Others")).withColumn(
        "out_name", F.concat(F.when(good, name).otherwise(F.concat(F.lit("other_"), name)), F.lit(".json"))
    )


def write_routed(results: DataFrame, path: str, run_id: str) -> None:
    _put(route_results(results).write.partitionBy("route"), "json", path, run_id)


def document_text(lines: DataFrame, keep_empty: bool = False) -> DataFrame:
    """One row per document: its lines joined in order.  ``lines``: doc_id, line_ord, text."""
    rows = lines if keep_empty else lines.filter(F.length(T.strip(F.col("text"))) > 0)
    rows = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line_ord", "text"))).alias("l"))
    return rows.select("doc_id", F.array_join(F.col("l")["text"], "\n").alias("content"))


def write_sorted_text(lines: DataFrame, path: str, run_id: str, keep_empty: bool = False) -> None:
    """Text lines in order.  Documents are range-partitioned, so each part file holds whole stretches of
    documents in order and a very large document may span several files."""
    rows = lines if keep_empty else lines.filter(F.length(T.strip(F.col("text"))) > 0)
    rows = rows.repartitionByRange("doc_id", "line_ord").sortWithinPartitions("doc_id", "line_ord")
    _put(rows.select("doc_id", "line_ord", "text").write.option("sep", "\t"), "csv", path, run_id)


def write_text_files(documents: DataFrame, path: str, run_id: str) -> None:
    """Texts with their ids as JSON lines, in folders by a hash of the id."""
    rows = documents.select("doc_id", "content", bucket_of(F.col("doc_id")).alias("bucket"))
    _put(rows.write.partitionBy("bucket"), "json", path, run_id)


def write_tables_csv(rows: DataFrame, path: str, run_id: str) -> None:
    """Table rows (filename, segment, row) as CSV in folders by a hash of the file name; tables without rows leave nothing."""
    _put(rows.withColumn("bucket", bucket_of(F.col("filename"))).write.partitionBy("bucket").option("header", True), "csv", path, run_id)


def build_manifest(segments: DataFrame) -> DataFrame:
    """One row per file with its segments in id order: (filename, n_segments, segments)."""
    entry = F.struct("id", "type", F.array("x", "y", "w", "h").alias("bbox"))
    return segments.groupBy("filename").agg(
        F.count("*").alias("n_segments"), F.array_sort(F.collect_list(entry)).alias("segments")
    )


def write_manifest(segments: DataFrame, path: str, run_id: str) -> None:
    _put(build_manifest(segments).write, "json", path, run_id)


def write_events(events: DataFrame, path: str, run_id: str) -> None:
    """Face events in one folder per kind (already routed, see ``tracks.route_events``)."""
    _put(events.write.partitionBy("event_kind"), "json", path, run_id)
