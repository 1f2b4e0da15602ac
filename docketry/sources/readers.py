"""Readers: files, stored responses, label tables, shared working folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry import catalog as C
from docketry.functions import text as T
from docketry.schemas import LABEL_ROW


def file_extension(path: Column) -> Column:
    return T.extension(T.basename(path), default="")


def allowed_files(files: DataFrame, extensions: Sequence[str] = C.SCAN_EXTENSIONS) -> DataFrame:
    """Files whose extension, in any case, is on the list; adds ``ext``."""
    return files.withColumn("ext", file_extension(F.col("path"))).filter(F.col("ext").isin(*extensions))


def scan_files(
    spark: SparkSession, folder: str, recursive: bool = False,
    extensions: Sequence[str] = C.SCAN_EXTENSIONS, content: bool = True,
) -> DataFrame:
    """Files of a folder as rows.  Without ``content`` only metadata is read."""
    any_case = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in x) for x in extensions]
    df = (
        spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
        .option("pathGlobFilter", "*.{" + ",".join(any_case) + "}").load(folder)
    )
    df = allowed_files(df, extensions)
    return df if content else df.drop("content")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """One stored JSON response per file: (path, payload)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("payload"))


def read_label_csv(spark: SparkSession, path: str, schema: str = LABEL_ROW) -> DataFrame:
    """Bounding-box labels from CSV files with a header, under a declared schema."""
    return spark.read.option("header", True).schema(schema).csv(path)


def parse_label_rows(rows: DataFrame, value: str = "value", schema: str = LABEL_ROW) -> DataFrame:
    """The same from a text column, one row per line; a field that does not parse is null."""
    return rows.select("*", F.from_csv(value, schema).alias("_l")).select(
        *[c for c in rows.columns if c != value], "_l.*"
    )


_scratch: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Tables that are stored inside go to one folder, which is removed at the end; write or collect results inside as well."""
    folder = shared_folder(spark, "scratch")
    _scratch.append(folder)
    try:
        yield folder
    finally:
        _scratch.remove(folder)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared checkpoint folder, or under that of the innermost ``scratch``.

    Only when a local session names none, as in tests, is a temporary folder made; it goes when the process ends.
    """
    base = _scratch[-1] if _scratch else spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        base = tempfile.mkdtemp(prefix="docketry-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a result that several later steps read, and return it as read back.

    The table is on shared storage, so losing an executor never costs the steps before it.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
