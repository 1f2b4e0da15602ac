"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import bpe, language, line_dedup, mixing, ngram_join
from docketry.llm.common import bounded_batches, stored
from docketry.llm.queries import RANKS

#: A document goes if no language reaches this mean probability over its windows.
LEAST_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language is clear; null and letterless texts go.  Columns and repeated rows stay as they are.

    Without a labelled row to learn from, nothing can be rejected: all documents stay.
    """
    bounded_batches(spark)
    model = language.fit(docs)
    if model is None:
        return docs
    said = docs.select(F.struct("*").alias("row"), language.predict(F.col("text"), model).alias("said"))
    return said.filter((F.col("said.lang") != language.UNKNOWN) & (F.col("said.score") >= LEAST_SCORE)).select("row.*")


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many sites share (but for the first copy); documents left without a line go."""
    clean = line_dedup.clean_lines(docs).filter("NOT emptied")
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the least id, and all documents that are in none.

    Rows that repeat an id and text are one document, of which one row stays.  A row without an id is known by a hash of its
    text, above all other ids: it goes if a row with an id is its near duplicate, and of several without one a single row
    stays (of rows without id and with equal texts too).  Rows that repeat an id with different texts stay or go together.
    """
    bounded_batches(spark)
    ident = F.coalesce(F.col("doc_id"), F.lit(1 << 62) + F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)))
    rows = docs.select(F.struct("*").alias("row"), ident.alias("id"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    out = ngram_join.join(rows.select("id", "row.text"), key="id").filter("class_id <> id").select("id")
    kept = rows.join(out, "id", "left_anti")
    same = ["id", "h1", "h2"]
    twice = stored(rows.groupBy(*same).count().filter("count > 1").select(*same), "repeated-rows")
    if not twice.isEmpty():
        one = kept.join(twice, same, "left_semi").dropDuplicates(same)
        kept = kept.join(twice, same, "left_anti").select("row").unionByName(one.select("row"))
    return kept.select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.mixed(docs)


def encode_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, as packed little-endian unsigned 32-bit integers, and a digest of the text they decode to."""
    bounded_batches(spark)
    out = docs.select("doc_id", bpe.recode(F.col("text"), RANKS).alias("e")).select("doc_id", "e.ids", "e.decoded")
    return out.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", identify_language),
    ("line_dedup", drop_shared_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode_text),
]

#: A trained network decides the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
