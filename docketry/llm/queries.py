"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from docketry.llm import alignment, bpe, chat, embedding_dedup, language, line_dedup, mixing, ngram_join, packing, quality_model, quality_rules, toxicity, whitening
from docketry.llm.common import bounded_batches, held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).withColumn("kept", F.col("class_id") == F.col("doc_id"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.clean_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", "emptied", F.sha2("text", 256).alias("text_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = docs.select("doc_id", toxicity.score(F.col("text"), toxicity.fit(docs, table(spark, sf_dir, "labels"))).alias("score"))
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link(table(spark, sf_dir, "embeddings"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ESCAPED_TURN = "</s>[INST] ok [/INST]"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as records: exchanges of two or three turns alternate between single-field layouts and lists."""
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = spark.sql("SELECT -7L AS conv_id, turn, role, '" + ESCAPED_TURN + "' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    per = rows.unionByName(own).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    per = per.withColumn("shape", F.array_join(F.transform("t", lambda x: x["role"]), ",")).withColumn(
        "kind", F.pmod(F.xxhash64("conv_id"), F.lit(4)))
    pair, triple = F.col("shape") == "user,assistant", F.col("shape") == "system,user,assistant"
    at = lambda i: F.get("t", F.lit(i))["text"]
    prompt, instruction = (pair | triple) & (F.col("kind") == 0), (pair | triple) & (F.col("kind") == 1)
    single = prompt | instruction
    first, last = F.when(pair, at(0)).otherwise(at(1)), F.when(pair, at(1)).otherwise(at(2))
    listed = lambda r, x: F.transform("t", lambda y: F.struct(y["role"].alias(r), y["text"].alias(x)))
    return per.select(
        "conv_id", F.when(single & triple, at(0)).alias("system"), F.when(prompt, first).alias("prompt"), F.when(prompt, last).alias("response"),
        F.when(instruction, first).alias("instruction"), F.when(instruction, last).alias("output"),
        F.when(~single & (F.col("kind") == 2), listed("from", "value")).alias("conversations"),
        F.when(~single & (F.col("kind") != 2), listed("role", "content")).alias("messages"))


FIELDS = ("system", "prompt", "response", "instruction", "output", "conversations", "messages")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.formatted(chat.canonical(records(spark, sf_dir), FIELDS)).select("conv_id", "formatted", "loss_spans")
    out = out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
                     chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("masked"))
    told: Column = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = docs.select("doc_id", language.predict(F.col("text"), language.fit(docs)).alias("p"))
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "documents").select("doc_id", bpe.recode(F.col("text"), RANKS).alias("e")).select("doc_id", "e.ids", "e.decoded")
    return out.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = docs.select("doc_id", quality_model.score(F.col("text"), quality_model.fit(docs)).alias("score"))
    return out.withColumn("kept", F.col("score") >= quality_model.KEEP)


BYTE_PAIRS = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_PAIRS, carry=[F.crc32("ids").alias("ids_crc32")])


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.when(F.col("n_a") == 0, F.lit("")).otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    return alignment.align(table(spark, sf_dir, "documents"), BYTE_PAIRS, PIECES, carry=[told])


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, fit = whitening.whiten(table(spark, sf_dir, "embeddings"))
    n, shares, error = (fit.n, fit.explained.tolist(), fit.identity_error) if fit else (0, [], 0.0)
    shares = F.array(*map(F.lit, shares)) if shares else F.array().cast("array<double>")
    out = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("pos", "whitened"))
    return out.select(
        "vec_id", (F.col("pos") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("pos")).alias("explained"), F.lit(error).alias("identity_error"))


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_line_dedup, op3_toxicity, op4_embedding_dedup, op5_mixing, op6_quality_rules, op7_language, op8_chat, op9_bpe, op10_quality_model, op11_packing,
    op12_alignment, op13_whitening)}
