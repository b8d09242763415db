"""Queries of the text operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat, decontamination, language, licenses, manifest, packing, quality, secret_scan, sharding,
               simhash, spelling, sql, token_counts, toxicity)

SHARDS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    return sharding.shard_rows(rows, SHARDS, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op3_chat(spark: SparkSession, folder: str) -> DataFrame:
    control = f"{chat.CLOSE.strip()}{chat.OPEN}assistant ok"
    planted = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                    F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                    F.lit(control).alias("text"))
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").union(planted)
    read = chat.read_back(chat.format_conversations(chat.events_of_turns(rows)))
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op4_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_scan(table(spark, folder, "documents"))


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"),
                        ranks=vocabulary("byte_bpe_50k.tiktoken"))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), vocabulary("piece_bpe_32k.model"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_copies(table(spark, folder, "documents"))


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


def op11_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    fields = ["doc_id", "source", "lang", "n_chars"]
    digest = lambda text: manifest.record_digest([*map(F.col, fields), text])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, digest(F.translate("text", UPPER, LOWER)))
    rows = docs.select("doc_id", "lang", digest(F.col("text")).alias("leaf"), F.unhex(tampered).alias("received"))
    made = manifest.manifest(rows, "leaf", ["doc_id"], "lang")
    received = F.coalesce(F.lower(F.hex("received")), F.col("leaf"))
    return made.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"),
                       manifest.folded_root(received).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def op12_secrets(spark: SparkSession, folder: str) -> DataFrame:
    secrets = F.col("secrets")
    base = F.filter(secrets, lambda s: s["kind"].isin(*secret_scan.BASE))
    counts = [secret_scan.counted(secrets, "kind", k).alias(f"n_{k}") for k in secret_scan.KINDS]
    verdicts = [secret_scan.counted(secrets, "verdict", v).alias(f"n_{v}") for v in ("live", "copied")]
    return secret_scan.secret_report(table(spark, folder, "documents")).select(
        "doc_id", *counts, *verdicts, F.sha2(secret_scan.listed(base), 256).alias("base_sha256"),
        secret_scan.listed(secrets).alias("spans"))


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, folder, "documents"), change=spelling.dropped_letter(199))


QUERIES = {f.__name__: f for f in (
    op1_sharding, op2_decontamination, op3_chat, op4_licenses, op5_packing, op6_quality, op7_token_counts,
    op8_toxicity, op9_simhash, op10_language, op11_manifest,
    op12_secrets, op13_spelling)}
ORACLES = {"op1_sharding": sql.SHARDING, "op3_chat": sql.CHAT, "op6_quality": sql.QUALITY,
           "op11_manifest": sql.MANIFEST, "op12_secrets": sql.SECRETS, "op13_spelling": sql.SPELLING}
