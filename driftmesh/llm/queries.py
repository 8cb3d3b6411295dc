"""The registered queries of the llm operators: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, decontam, langid, licenses, repeats, resharding, secrets, simhash, tokenio
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.fit_model(docs))


def op6_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    old = F.pmod(F.crc32(F.coalesce("source", F.lit(""))), F.lit(24))
    path, _ = resharding.reshard(docs, old, 24, 24)
    schema = "doc_id long, text string, size long, slot long, shard int"
    return spark.read.schema(schema).parquet(path).select(
        "doc_id",
        "size",
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bpe.encode(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))
    return got.select("doc_id", "n_tokens", "ids_crc32", "lossless")


def op10_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenio.write_token_shards(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))
    return tokenio.read_token_shards(spark, path)


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_license_scan": op2_license_scan,
    "op3_nearest": op3_nearest,
    "op4_language_id": op4_language_id,
    "op5_secret_scan": op5_secret_scan,
    "op6_repeated_strings": op6_repeated_strings,
    "op7_decontamination": op7_decontamination,
    "op8_resharding": op8_resharding,
    "op9_merge_dropout": op9_merge_dropout,
    "op10_wavelet_tokens": op10_wavelet_tokens,
}

ORACLES: dict[str, str] = {}
