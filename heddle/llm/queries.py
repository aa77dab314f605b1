"""One query for each operator: production parameters, whole tables, whole results. (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, bytebpe, clusters, licenses, linededup, lm, mixing, neardup, negatives, quality, secrets, simhash, tokenfile
from .common import scratch, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


MIX = {"budget": 1.0, "max_epochs": 3, "seed": 7}


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixed(table(spark, sf_dir, "documents"), mixing.tree(), weights=mixing.WEIGHTS, **MIX)
    return out.select("doc_id", *(F.col(f"_t_{c}").alias(c) for c in mixing.tree()), F.col("_epoch").alias("epoch"))


def op2_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    tokenfile.write(table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=2)
    return tokenfile.read(spark, path, ids=False)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.decode(bpe.encode(docs, tokenizer_path()), tokenizer_path())
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), best=True)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *quality.STATS, "base_failed", "kept", "distance")


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"))


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.linked(table(spark, sf_dir, "embeddings"))


def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.components_of(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = secrets.dictionary(tokenizer_path())
    out = secrets.scan(table(spark, sf_dir, "documents"), secrets.trained(secrets.made_findings(spark), words), words, path="source")
    return out.select("doc_id", "start", F.length("candidate").cast("long").alias("n_chars"), F.sha2("candidate", 256).alias("sha256"), "probability", "is_secret")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, negatives.relabelled())


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.report(*clusters.clustered(table(spark, sf_dir, "embeddings")))


def op13_bytebpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bytebpe.decode(bytebpe.encode(docs, ranks, pattern), ranks)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


QUERIES = {f.__name__: f for f in (op1_mixing, op2_tokenfile, op3_bpe, op4_licenses, op5_quality, op6_lm, op7_neardup, op8_linededup, op9_simhash, op10_secrets, op11_negatives, op12_clusters, op13_bytebpe)}
ORACLES = {"op1_mixing": mixing.oracle(**MIX) + "SELECT doc_id, domain, lang, source, unnest(range(n)) AS epoch FROM times", "op7_neardup": neardup.ORACLE, "op8_linededup": linededup.ORACLE, "op11_negatives": negatives.ORACLE, "op12_clusters": clusters.oracle()}
