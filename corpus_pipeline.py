"""The corpus pipeline: five stages, each on all that the one before it kept.

Stages take and, but for the last, return the columns of documents; columns beyond those stay. An empty table stays empty. Null
and empty texts have no words and go in the first stage. Rows that repeat are judged alike by it; line dedup takes rows of equal
doc_id as one document; of these SimHash keeps the one of least text hash; mixing takes documents in an order without ties.
Very long texts are read whole in each stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import bpe, linededup, mixing, quality, simhash
from heddle.llm.common import scratch
from heddle.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep(docs, level=quality.LEVEL)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents hold stay in the last of them; n_chars follows the text."""
    return linededup.dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each component stays."""
    return simhash.dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each leaf's share of nine tenths of all tokens; no document is taken twice."""
    return mixing.mixed(docs, mixing.tree(), weights=mixing.WEIGHTS, budget=0.9, max_epochs=1).select(*docs.columns)


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, and digests of them and of the text they decode to."""
    both = bpe.decode(bpe.encode(docs, tokenizer_path()), tokenizer_path())
    return both.select(
        "doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


STAGES = [("quality", quality_rules), ("line_dedup", line_dedup), ("simhash", simhash_dedup), ("mixing", mix), ("bpe", bpe_round_trip)]

#: Robust estimates, fingerprints and token ids are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = scratch(spark)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
