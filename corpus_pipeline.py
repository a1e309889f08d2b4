"""The corpus pipeline: language ID, n-gram Jaccard join, benchmark decontamination, mixing and sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import decontaminate, jaccard_join, langid, mixing, sharding
from tallyspark.llm.queries import DOMAINS, MIX
from tallyspark.session import place, shared_path

#: a document of some length is rejected if its cosine with the nearest language is below the one, or less than the
#: other above the next language's
LEAST_SCORE, LEAST_MARGIN = 0.3, 0.05
#: the mix takes each document once at most, and this share of all tokens
MIXED = MIX | {"max_epochs": 1, "total_share": (9, 10), "domains": DOMAINS}
SHARDS = 8


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is recognised, with that language as lang (the mix goes by it).

    Texts that are null, empty or without letters go; short ones with letters stay; repeated rows stay or go together.
    """
    place(spark)
    return langid.keep_known(docs, LEAST_SCORE, LEAST_MARGIN)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of the Jaccard join, the one with the least doc_id.

    Texts without words are near nothing and stay, as do rows without a doc_id; rows that repeat a doc_id stay or go
    together.
    """
    place(spark)
    return jaccard_join.deduplicate(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that hold no benchmark item. Null and empty texts hold none, rows without a doc_id stay."""
    place(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep each leaf's share of the budget. Null names are a leaf of their own, texts without tokens cost nothing, and
    rows that repeat a doc_id are taken or left together."""
    return mixing.apply(docs, **MIXED)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are left, whole, with size, text_crc32, vslot, shard and slot (their place in the shard)."""
    return sharding.shard(docs, SHARDS, whole=True)


STAGES = [("language", known_language), ("dedup", near_duplicates), ("decontaminate", no_benchmark), ("mix", mixed), ("shard", sharded)]

#: language ID and the Jaccard join can't be said in SQL at this size; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each result written as Parquet and read again, the last in a folder a shard. An
    empty table runs through; extra columns are kept unless they clash with those that sharding adds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = shared_path(spark, "pipeline")
    for no, (name, stage) in enumerate(STAGES):
        path = f"{out}/{no}-{name}"
        done = stage(spark, docs, sf_dir)
        (done.write.partitionBy("shard") if no == len(STAGES) - 1 else done.write).parquet(path)
        docs = spark.read.schema(done.schema).parquet(path)
    return docs
