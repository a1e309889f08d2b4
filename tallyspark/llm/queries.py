"""The registered queries opN_<name>: each applies its operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import decontaminate, filter_audit, jaccard_join, langid, license_scan, mixing, passages, ranked_search, secrets, sharding, url_filter, warc, webp
from tallyspark.llm.sql import ORACLE_SQL  # noqa: F401
from tallyspark.session import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: fixed values: the rules of the url query
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: hosts whose pages stand for a blocklist, as the tables have none (fixed values)
LISTED_HOSTS = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]

#: the tree of the mixing query (fixed values): domains, integer weights, seed, and the share of all tokens to take
DOMAINS = ["web", "reference", "forum", "code"]
MIX = {
    "domains": DOMAINS,
    "weights": {"domain": {"web": 4, "reference": 3, "forum": 2, "code": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}},
    "total_share": (9, 10),
    "max_epochs": 2,
    "seed": "mix-1",
}


def listing(pages: DataFrame) -> DataFrame:
    """The urls of pages on hosts of the blocklist."""
    return pages.filter(url_filter.host(F.col("url")).rlike(r"(^|\.)(" + "|".join(LISTED_HOSTS) + r")\.")).select("url")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, listing(pages), RULES).select("page_id", "host", "path", "rule", "verdict", "listed")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_hyperdimensional_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).drop("found")


def op5_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sharding.shard(table(spark, sf_dir, "documents"), 8)
    return df.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "vslot")


def op6_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_mix_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents"), **MIX)


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.read(written(webp.store(table(spark, sf_dir, "documents")), "media"))


def op10_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filter,
        op2_jaccard_join,
        op3_hyperdimensional_langid,
        op4_secret_scan,
        op5_slot_sharding,
        op6_template_decontamination,
        op7_mix_budgets,
        op8_warc_revisits,
        op9_webp_media,
        op10_compact_windows,
        op11_filter_audit,
        op12_tiered_search,
        op13_license_scan,
    )
}
