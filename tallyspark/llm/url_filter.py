"""URL filter: a blocked Bloom filter of the listed canonical URLs, then an exact hash join (DataFrame functions only).

A rule decides where one fits: its host and all subdomains of it, if the url's path starts with the rule's path; the
longest rule wins. Elsewhere the listing decides: a url is blocked if its canonical form is listed.

The filter is a table of blocks of 256 bits (four longs): one hash picks the block, two bits are set in each long, so a
probe reads one row. It is broadcast while its size, known from the number of listed urls, stays below a bound;
beyond it, it is joined by block number. Urls that pass are joined with the listing itself, which removes the filter's
false positives; all others skip that join.

Defined cases: a null url, or one without '://', has an empty host and path, fits no rule and isn't listed (allow);
repeated pages and urls are judged alike; an empty listing blocks nothing; a rule's path of '' fits every path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_PER_URL = 16
#: blocks that may be broadcast: 1 << 18 blocks hold 4 million urls in about 16 MB
BROADCAST_BLOCKS = 1 << 18
#: query parameters that don't change a page (fixed values)
TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid)(=|$)"


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without www., m. and default port; path without a closing slash; query sorted and without tracking."""
    bare = F.regexp_replace(F.regexp_replace(host(url), r"^(www|m)\.", ""), r":(80|443)$", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    joined = F.concat_ws("&", kept)
    out = F.concat(bare, F.regexp_replace(path(url), "/+$", ""), F.when(joined == "", "").otherwise(F.concat(F.lit("?"), joined)))
    return F.when(host(url) != "", out)


def rule_of(h: Column, p: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule (action, 'host/path') that fits, as a struct, or null."""
    found = F.lit(None).cast("struct<action:string,rule:string>")
    for action, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((h == name) | h.endswith("." + name)) & p.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(action).alias("action"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def masks(url: Column, blocks: int) -> list[Column]:
    """The block number and the four masks of a canonical url."""
    h, g = F.xxhash64(url), F.xxhash64(url, F.lit("bits"))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(g, 6 * k).bitwiseAND(F.lit(63)).cast("int"))
    return [F.pmod(h, F.lit(blocks)).cast("int"), *(bit(2 * j).bitwiseOR(bit(2 * j + 1)) for j in range(4))]


def bloom(listing: DataFrame, blocks: int) -> DataFrame:
    """block, b0..b3: the filter of listing's column url_key."""
    b, *m = masks(F.col("url_key"), blocks)
    return listing.select(b.alias("block"), *(x.alias(f"m{j}") for j, x in enumerate(m))).groupBy("block").agg(*(F.bit_or(f"m{j}").alias(f"b{j}") for j in range(4)))


def judge(pages: DataFrame, listing: DataFrame, rules: list[tuple[str, str]], bits_per_url: int = BITS_PER_URL) -> DataFrame:
    """page_id, host, path, rule, verdict, listed, passed_filter for every row of pages (page_id, url).

    listing: a table with a column url; urls are made canonical here.
    """
    listed = listing.select(canonical(F.col("url")).alias("url_key")).filter("url_key is not null").distinct()
    blocks, bits = 1, listed.count() * bits_per_url
    while blocks * 256 < bits:
        blocks *= 2
    filt = bloom(listed, blocks)
    if blocks <= BROADCAST_BLOCKS:
        filt = F.broadcast(filt)
    df = pages.select("page_id", "url").withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url"))).withColumn("url_key", canonical(F.col("url")))
    df = df.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).drop("url")
    b, *m = masks(F.col("url_key"), blocks)
    df = df.withColumn("block", b).join(filt, "block", "left")
    inside = F.lit(True)
    for j, x in enumerate(m):
        inside = inside & (F.col(f"b{j}").bitwiseAND(x) == x)
    df = df.withColumn("passed_filter", F.coalesce(inside & F.col("url_key").isNotNull(), F.lit(False))).drop("block", "b0", "b1", "b2", "b3")
    # the exact join; its second key lets Spark deal both sides out by exchanges of this join, so a hot url is split
    exact = listed.withColumn("url_hash", F.xxhash64("url_key")).withColumn("listed", F.lit(True))
    hits = df.filter("passed_filter").withColumn("url_hash", F.xxhash64("url_key")).join(exact, ["url_key", "url_hash"], "left").drop("url_hash")
    rest = df.filter("not passed_filter").withColumn("listed", F.lit(False))
    out = hits.withColumn("listed", F.coalesce("listed", F.lit(False))).unionByName(rest)
    verdict = F.when(F.col("fit").isNotNull(), F.col("fit.action")).otherwise(F.when(F.col("listed"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "listed", "passed_filter")
