"""Mixing sources to target weights by hierarchical budgets (DataFrame functions only).

The sources form a tree domain -> language -> source. A budget of tokens is given to the root and passed down: at each
node the children share its budget in proportion to their weights, and a child whose subtree holds less than its share
gets all it has; the shortage goes to its siblings first, and only what no sibling can take is missing at the parent
(whose own capacity was taken into account when the parent's siblings shared, so a shortage climbs only after the
siblings are full). All sums are exact integers (decimal(38,0)).

Each leaf then takes a prefix of its seeded epochs: epoch e is all its documents in the order of
md5(seed:e:doc_id). Whole epochs are taken as often as the budget holds them; of the next one a prefix whose tokens
don't exceed what is left. The prefix is found by two sums: over ranges of the order key, then inside one range.

Defined cases: a null source, language or text counts as the name '(none)' or as no tokens; a document without tokens
is taken in as many epochs as its leaf starts; rows that repeat a doc_id are separate rows which tie in the order, and
ties are taken or left together; an empty table gives an empty result; columns of the input that clash with the names
used here are dropped from the result of plan() and kept untouched by apply().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.session import written

NONE = "(none)"
WORD = r"[^\x20\x09-\x0D]+"
#: rows of one leaf that share a range of the order key, about
RANGE_ROWS = 4096
#: bytes of a leaf table that may be broadcast; a larger one is joined by a shuffle
BROADCAST_ROWS = 100_000

DEC = "decimal(38,0)"


def order_key(seed: str, epoch: Column, doc_id: Column) -> Column:
    """60 bits of md5(seed:epoch:doc_id)."""
    text = F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(NONE)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def tokens(text: Column) -> Column:
    """Words of the whole text; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def domain_of(source: Column, domains: list[str]) -> Column:
    """A fixed assignment of sources to domains: crc32 of the name."""
    return F.element_at(F.array(*map(F.lit, domains)), (F.crc32(source.cast("binary")) % len(domains) + 1).cast("int"))


def with_leaf(docs: DataFrame, domains: list[str]) -> DataFrame:
    """doc_id, m_domain, m_lang, m_source, m_tokens."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(NONE))
    return docs.select("doc_id", domain_of(source, domains).alias("m_domain"), F.coalesce(F.col("lang").cast("string"), F.lit(NONE)).alias("m_lang"), source.alias("m_source"), tokens(F.col("text")).alias("m_tokens"))


def share(nodes: DataFrame, parent: list[str], budget: str, out: str) -> DataFrame:
    """Give each row of nodes (weight, capacity, and its parent's budget) its part of that budget.

    Rows of a parent are full from the smallest capacity per weight on; the first that isn't full fixes the level that
    all later ones get. One partition of the window is the children of one node, a row each.
    """
    dec = lambda c: c.cast(DEC)
    by = Window.partitionBy(*parent).orderBy((F.col("capacity").cast("double") / F.col("weight")), "node_key")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rest = dec(F.col(budget)) - F.coalesce(F.sum("capacity").over(before).cast(DEC), dec(F.lit(0)))
    df = nodes.withColumn("_rest", F.greatest(rest, dec(F.lit(0)))).withColumn("_w", F.sum("weight").over(after).cast("long"))
    df = df.withColumn("_full", dec(F.col("capacity")) * F.col("_w") <= F.col("_rest") * F.col("weight"))
    first = Window.partitionBy(*parent)
    df = df.withColumn("_level", F.min(F.when(~F.col("_full"), F.struct(F.col("capacity").cast("double") / F.col("weight"), "node_key", "_rest", "_w"))).over(first))
    part = F.expr(f"cast(floor(cast(_level._rest as {DEC}) * weight / _level._w) as long)")
    return df.withColumn(out, F.when(F.col("_full"), F.col("capacity")).otherwise(F.least(part, F.col("capacity")))).drop("_rest", "_w", "_full", "_level")


def budgets(leaves: DataFrame, total_share: tuple[int, int], weights: dict, max_epochs: int) -> DataFrame:
    """Per leaf: its tokens and its budget. weights: {'domain': {name: int}, 'lang': {name: int}}, 1 where unnamed.
    The root's budget is total_share (a, b), a/b of all tokens: one number for the driver."""

    def weight(level: str, c: str) -> Column:
        out = F.lit(1)
        for name, w in weights.get(level, {}).items():
            out = F.when(F.col(c) == name, F.lit(w)).otherwise(out)
        return out.cast("long")

    a, b = total_share
    tokens_in_all = leaves.agg(F.sum("leaf_tokens")).first()[0] or 0
    leaf = leaves.withColumn("capacity", F.col("leaf_tokens") * max_epochs)
    lang = leaf.groupBy("m_domain", "m_lang").agg(F.sum("capacity").alias("capacity"))
    domain = lang.groupBy("m_domain").agg(F.sum("capacity").alias("capacity"))
    d = domain.withColumn("root_budget", F.lit(tokens_in_all * a // b).cast("long")).withColumn("weight", weight("domain", "m_domain")).withColumn("node_key", F.col("m_domain"))
    d = share(d, ["root_budget"], "root_budget", "domain_budget").select("m_domain", "domain_budget")
    g = lang.join(d, "m_domain").withColumn("weight", weight("lang", "m_lang")).withColumn("node_key", F.col("m_lang"))
    g = share(g, ["m_domain"], "domain_budget", "lang_budget").select("m_domain", "m_lang", "domain_budget", "lang_budget")
    s = leaf.join(g, ["m_domain", "m_lang"]).withColumn("weight", weight("source", "m_source")).withColumn("node_key", F.col("m_source"))
    return share(s, ["m_domain", "m_lang"], "lang_budget", "leaf_budget").drop("weight", "node_key", "capacity")


def cuts(docs: DataFrame, *, total_share: tuple[int, int], weights: dict, domains: list[str], max_epochs: int, seed: str) -> DataFrame:
    """A row per leaf: leaf_budget, whole_epochs, and cut_key, the last order key that its last epoch takes (null: none).

    total_share (a, b): the root's budget is a/b of the tokens in the table.
    """
    return cuts_of(leafed(docs, domains), total_share=total_share, weights=weights, max_epochs=max_epochs, seed=seed)


def leafed(docs: DataFrame, domains: list[str]) -> DataFrame:
    """with_leaf, written: the texts are read and their words counted once."""
    return written(with_leaf(docs, domains), "mix-leaf")


def cuts_of(d: DataFrame, *, total_share: tuple[int, int], weights: dict, max_epochs: int, seed: str) -> DataFrame:
    """cuts() of documents that have their leaf and tokens."""
    key = ["m_domain", "m_lang", "m_source"]
    leaves = small(d.groupBy(*key).agg(F.sum("m_tokens").alias("leaf_tokens"), F.count(F.lit(1)).alias("leaf_docs")))
    plan = budgets(leaves, total_share, weights, max_epochs)
    plan = plan.withColumn("whole_epochs", F.when(F.col("leaf_tokens") > 0, F.expr("leaf_budget div leaf_tokens")).otherwise(F.lit(max_epochs)).cast("long"))
    plan = plan.withColumn("left_tokens", F.col("leaf_budget") - F.col("whole_epochs") * F.col("leaf_tokens"))
    plan = plan.withColumn("ranges", F.ceil(F.col("leaf_docs") / RANGE_ROWS).cast("long"))
    plan = small(plan)
    open_ = plan.filter("leaf_tokens > 0 and left_tokens > 0").select(*key, "whole_epochs", "left_tokens", "ranges")
    k = d.join(maybe_broadcast(open_), key).withColumn("order_key", order_key(seed, F.col("whole_epochs"), F.col("doc_id")))
    k = k.withColumn("range_no", F.expr(f"cast(cast(order_key as {DEC}) * ranges div {1 << 60} as long)"))
    per = k.groupBy(*key, "range_no", "left_tokens").agg(F.sum("m_tokens").alias("range_tokens"))
    before = Window.partitionBy(*key).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("tokens_before", F.coalesce(F.sum("range_tokens").over(before), F.lit(0)))
    edge = per.filter("tokens_before <= left_tokens and tokens_before + range_tokens > left_tokens").select(*key, "range_no", "tokens_before")
    inside = k.join(maybe_broadcast(edge), [*key, "range_no"]).groupBy(*key, "range_no", "left_tokens", "tokens_before", "order_key").agg(F.sum("m_tokens").alias("key_tokens"))
    upto = Window.partitionBy(*key, "range_no").orderBy("order_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("upto", F.col("tokens_before") + F.sum("key_tokens").over(upto))
    last_in = inside.groupBy(*key).agg(F.max(F.when(F.col("upto") <= F.col("left_tokens"), F.col("order_key"))).alias("in_key"), F.min("range_no").alias("edge_range"))
    # nothing of the edge range fits: the cut is just before that range
    return plan.join(last_in, key, "left").withColumn(
        "cut_key", F.coalesce("in_key", F.expr(f"cast(ceil(cast(edge_range as {DEC}) * {1 << 60} / ranges) as long) - 1"))
    ).drop("in_key", "edge_range", "ranges")


def small(df: DataFrame) -> DataFrame:
    """The leaf table is used several times: computed once, in the shared folder."""
    return written(df, "leaves")


def maybe_broadcast(df: DataFrame) -> DataFrame:
    """A broadcast only for a table of proven size; a shuffle join (which AQE splits where a leaf is hot) beyond it."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def copies(plan_row_epochs: Column, cut: Column, key: Column) -> Column:
    return plan_row_epochs + F.when(cut.isNotNull() & (key <= cut), F.lit(1)).otherwise(F.lit(0))


def plan(docs: DataFrame, *, seed: str, domains: list[str], **options) -> DataFrame:
    """A row per document: doc_id, domain, lang, source, tokens, leaf_budget, copies (0: left out)."""
    leaf = leafed(docs, domains)
    c = small(cuts_of(leaf, seed=seed, **options))
    key = ["m_domain", "m_lang", "m_source"]
    d = leaf.join(maybe_broadcast(c.select(*key, "leaf_budget", "whole_epochs", "cut_key")), key)
    n = copies(F.col("whole_epochs"), F.col("cut_key"), order_key(seed, F.col("whole_epochs"), F.col("doc_id")))
    return d.select("doc_id", F.col("m_domain").alias("domain"), F.col("m_lang").alias("lang"), F.col("m_source").alias("source"), F.col("m_tokens").alias("tokens"), "leaf_budget", n.cast("long").alias("copies"))


def apply(docs: DataFrame, *, seed: str, domains: list[str], **options) -> DataFrame:
    """The rows of docs, each as often as its leaf's budget takes it; columns as they were.

    The cut of each leaf is one number, so the texts stay where they are: no row of docs is shuffled.
    """
    c = small(cuts(docs, seed=seed, domains=domains, **options))
    source = F.coalesce(F.col("source").cast("string"), F.lit(NONE))
    k = F.struct(domain_of(source, domains).alias("d"), F.coalesce(F.col("lang").cast("string"), F.lit(NONE)).alias("l"), source.alias("s"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), k.alias("leaf"), F.col("doc_id").alias("_id"))
    leaf = c.select(F.struct(F.col("m_domain").alias("d"), F.col("m_lang").alias("l"), F.col("m_source").alias("s")).alias("leaf"), "whole_epochs", "cut_key")
    n = copies(F.col("whole_epochs"), F.col("cut_key"), order_key(seed, F.col("whole_epochs"), F.col("_id")))
    taken = rows.join(maybe_broadcast(leaf), "leaf").withColumn("n", n.cast("int")).filter("n > 0")
    if options["max_epochs"] > 1:
        taken = taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return taken.select("row.*")
