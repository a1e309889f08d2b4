"""Fusion of several readings of the same tables: cells are aligned to a baseline, voted on and decided.

Each reading is a grid (by, row, col, text) of one source. A cell of the baseline is a unit. Other sources' cells join
it by cell correspondence (not by place, so a source that lost a row still votes on the others), and each unit ends in
one outcome:

* alignment_unreliable: a source's cells of this unit's table couldn't be placed for the most part;
* tie, insufficient_evidence: the candidates with most weight are several, or sources, coverage or support are too few;
* numeric_protection: a value that isn't plain text would be replaced, which policy forbids;
* suggestions_only: the policy never replaces;
* evidence_rule_passed: the winner takes the unit.

Only the last changes a value; all others keep the baseline's.

Texts are fused by lines: each source is aligned to the baseline by a cheapest edit, and lines that any source changes, joined
where changes of several sources touch, are the units; all else is common to all. A unit's candidates are what each source
has in its place, which may be no line at all. Where a source only moved lines, the unit's alignment is unreliable.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.alignment import changes
from tallyspark.operators.correspondence import correspond
from tallyspark.session import written

PLACED = ("anchor", "supported", "changed")


@dataclass(frozen=True)
class Policy:
    """Weights by source (1 unless named), and what a winner needs."""

    weights: dict[str, int] = field(default_factory=dict)
    least_sources: int = 2
    least_coverage: float = 0.5
    least_support: float = 0.6
    of_expected: bool = False
    replace: bool = True
    replace_numbers: bool = False
    reliable_share: float = 0.5


def is_text(value: Column) -> Column:
    """Blank, or without any digit: what the numeric protection doesn't cover."""
    return ~value.rlike(r"\d")


def decided(votes: DataFrame, unit: list[str], expected: int, policy: Policy) -> DataFrame:
    """unit, base, selected, reason, coverage, support, candidates, needs_review from votes (unit, source, value, base, reliable).

    A source votes once a unit. `base` and `reliable` are the same in all rows of a unit.
    """
    weight = F.coalesce(*(F.when(F.col("source") == s, F.lit(w)) for s, w in policy.weights.items()), F.lit(1)) if policy.weights else F.lit(1)
    c = votes.groupBy(*unit, "value").agg(F.sum(weight).alias("weight"), F.count(F.lit(1)).alias("sources"), F.min("base").alias("base"), F.min("reliable").alias("reliable"))
    numeric = F.coalesce(~is_text(F.col("value")), F.lit(False))
    # sources are few, so a unit has few candidates
    whole = Window.partitionBy(*unit)
    place = Window.partitionBy(*unit).orderBy(F.desc("weight"), F.asc_nulls_last("value"))
    c = c.withColumns({"no": F.row_number().over(place), "next": F.lead("weight").over(place), "valid": F.sum("sources").over(whole), "candidates": F.count(F.lit(1)).over(whole), "numeric": F.max(numeric).over(whole)})
    c = c.filter("no = 1").withColumns({"coverage": F.col("valid") / F.lit(max(1, expected)), "support": F.col("sources") / (F.lit(max(1, expected)) if policy.of_expected else F.col("valid"))})
    enough = (F.col("valid") >= policy.least_sources) & (F.col("coverage") >= policy.least_coverage) & (F.col("support") >= policy.least_support)
    reason = (
        F.when(~F.col("reliable"), "alignment_unreliable")
        .when(F.col("next") == F.col("weight"), "tie")
        .when(~enough, "insufficient_evidence")
        .when(F.col("numeric") & F.lit(not policy.replace_numbers), "numeric_protection")
        .when(~F.lit(policy.replace), "suggestions_only")
        .otherwise("evidence_rule_passed")
    )
    c = c.withColumn("reason", reason)
    review = (F.col("candidates") != 1) | (F.col("coverage") < 1) | ~F.col("reliable")
    return c.select(*unit, "base", F.when(F.col("reason") == "evidence_rule_passed", F.col("value")).otherwise(F.col("base")).alias("selected"), "reason", "coverage", "support", "candidates", review.alias("needs_review"))


def fuse(sources: dict[str, DataFrame], baseline: str, by: list[str], policy: Policy = Policy()) -> DataFrame:
    """by, row, col, base, selected, reason, coverage, support, candidates, needs_review: a row a cell of the baseline.

    A source whose table has under `reliable_share` of the baseline's cells placed makes that table's alignment
    unreliable. A source that lacks a table, or whose cell has no counterpart, doesn't vote there.
    """
    base = sources[baseline].select(*by, "row", "col", F.coalesce("text", F.lit("")).alias("base"))
    ballots, bad = [base.select(*by, "row", "col", F.lit(baseline).alias("source"), F.col("base").alias("value"))], []
    for name, cells in sources.items():
        if name == baseline:
            continue
        found = written(correspond(sources[baseline], cells, by, settle=True), "found")
        placed = found.filter(F.col("outcome").isin(*PLACED))
        other = cells.select(*by, F.col("row").alias("row_b"), F.col("col").alias("col_b"), F.coalesce("text", F.lit("")).alias("value"))
        ballots.append(placed.join(other, [*by, "row_b", "col_b"]).select(*by, "row", "col", F.lit(name).alias("source"), "value"))
        have = cells.select(*by).distinct()
        share = found.join(have, by, "left_semi").groupBy(*by).agg((F.count_if(F.col("outcome").isin(*PLACED)) / F.count(F.lit(1))).alias("share"))
        bad.append(share.filter(F.col("share") < policy.reliable_share).select(*by))
    votes = reduce(DataFrame.unionByName, ballots).join(base, [*by, "row", "col"])
    if bad:
        votes = votes.join(reduce(DataFrame.unionByName, bad).distinct().withColumn("bad", F.lit(True)), by, "left").withColumn("reliable", F.col("bad").isNull()).drop("bad")
    else:
        votes = votes.withColumn("reliable", F.lit(True))
    return decided(votes, [*by, "row", "col"], len(sources), policy)


UNITS = "array<struct<unit:int,a0:int,a1:int,values:array<struct<source:string,value:string>>,base:string,reliable:boolean>>"


def text_units(base: str, others: dict[str, str], name: str) -> list[dict]:
    """The units of a baseline text and other readings: its lines a0 to a1 (end exclusive), what each source has there
    (null: no line), and whether all sources could be aligned there."""
    lines = base.split("\n")
    found = {k: (v.split("\n"), changes(base, v)) for k, v in others.items()}
    spans: list[list[int]] = []
    for a0, a1 in sorted((c["a0"], c["a1"]) for _, all_ in found.values() for c in all_):
        if spans and a0 <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], a1)
        else:
            spans.append([a0, a1])
    out = []
    for no, (a0, a1) in enumerate(spans):
        text = lambda x: "\n".join(x) if x else None
        values, reliable = [{"source": name, "value": text(lines[a0:a1])}], True
        for k, (other, all_) in found.items():
            inside = [c for c in all_ if a0 <= c["a0"] and c["a1"] <= a1]
            # how far the source's lines are shifted before the unit, and what the unit adds
            shift = sum((c["b1"] - c["b0"]) - (c["a1"] - c["a0"]) for c in all_ if c["a1"] <= a0 and c not in inside)
            more = sum((c["b1"] - c["b0"]) - (c["a1"] - c["a0"]) for c in inside)
            values.append({"source": k, "value": text(other[a0 + shift : a1 + shift + more])})
            reliable = reliable and not any(c["moved"] for c in inside)
        out.append({"unit": no, "a0": a0, "a1": a1, "values": values, "base": values[0]["value"], "reliable": reliable})
    return out


def fuse_texts(sources: dict[str, DataFrame], baseline: str, by: list[str], policy: Policy = Policy()) -> tuple[DataFrame, DataFrame]:
    """(by, text: the fused texts; by, unit, a0, a1 and what decided() gives for each unit). sources: (by, text), at most a
    row for each key; a source without a key's text doesn't vote on it, and keys that the baseline lacks are left out."""
    names = [n for n in sources if n != baseline]
    joined = sources[baseline].select(*by, F.coalesce("text", F.lit("")).alias("_base"))
    for i, n in enumerate(names):
        joined = joined.join(sources[n].select(*by, F.col("text").alias(f"_t{i}")), by, "left")
    schema = joined.select(*by, "_base")
    fields = ", ".join(f"`{c}` {t}" for c, t in schema.dtypes) + f", units {UNITS}"
    value = pa.struct([("source", pa.string()), ("value", pa.string())])
    kind = pa.list_(pa.struct([("unit", pa.int32()), ("a0", pa.int32()), ("a1", pa.int32()), ("values", pa.list_(value)), ("base", pa.string()), ("reliable", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [batch.column(len(by) + 1 + i).to_pylist() for i in range(len(names))]
            found = [text_units(b, {n: t[r] for n, t in zip(names, texts, strict=True) if t[r] is not None}, baseline) for r, b in enumerate(batch.column(len(by)).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(by) + 1)), pa.array(found, kind)], [*by, "_base", "units"])

    docs = written(joined.mapInArrow(run, fields), "text-units")
    units = docs.select(*by, F.explode("units").alias("u")).select(*by, "u.*")
    votes = units.select(*by, "unit", "base", "reliable", F.explode("values").alias("v")).select(*by, "unit", "base", "reliable", "v.source", "v.value")
    outcome = written(decided(votes, [*by, "unit"], len(sources), policy).join(units.select(*by, "unit", "a0", "a1"), [*by, "unit"]), "text-outcomes")
    picks = outcome.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("a0", "a1", "selected"))).alias("picks"))  # a text's own units
    own = lambda x: F.when(x["selected"].isNull(), F.array().cast("array<string>")).otherwise(F.split(x["selected"], "\n", -1))
    lines = F.split("_base", "\n", -1)
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, x: F.struct(F.concat(acc["out"], F.slice("_lines", acc["at"] + 1, x["a0"] - acc["at"]), own(x)).alias("out"), x["a1"].alias("at"))
    whole = F.aggregate("picks", start, step, lambda acc: F.concat(acc["out"], F.slice("_lines", acc["at"] + 1, F.size("_lines"))))
    fused = docs.select(*by, "_base").join(picks, by, "left").withColumn("_lines", lines)
    return fused.select(*by, F.when(F.col("picks").isNull(), F.col("_base")).otherwise(F.array_join(whole, "\n")).alias("text")), outcome
