"""Decimals of any length against Python's Decimal."""

from decimal import Context, Decimal, localcontext
from random import Random

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import cells, exact
from tallyspark.operators import recipe
from tallyspark.operators.reconcile import Spec, comparison_id, reconcile

CTX = Context(prec=4096)


def literals(rng, n):
    for _ in range(n):
        digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
        a, b = rng.choice([0, 1, 3, 15, 30, 80]), rng.choice([0, 1, 2, 11, 40])
        yield rng.choice(["", "-", "+"]) + (digits(a) or "0") + ("." + digits(b) if b else "") + rng.choice(["", "", f"e{rng.randrange(-40, 40)}"])
    yield from ("0", "-0", "0.00", "-0.0", "1e3", "1000", "1E-20", ".5", "5.", "00012", "-.25e2", "9" * 30, "-" + "9" * 30)


def test_plain_and_order_keys(spark):
    texts = list(literals(Random(5), 120))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    p = exact.plain(F.col("t"))
    got = df.select("t", p.alias("p"), exact.order_key(p).alias("k")).collect()
    assert all(Decimal(r.p) == Decimal(r.t) and "e" not in r.p.lower() for r in got)
    with localcontext(CTX):
        assert [Decimal(r.t) for r in sorted(got, key=lambda r: r.k)] == sorted(Decimal(t) for t in texts)
    assert all(r.k == exact.order_key_of(r.t) for r in got)
    bad = spark.createDataFrame([(t,) for t in ("", ".", "e5", "1e", "NaN", "1e9999", "--1", "1_0", None)], "t string")
    assert bad.filter(exact.plain(F.col("t")).isNotNull()).count() == 0


@pytest.mark.parametrize("tolerance", ["0", "0.01", "1e-30", "1" + "0" * 40])
def test_within(spark, tolerance):
    rng = Random(tolerance)
    pairs = []
    with localcontext(CTX):
        for t in literals(rng, 60):
            gap = Decimal(tolerance) * rng.choice([0, 1, -1, 2]) + Decimal(rng.choice(["0", "1e-60", "-1e-60"]))
            pairs.append((t, format(Decimal(t) + gap, "f")))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", exact.within(exact.plain(F.col("a")), exact.plain(F.col("b")), tolerance).alias("x")).collect()
    with localcontext(CTX):
        assert [r.x for r in got] == [abs(Decimal(r.a) - Decimal(r.b)) <= Decimal(tolerance) for r in got]


def table(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "no long, key string, amount string")
    return recipe.cast(cells.to_cells(df, "no", columns=["key", "amount"]), "c2", "decimal")[0]


def test_sums_of_any_length(spark):
    rng = Random(8)
    rows = [(rng.choice("abcd"), t) for t in literals(rng, 200)] + [("short", "1.5"), ("short", "-0.25"), ("bad", "x"), ("bad", "9" * 40), ("zero", "1e-20"), ("zero", "-1e-20")]
    got = {r.c1_value: (r.c2_kind, r.c2_total) for r in recipe.group_summary(table(spark, rows), ["c1"], ["c2"]).collect()}
    assert got["bad"] == ("error", None) and got["short"] == ("decimal", "1.25") and got["zero"] == ("decimal", "0." + "0" * 20)
    with localcontext(CTX):
        for k in "abcd":
            assert got[k][0] == "decimal" and Decimal(got[k][1]) == sum(Decimal(t) for key, t in rows if key == k)


def test_comparisons_do_not_round(spark):
    rows = [("a", "1.0000000000001"), ("b", "9" * 30), ("c", "1"), ("d", "1.000"), ("e", "1e-20"), ("f", "-" + "9" * 30), ("g", "bad")]
    kept, errors = recipe.keep_compared(table(spark, rows), "c2", "gt", "decimal", "1")
    assert sorted(r.c1.value for r in kept.collect()) == ["a", "b"] and [r.raw for r in errors.collect()] == ["bad"]
    kept, _ = recipe.keep_compared(table(spark, rows), "c2", "between", "decimal", "0.00000000000000000001", "1.0")
    assert sorted(r.c1.value for r in kept.collect()) == ["c", "d", "e"]


def test_amounts_and_text_keys(spark):
    def side(rows):
        return cells.to_cells(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "no long, key string, amount string"), "no", columns=["key", "amount"])

    left = side([("a", "1.00000000001"), ("b", "1e3"), ("c", "9" * 40), ("Café ", "1"), ("STRASSE", "2"), ("K", "3")])
    right = side([("a", "1.00000000002"), ("b", "1000"), ("c", "9" * 39 + "8"), ("café", "1"), ("straße", "2"), ("K", "3")])
    spec = Spec((("c1", "c1"),), (("c2", "c2"),), frozenset({"c2"}), type_policy="text", trim_text=True, casefold_text=True)
    got = {r.L.c1.value: r.category for r in reconcile(left, right, spec).collect()}
    assert got == {"a": "different", "b": "same", "c": "different", "Café ": "same", "STRASSE": "same", "K": "same"}
    ids = [comparison_id("r1", r, spec, left, t) for r, t in (("r2", right), ("r2", right.repartition(3)), ("r3", right), ("r2", left))]
    assert ids[0] == ids[1] and len(set(ids)) == 3
