"""Text: normal forms, comparable values, line search, chunks and diffs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def folded(s: pd.Series, trim: pd.Series, fold: pd.Series) -> pd.Series:
    """NFC, then without white space at its ends and casefolded, as asked."""

    def one(x: str | None, t: bool, f: bool) -> str | None:
        if x is None:
            return None
        x = unicodedata.normalize("NFC", x)
        x = x.strip() if t else x
        return x.casefold() if f else x

    return pd.Series([one(*v) for v in zip(s, trim, fold, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def comparable(s: pd.Series) -> pd.Series:
    """NFKC, casefold, no white space."""
    return s.map(lambda x: None if x is None else "".join(unicodedata.normalize("NFKC", x).casefold().split()))


def collapsed(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def field_kind(c: Column) -> Column:
    """empty, date, identifier, amount, number or text; the first that fits."""
    t = F.trim(c)
    return (
        F.when(c.isNull() | (t == ""), "empty")
        .when(t.rlike(r"^\d{4}([-/.])\d{1,2}\1\d{1,2}$|^\d{4}年\d{1,2}月\d{1,2}日$"), "date")
        .when(t.rlike(r"^0\d+$|^\d{12,}$|^(?=.*\d)(?=.*[A-Za-z])[A-Za-z0-9#/_-]{6,}$"), "identifier")
        .when(t.rlike(r"^[(+-]?[¥$￥]?\d{1,3}(,\d{3})+(\.\d+)?\)?$|^[(+-]?[¥$￥]?\d+\.\d{2}\)?$|^\(\d+(\.\d+)?\)$"), "amount")
        .when(t.rlike(r"^[+-]?\d+(\.\d+)?%?$"), "number")
        .otherwise("text")
    )


def search_lines(docs: DataFrame, id_col: str, text_col: str, needle: str, context: int = 1) -> DataFrame:
    """id, line_no (from 1), line, before, after for lines that hold needle, case aside."""
    lines = docs.select(id_col, F.split(text_col, "\n").alias("_lines")).filter(F.exists("_lines", lambda x: F.lower(x).contains(needle.lower())))
    hit = lines.select(id_col, "_lines", F.posexplode("_lines").alias("at", "line")).filter(F.lower("line").contains(needle.lower()))
    before = F.array_join(F.expr(f"slice(_lines, greatest(1, at + 1 - {context}), least(at, {context}))"), "\n")
    after = F.array_join(F.expr(f"slice(_lines, at + 2, {context})"), "\n")
    return hit.select(id_col, (F.col("at") + 1).alias("line_no"), "line", before.alias("before"), after.alias("after"))


def chunk_bounds(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Character ranges whose UTF-8 has at most limit bytes, each starting up to overlap bytes before the last one's end."""
    if limit < 4 or not 0 <= overlap < limit:
        raise ValueError("a chunk needs 4 bytes and less overlap than that")
    size = [len(c.encode()) for c in text]
    out, start = [], 0
    while start < len(text):
        end, n = start, 0
        while end < len(text) and n + size[end] <= limit:
            n += size[end]
            end += 1
        out.append((start, end))
        if end == len(text):
            break
        back, n = end, 0
        while back > start + 1 and n + size[back - 1] <= overlap:
            back -= 1
            n += size[back]
        start = back
    return out


def _rows(**fields: T.DataType) -> T.ArrayType:
    """A type made without a session, as workers import this module, too."""
    return T.ArrayType(T.StructType([T.StructField(k, v) for k, v in fields.items()]))


@F.udf(_rows(no=T.IntegerType(), start=T.IntegerType(), end=T.IntegerType(), chunk=T.StringType()))
def chunks(text: str, limit: int, overlap: int):
    return [(i, a, b, text[a:b]) for i, (a, b) in enumerate(chunk_bounds(text or "", limit, overlap))]


def markdown_row(*cells: Column) -> Column:
    """A Markdown table row; pipes are escaped and line breaks become <br>."""
    esc = [F.regexp_replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), "\r?\n", "<br>") for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *esc), F.lit(" |"))
