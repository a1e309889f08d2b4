"""Pages of a filtered, ordered table behind cursors that are bound to what they were made for.

A cursor holds where its page ended (the order key of its last row), a hash of the filter and order, and the revision of
the table, and is signed. So a page is found by its key, not by counting rows off, and a cursor of another filter,
another order or a table that has changed since, or one that was made up, is refused instead of showing rows twice or never.

The revision is a count and a sum of row hashes over the filtered rows: one pass that combines on the map side. Where
a table carries a revision of its own (a commit number), give that and the pass is saved.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST = 1000


class CursorError(ValueError):
    """reason: malformed, forged, other_filter or changed."""

    def __init__(self, reason: str):
        super().__init__({"malformed": "this isn't a cursor", "forged": "the cursor's signature is wrong", "other_filter": "the cursor belongs to another filter or order", "changed": "the table has changed since the cursor was made"}[reason])
        self.reason = reason


@dataclass(frozen=True)
class Order:
    """A column of the order; the columns together must tell rows apart. Nulls come last."""

    column: str
    descending: bool = False

    def by(self) -> Column:
        return F.desc_nulls_last(self.column) if self.descending else F.asc_nulls_last(self.column)

    def after(self, value: Column) -> Column:
        """Whether the column lies behind a value (which may be null)."""
        c = F.col(self.column)
        behind = c < value if self.descending else c > value
        return F.coalesce(value.isNotNull() & (c.isNull() | behind), F.lit(False))


@dataclass(frozen=True)
class Page:
    rows: list[Row]
    cursor: str | None
    revision: str


def revision(df: DataFrame) -> str:
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)).cast("decimal(38,0)")).alias("h")).first()
    return f"{row.n}:{row.h}"


def _scope(filters: dict, order: list[Order]) -> str:
    body = {"filters": filters, "order": [[o.column, o.descending] for o in order]}
    return hashlib.sha256(json.dumps(body, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()


def _sign(body: bytes, secret: bytes) -> str:
    return hmac.new(secret, body, hashlib.sha256).hexdigest()


def make_cursor(state: dict, secret: bytes) -> str:
    body = json.dumps(state, sort_keys=True, ensure_ascii=False).encode()
    return base64.urlsafe_b64encode(body).decode() + "." + _sign(body, secret)


def read_cursor(cursor: str, secret: bytes) -> dict:
    try:
        text, mark = cursor.rsplit(".", 1)
        body = base64.b64decode(text.encode(), altchars=b"-_", validate=True)
    except (ValueError, AttributeError):
        raise CursorError("malformed") from None
    if not hmac.compare_digest(_sign(body, secret).encode(), mark.encode()):
        raise CursorError("forged")
    return json.loads(body)


def _literal(value: str | None, kind: T.DataType) -> Column:
    return F.lit(value).cast(kind)


def page(df: DataFrame, filters: dict, order: list[Order], limit: int, secret: bytes, cursor: str | None = None, stated: str | None = None) -> Page:
    """The rows of df with the filters' values (a list: any of them) in the given order, at most `limit` (1 to MOST) after
    the cursor. The page's cursor is None when nothing follows; one row more than the page is read to know."""
    if not 1 <= limit <= MOST:
        raise ValueError(f"a page has 1 to {MOST} rows")
    for name, value in filters.items():
        c = F.col(name)
        df = df.filter(c.isin(value) if isinstance(value, list) else c.isNull() if value is None else c == F.lit(value))
    scope = _scope(filters, order)
    state = read_cursor(cursor, secret) if cursor is not None else None
    if state is not None and state["scope"] != scope:
        raise CursorError("other_filter")
    now = stated if stated is not None else revision(df)
    if state is not None and state["revision"] != now:
        raise CursorError("changed")
    rows = df
    if state is not None:
        last = [_literal(v, df.schema[o.column].dataType) for v, o in zip(state["last"], order, strict=True)]
        behind = F.lit(False)
        for i, o in enumerate(order):
            level = o.after(last[i])
            for j in range(i):
                level = F.col(order[j].column).eqNullSafe(last[j]) & level
            behind = behind | level
        rows = rows.filter(behind)
    keys = [F.col(o.column).cast("string").alias(f"_key{i}") for i, o in enumerate(order)]
    got = rows.select("*", *keys).orderBy(*(o.by() for o in order)).limit(limit + 1).collect()  # at most MOST + 1 rows
    here = got[:limit]
    following = None
    if len(got) > limit:
        following = make_cursor({"scope": scope, "revision": now, "last": [here[-1][f"_key{i}"] for i in range(len(order))]}, secret)
    plain = [Row(**{c: r[c] for c in df.columns}) for r in here]
    return Page(plain, following, now)
