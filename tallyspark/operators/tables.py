"""Tables inside documents: HTML and Markdown to cells, grids, fingerprints."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBERS = [T.StructField(n, T.IntegerType()) for n in ("table_no", "row", "col", "row_span", "col_span")]
CELLS = T.ArrayType(T.StructType([*_NUMBERS, T.StructField("text", T.StringType()), T.StructField("is_header", T.BooleanType())]))


TABLES = T.ArrayType(
    T.StructType(
        [
            T.StructField("table_no", T.IntegerType()),
            T.StructField("caption", T.StringType()),
            *(T.StructField(n, T.IntegerType()) for n in ("start", "end", "n_rows", "n_cols", "n_cells")),
            T.StructField("error", T.StringType()),
            T.StructField("error_at", T.IntegerType()),
        ]
    )
)
#: spans run from 1 to here, and a table has so many slots at most
MAX_SPAN, MAX_SLOTS = 1000, 1_000_000


class _Table:
    """A table while it is read: its cells, the slots they take, and the first error with its place."""

    def __init__(self, no: int, start: int):
        self.no, self.start, self.end = no, start, None
        self.row, self.taken, self.cell, self.cells = -1, {}, None, []
        self.caption, self.in_caption = None, False
        self.error, self.error_at, self.slots = None, None, 0

    def fail(self, error: str, at: int) -> None:
        if self.error is None:
            self.error, self.error_at = error, at

    def close_cell(self) -> None:
        if self.cell is None:
            return
        words, height, width, header, at = self.cell
        self.cell = None
        mine = self.taken.setdefault(self.row, set())
        col = 0
        while col in mine:
            col += 1
        self.slots += height * width
        if self.slots > MAX_SLOTS:
            self.fail("too_large", at)
            height = width = 1
        for y in range(self.row, self.row + height):
            there = self.taken.setdefault(y, set())
            across = range(col, col + width)
            if not there.isdisjoint(across):
                self.fail("overlap", at)
            there.update(across)
        text = "\n".join(" ".join(line.split()) for line in "".join(words).split("\n")).strip()
        self.cells.append((self.no, self.row, col, height, width, text, header))

    def described(self) -> tuple:
        caption = " ".join("".join(self.caption).split()) if self.caption is not None else None
        n_rows, n_cols = (max((c[i] + c[i + 2] for c in self.cells), default=0) for i in (1, 2))
        return self.no, caption, self.start, self.end, n_rows, n_cols, len(self.cells), self.error, self.error_at


class _Reader(HTMLParser):
    """Tables of a page, nested ones too, with their places in the source."""

    def __init__(self, text: str):
        super().__init__(convert_charrefs=True)
        self.open, self.tables = [], []
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.feed(text)
        self.close()
        for t in self.open:  # what the page ends inside of
            t.close_cell()
            t.fail("unclosed", t.start)

    def place(self) -> int:
        line, col = self.getpos()
        return self.lines[line - 1] + col

    def span(self, t: _Table, value: str | None) -> int:
        """1 to MAX_SPAN; anything else is an error of the table and counts as 1."""
        if value is None:
            return 1
        v = value.strip()
        if v.isascii() and v.isdigit() and 1 <= int(v[:5]) <= MAX_SPAN:
            return int(v)
        t.fail("span", self.place())
        return 1

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append(_Table(len(self.tables), self.place()))
            self.tables.append(self.open[-1])
        if not self.open:
            return
        t = self.open[-1]
        if tag == "tr":
            t.close_cell()
            t.row += 1
        elif tag in ("td", "th"):
            t.close_cell()
            if t.row < 0:
                t.fail("cell_outside_row", self.place())
                t.row = 0
            a = dict(attrs)
            t.cell = [[], self.span(t, a.get("rowspan")), self.span(t, a.get("colspan")), tag == "th", self.place()]
        elif tag == "caption":
            t.in_caption, t.caption = True, []
        elif tag == "br" and t.cell:
            t.cell[0].append("\n")

    def handle_endtag(self, tag):
        if not self.open:
            return
        t = self.open[-1]
        if tag == "caption":
            t.in_caption = False
        if tag in ("td", "th", "tr", "table"):
            t.close_cell()
        if tag == "table":
            t.end = self.place()
            self.open.pop()

    def handle_data(self, data):
        if not self.open:
            return
        t = self.open[-1]
        if t.cell:
            t.cell[0].append(data)
        elif t.in_caption:
            t.caption.append(data)


def html_cells(text: str | None) -> list[tuple]:
    """The cells of all tables, table by table."""
    return [c for t in _Reader(text or "").tables for c in t.cells]


def html_tables(text: str | None) -> list[tuple]:
    """A row a table: its caption, where it starts and where its closing tag stands (null: it has none), its size, and its first error
    with its place: span, overlap, cell_outside_row, too_large or unclosed."""
    return [t.described() for t in _Reader(text or "").tables]


def markdown_cells(text: str | None) -> list[tuple]:
    """Pipe tables: a header row, a rule of dashes, rows. Pipes that are escaped or in code spans split nothing."""
    out, no, lines, i, fenced = [], 0, (text or "").split("\n"), 0, False

    def split(line: str) -> list[str]:
        code = [(m.start(), m.end()) for m in re.finditer(r"(`+)(?!`).+?(?<!`)\1(?!`)", line)]
        at = [m.start() for m in re.finditer(r"(?<!\\)\|", line) if not any(a <= m.start() < b for a, b in code)]
        cells = [line[a:b] for a, b in zip([0, *(x + 1 for x in at)], [*at, len(line)], strict=True)]
        if line.strip().startswith("|"):
            cells = cells[1:]
        if cells and not cells[-1].strip() and line.rstrip().endswith("|"):
            cells = cells[:-1]
        return [c.strip().replace("\\|", "|") for c in cells]

    while i < len(lines):
        if lines[i].lstrip().startswith("```"):
            fenced = not fenced
        rule = lines[i + 1] if i + 1 < len(lines) else ""
        if not fenced and "|" in lines[i] and re.fullmatch(r"\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*", rule) and "-" in rule and len(split(lines[i])) == len(split(rule)):
            width, row = len(split(rule)), 0
            for header, line in [(True, lines[i]), *((False, x) for x in _rows(lines[i + 2 :]))]:
                for c, cell in enumerate((split(line) + [""] * width)[:width]):
                    out.append((no, row, c, 1, 1, cell, header))
                row += 1
            no += 1
            i += row + 1
        else:
            i += 1
    return out


def _rows(lines: list[str]):
    for line in lines:
        if "|" not in line or not line.strip():
            return
        yield line


parse_html = F.udf(html_cells, CELLS)
describe_html = F.udf(html_tables, TABLES)
parse_markdown = F.udf(markdown_cells, CELLS)


def cells_of(docs: DataFrame, id_col: str, text_col: str, markdown: bool = False) -> DataFrame:
    """One row per cell of each table of each document."""
    parse = parse_markdown if markdown else parse_html
    has = F.col(text_col).contains("|") if markdown else F.lower(text_col).contains("<table")
    return docs.filter(has).select(id_col, F.explode(parse(text_col)).alias("c")).select(id_col, "c.*")


def tables_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per HTML table of each document: table_no, caption, start, end, n_rows, n_cols, n_cells, error, error_at."""
    has = F.lower(text_col).contains("<table")
    return docs.filter(has).select(id_col, F.explode(describe_html(text_col)).alias("t")).select(id_col, "t.*")


def slots(cells: DataFrame, key: list[str]) -> DataFrame:
    """A row for each grid slot that a cell covers (its text with it)."""
    df = cells.withColumn("slot_row", F.explode(F.expr("sequence(row, row + row_span - 1)")))
    return df.withColumn("slot_col", F.explode(F.expr("sequence(col, col + col_span - 1)"))).select(*key, "slot_row", "slot_col", "text", "is_header")


def validate(cells: DataFrame, key: list[str]) -> DataFrame:
    """Per table: rows, columns, slots covered, overlaps, whether the grid is complete."""
    s = slots(cells, key).groupBy(*key, "slot_row", "slot_col").agg(F.count(F.lit(1)).alias("n"))
    g = s.groupBy(*key).agg((F.max("slot_row") + 1).alias("n_rows"), (F.max("slot_col") + 1).alias("n_cols"), F.count(F.lit(1)).alias("covered"), F.count_if(F.col("n") > 1).alias("overlaps"))
    return g.withColumn("complete", (F.col("overlaps") == 0) & (F.col("covered") == F.col("n_rows") * F.col("n_cols")))


def fingerprints(cells: DataFrame, key: list[str]) -> DataFrame:
    """Per table a hash of its structure and one of its contents."""
    shape = F.sort_array(F.collect_list(F.struct("row", "col", "row_span", "col_span", "is_header")))
    body = F.sort_array(F.collect_list(F.struct("row", "col", "text")))
    return cells.groupBy(*key).agg(F.sha2(F.to_json(shape), 256).alias("topology"), F.sha2(F.to_json(body), 256).alias("content"))


def to_csv_rows(cells: DataFrame, key: list[str]) -> DataFrame:
    """Rows of tables without spans whose grid is complete, as arrays of texts."""
    good = validate(cells, key).filter("complete").join(cells.groupBy(*key).agg(F.max(F.greatest("row_span", "col_span")).alias("m")).filter("m = 1"), key, "left_semi")
    g = cells.join(good.select(*key), key, "left_semi").groupBy(*key, "row").agg(F.sort_array(F.collect_list(F.struct("col", "text"))).alias("x"))
    return g.select(*key, "row", F.transform("x", lambda c: c["text"]).alias("cells"))
