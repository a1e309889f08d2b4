"""Literal sources: CSV that keeps quotes apart, read in blocks, and XLSX cells from their XML, a file a row."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.session import written

#: fixed values of the import contract
ENCODINGS = ("utf-8", "utf-8-sig", "gb18030", "utf-16")
DELIMITERS = (",", "\t", ";", "|")
#: files whose headers may be broadcast
MANY_FILES = 10_000


def csv_records(text: str, delimiter: str) -> list[list[tuple[str, bool]]]:
    """RFC 4180 records as (field, was quoted); broken quotes raise."""
    out, row, field, quoted, i, n = [], [], [], False, 0, len(text)
    started = False

    def end_field():
        nonlocal field, quoted, started
        row.append(("".join(field), quoted))
        field, quoted, started = [], False, False

    while i < n:
        c = text[i]
        if c == '"' and not started:
            started = quoted = True
            i += 1
            while True:
                j = text.find('"', i)
                if j < 0:
                    raise ValueError("a quote isn't closed")
                field.append(text[i:j])
                if text[j + 1 : j + 2] == '"':
                    field.append('"')
                    i = j + 2
                else:
                    i = j + 1
                    break
            if i < n and text[i] not in (delimiter, "\r", "\n"):
                raise ValueError("text after a closing quote")
        elif c == delimiter:
            end_field()
            i += 1
            if i == n:
                end_field()
                out.append(row)
                row = []
        elif c in "\r\n":
            end_field()
            out.append(row)
            row = []
            i += 2 if text[i : i + 2] == "\r\n" else 1
        elif c == '"':
            raise ValueError("a quote inside a plain field")
        else:
            started = True
            field.append(c)
            i += 1
    if started or field or row:
        end_field()
        out.append(row)
    return out


CELL = "struct<kind:string,raw:string,value:string,formula:string,warning:string>"
RECORDS = "array<array<struct<field:string,quoted:boolean>>>"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """path, block, at, line, quotes: the lines of all files, as bytes. Spark cuts a large file into blocks that tasks
    read by themselves; at grows along each block."""
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    place = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
    return spark.read.option("lineSep", "\n").text(path).select(*place, F.col("value").cast("binary").alias("line"), quotes.alias("quotes"))


def _before(df: DataFrame, count: str, name: str) -> DataFrame:
    """df with the sum of `count` over all that stands before a row in its file: sums of blocks, and inside its block."""
    earlier = lambda w: F.coalesce(F.sum(count).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = df.groupBy("path", "block").agg(F.sum(count).alias(count))
    blocks = blocks.select("path", "block", earlier(Window.partitionBy("path").orderBy("block")).alias("_blocks"))  # a row a block
    return df.join(blocks, ["path", "block"]).withColumn(name, F.col("_blocks") + earlier(Window.partitionBy("path", "block").orderBy("at"))).drop("_blocks")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """path, block, at, first, lines: lines that belong together. A line begins a piece if an even number of quotes stands
    before it in its file; else it goes on inside a quoted field."""
    lines = _before(written(_lines(spark, path), "csv-lines"), "quotes", "before")
    start = F.when(F.col("before") % 2 == 0, F.struct("block", "at"))
    inside = Window.partitionBy("path", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("start", F.last(start, ignorenulls=True).over(inside))
    # what a block goes on with at its beginning: the last piece that earlier blocks begin
    last = lines.groupBy("path", "block").agg(F.max("start").alias("last"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select("path", "block", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    lines = lines.join(last, ["path", "block"]).withColumn("start", F.coalesce("start", "carried"))
    together = F.sort_array(F.collect_list(F.struct("block", "at", "line")))["line"]
    top = (F.col("block") == 0) & F.lag("at").over(Window.partitionBy("path", "block").orderBy("at")).isNull()
    pieces = lines.withColumn("top", top).groupBy("path", "start").agg(F.max("top").alias("first"), together.alias("lines"))
    return pieces.select("path", "start.block", "start.at", "first", "lines")


def _cells(record: str) -> Column:
    """The cells of a record; one whose number of fields isn't its header's raises."""
    cell = lambda f: F.struct(
        F.when((f["field"] == "") & ~f["quoted"], "null").otherwise("text").alias("kind"),
        *(F.when((f["field"] != "") | f["quoted"], f["field"]).alias(n) for n in ("raw", "value")),
        F.lit(None).cast("string").alias("formula"),
        F.lit(None).cast("string").alias("warning"),
    )
    fits = F.size(record) == F.size("header")
    wrong = F.raise_error(F.concat(F.lit("record "), F.col("source_row").cast("string"), F.lit(" has "), F.size(record).cast("string"), F.lit(" fields, not "), F.size("header").cast("string")))
    return F.when(fits, F.transform(record, cell)).otherwise(wrong)


def read_csv(spark: SparkSession, path: str, encoding: str = "utf-8", delimiter: str = ",", header_row: int | None = 1) -> DataFrame:
    """path, source_row, header, cells: each record of each file. An empty plain field is a null cell, "" a text cell.

    Large files are cut at line ends and read by many tasks; the number of quotes before a line, summed block by block,
    says whether it begins a record, and records are numbered the same way. Only UTF-16 files, whose line ends can't be
    found in the bytes, are read whole by a task each. A byte order mark isn't part of the first header. A quote that
    is never closed is an error; the rest of its file is one piece until then. Files without records have no rows.
    """
    if encoding not in ENCODINGS or delimiter not in DELIMITERS or (header_row is not None and not 1 <= header_row <= 1000):
        raise ValueError("unknown encoding, delimiter or header row")
    coding = "utf-8" if encoding == "utf-8-sig" else encoding

    @F.udf(RECORDS)
    def parse(lines: list[bytes], first: bool):
        text = b"\n".join(lines).decode(coding)
        return csv_records((text.removeprefix("\ufeff") if first else text) + "\n", delimiter)

    @F.udf(RECORDS)
    def parse_file(content: bytes):
        text = content.decode(coding).removeprefix("\ufeff")
        return csv_records(text if text.endswith(("\n", "\r")) or not text else text + "\n", delimiter)

    if encoding == "utf-16":
        pieces = spark.read.format("binaryFile").load(path).select("path", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("at"), parse_file("content").alias("records"))
    else:
        pieces = _pieces(spark, path).select("path", "block", "at", parse("lines", "first").alias("records"))
    pieces = _before(written(pieces.withColumn("n", F.size("records").cast("long")), "csv-records"), "n", "before")
    rows = pieces.select("path", "before", F.posexplode("records").alias("no", "record")).select("path", (F.col("before") + F.col("no") + 1).alias("source_row"), "record")
    names = F.transform("record", lambda f: f["field"])
    if header_row:
        headers = rows.filter(F.col("source_row") == header_row).select("path", names.alias("header"))
        few = headers.limit(MANY_FILES + 1).count() <= MANY_FILES
        rows = rows.filter(F.col("source_row") > header_row).join(F.broadcast(headers) if few else headers, "path")
    else:
        first = rows.filter("source_row = 1").select("path", F.transform("record", lambda f: F.lit(None).cast("string")).alias("header"))
        few = first.limit(MANY_FILES + 1).count() <= MANY_FILES
        rows = rows.join(F.broadcast(first) if few else first, "path")
    return rows.select("path", "source_row", "header", _cells("record").alias("cells"))


#: stands for the sheet that a workbook opens with; no sheet can have a name with stars
ACTIVE = "*active*"
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def xlsx_cells(content: bytes, sheet: str | None = None) -> list[tuple]:
    """(row, col, kind, raw, value, formula, warning) of the cells of a sheet (the first unless named, or ACTIVE)."""
    z = zipfile.ZipFile(io.BytesIO(content))
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    sheets = book.findall("m:sheets/m:sheet", _NS)
    if sheet == ACTIVE:
        view = book.find("m:bookViews/m:workbookView", _NS)
        found = sheets[int(view.get("activeTab", "0")) if view is not None else 0 :][:1]
    else:
        found = [s for s in sheets if sheet is None or s.get("name") == sheet]
    if not found:
        raise ValueError(f"no sheet {sheet!r}")
    target = rels[found[0].get(_REL)]
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
    out = []
    for c in ElementTree.fromstring(z.read("xl/" + target.lstrip("/").removeprefix("xl/"))).iter(f"{{{_NS['m']}}}c"):
        letters, row = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
        col = 0
        for x in letters:
            col = col * 26 + ord(x) - 64
        kind, v, f = c.get("t", "n"), c.find("m:v", _NS), c.find("m:f", _NS)
        raw = v.text if v is not None else None
        formula = "=" + (f.text or "") if f is not None else None
        if kind == "inlineStr":
            raw = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
        if formula is not None and raw is None:
            out.append((int(row), col, "unknown_formula", formula, None, formula, "formula_cache_unknown"))
        elif kind == "s":
            out.append((int(row), col, "text", shared[int(raw)], shared[int(raw)], formula, None))
        elif kind in ("str", "inlineStr"):
            out.append((int(row), col, "text", raw or "", raw or "", formula, None))
        elif kind == "b":
            out.append((int(row), col, "boolean", raw, "true" if raw == "1" else "false", formula, None))
        elif kind == "e":
            out.append((int(row), col, "error", raw, raw, formula, None))
        elif raw is None:
            out.append((int(row), col, "null", None, None, formula, None))
        else:
            digits = len(re.sub(r"[eE].*", "", raw).replace("-", "").replace(".", "").lstrip("0"))
            out.append((int(row), col, "integer" if re.fullmatch(r"-?\d+", raw) else "decimal", raw, raw, formula, "precision_over_15_digits" if digits > 15 else None))
    return out


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """path, row, col and the cell, for each stored cell of a sheet of each file."""

    @F.udf("array<struct<row:int,col:int,kind:string,raw:string,value:string,formula:string,warning:string>>")
    def parse(content: bytes):
        return xlsx_cells(content, sheet)

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.explode(parse("content")).alias("c")).select("path", "c.*")


def sheet_rows(cells: DataFrame) -> DataFrame:
    """path, source_row, cells: the rows of sheets (read_xlsx) from the first to the last that has a cell, each as wide as
    its sheet. Cells that aren't stored are null cells. A row is put together from its own cells only."""
    names = ("kind", "raw", "value", "formula", "warning")
    size = cells.groupBy("path").agg(F.max("row").alias("rows"), F.max("col").alias("cols"))
    every = size.select("path", "cols", F.explode(F.sequence(F.lit(1), "rows")).alias("row"))
    stored = cells.groupBy("path", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", F.struct(*names)))).alias("stored"))
    none = F.struct(F.lit("null").alias("kind"), *(F.lit(None).cast("string").alias(n) for n in names[1:]))
    rows = every.join(stored, ["path", "row"], "left").withColumn("stored", F.coalesce("stored", F.expr(f"cast(map() as map<int, {CELL}>)")))
    dense = F.transform(F.sequence(F.lit(1), "cols"), lambda c: F.coalesce(F.try_element_at("stored", c), none))
    return rows.select("path", F.col("row").cast("long").alias("source_row"), dense.alias("cells"))


def read_xlsx_table(spark: SparkSession, path: str, sheet: str | None = None, header_row: int = 1) -> DataFrame:
    """path, source_row, header, cells: the rows below a sheet's header row. A row that has a value beyond the last header raises,
    as does a header cell without a text; shorter rows end in null cells."""
    rows = sheet_rows(read_xlsx(spark, path, sheet))
    head = rows.filter(F.col("source_row") == header_row).select("path", F.col("cells")["value"].alias("header"))
    width = F.coalesce(F.array_max(F.transform(F.sequence(F.lit(1), F.size("header")), lambda i: F.when(F.get("header", i - 1).isNotNull(), i))), F.lit(0))
    named = F.slice("header", F.lit(1), width)
    blank = F.raise_error(F.concat(F.lit("row "), F.lit(str(header_row)), F.lit(" has a header without a text")))
    head = head.select("path", F.when(F.exists(named, lambda h: h.isNull() | (F.trim(h) == "")), blank.cast("array<string>")).otherwise(named).alias("header"))
    few = head.limit(MANY_FILES + 1).count() <= MANY_FILES
    rows = rows.filter(F.col("source_row") > header_row).join(F.broadcast(head) if few else head, "path")
    beyond = F.exists(F.slice("cells", F.size("header") + 1, F.size("cells")), lambda c: c["kind"] != "null")
    wide = F.raise_error(F.concat(F.lit("row "), F.col("source_row").cast("string"), F.lit(" has more values than headers"))).cast(f"array<{CELL}>")
    return rows.select("path", "source_row", "header", F.when(beyond, wide).otherwise(F.slice("cells", F.lit(1), F.size("header"))).alias("cells"))


def xlsx_as_csv(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """path, source_row, line: the active sheet's values as CSV lines. Fields with the delimiter, quotes or line breaks are
    quoted; cells without a value, and formulas that were never computed, are empty fields."""

    def field(c: Column) -> Column:
        v = F.coalesce(c["value"], F.lit(""))
        special = v.contains(delimiter) | v.contains('"') | v.contains("\n") | v.contains("\r")
        return F.when(special, F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)

    return sheet_rows(read_xlsx(spark, path, ACTIVE)).select("path", "source_row", F.array_join(F.transform("cells", field), delimiter).alias("line"))


def verified(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """The binary rows below path; an error where a file's hash isn't the given one."""
    files = spark.read.format("binaryFile").load(path)
    own = F.sha2("content", 256)
    return files.withColumn("content", F.when(own == sha256, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("the content changed: "), F.col("path")))))
