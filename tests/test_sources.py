import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import cells, text
from tallyspark.operators import components, facts, queue, tables
from tallyspark.operators.components import connected_components
from tallyspark.session import shared_dir
from tallyspark.sources import literal, sinks


def test_csv_keeps_null_empty_and_quotes_apart(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('id,value,note\r\n1,0,""\r\n2,,"a,b"\r\n3,x,"line\r\nbreak ""q"""\r\n'.encode())
    got = literal.read_csv(spark, str(tmp_path)).orderBy("source_row").collect()
    assert [[(c.kind, c.value) for c in r.cells] for r in got] == [
        [("text", "1"), ("text", "0"), ("text", "")],
        [("text", "2"), ("null", None), ("text", "a,b")],
        [("text", "3"), ("text", "x"), ("text", 'line\r\nbreak "q"')],
    ]
    assert got[0].header == ["id", "value", "note"] and got[0].source_row == 2


def test_csv_errors_and_encodings(spark, tmp_path):
    for bad in ('a,"b', 'a,"b"c', 'a,b"c'):
        with pytest.raises(ValueError):
            literal.csv_records(bad, ",")
    assert literal.csv_records("a;b\n;", ";") == [[("a", False), ("b", False)], [("", False), ("", False)]]
    (tmp_path / "b.csv").write_bytes("title\nid;名\n1;值\n".encode("utf-16"))
    got = literal.read_csv(spark, str(tmp_path), "utf-16", ";", 2).collect()
    assert [c.value for c in got[0].cells] == ["1", "值"] and got[0].source_row == 3
    (tmp_path / "b.csv").write_bytes(b"a,b\n1\n")
    with pytest.raises(Exception, match="1 fields"):
        literal.read_csv(spark, str(tmp_path)).collect()


def workbook():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>0070</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>1.50</v></c><c r="C1"><f>A1+1</f></c><c r="D1"><f>1+1</f><v>2</v></c><c r="E1" t="b"><v>1</v></c><c r="AA1"><v>9007199254740993</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_xlsx_cells(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook())
    got = {r.col: (r.kind, r.value, r.formula, r.warning) for r in literal.read_xlsx(spark, str(tmp_path)).collect()}
    assert got == {1: ("text", "0070", None, None), 2: ("decimal", "1.50", None, None), 3: ("unknown_formula", None, "=A1+1", "formula_cache_unknown"), 4: ("integer", "2", "=1+1", None), 5: ("boolean", "true", None, None), 27: ("integer", "9007199254740993", None, "precision_over_15_digits")}
    with pytest.raises(Exception, match="no sheet"):
        literal.read_xlsx(spark, str(tmp_path), "T").collect()
    with pytest.raises(Exception, match="content changed"):
        literal.verified(spark, str(tmp_path), "0" * 64).select("content").collect()


def test_guard_and_read_back(spark, tmp_path):
    # a formula is a sign of the four after any blanks or byte order marks
    t = [lead + sign + "1x" for lead in ("", "  ", "\t", "\n", "\r ", "\ufeff", " \ufeff\t") for sign in "=+-@*"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in t], "t string").select(sinks.safe_csv(F.col("t"))).collect()]
    assert got == [x if x.endswith("*1x") else "'" + x for x in t]
    df = cells.to_cells(spark.createDataFrame([(1, 'a,"b"\nc', None), (2, "", "é")], "no long, x string, y string"), "no", columns=["x", "y"])
    assert sinks.write_checked(sinks.flat(df), f"file://{tmp_path}/p") == 2
    assert sinks.write_checked(sinks.flat(df), f"file://{tmp_path}/c", "csv") == 2


def test_html_and_markdown_tables():
    html = "<table><tr><th rowspan=2>a</th><th>b</th></tr><tr><td>1<br>2</td></tr></table><table><tr><td>x</td></tr></table>"
    assert tables.html_cells(html) == [(0, 0, 0, 2, 1, "a", True), (0, 0, 1, 1, 1, "b", True), (0, 1, 1, 1, 1, "1\n2", False), (1, 0, 0, 1, 1, "x", False)]
    md = "text\n| a | b |\n|---|---|\n| `p|q` | r\\|s |\n\n```\n| no | table |\n|---|---|\n```\n"
    assert [c[5] for c in tables.markdown_cells(md)] == ["a", "b", "`p|q`", "r|s"]
    assert tables.html_cells(None) == tables.markdown_cells(None) == []


def test_overlapping_spans_make_an_incomplete_grid(spark):
    rows = [(1, 0, 0, 1, 2, "a", True), (1, 0, 1, 1, 1, "b", True), (2, 0, 0, 1, 1, "c", False)]
    df = spark.createDataFrame(rows, "t int, row int, col int, row_span int, col_span int, text string, is_header boolean")
    assert {r.t: (r.complete, r.overlaps) for r in tables.validate(df, ["t"]).collect()} == {1: (False, 1), 2: (True, 0)}


def test_facts_ladder(spark):
    schema = "entity string, work_item string, field string, value string, as_of string"
    a = [("Team", "w", "completion", "50%", "x"), ("Team", "w", "planned", "2026年10月31日", "x"), ("Team", "w", "owner", "Wang", "x"), ("Team", "w", "risk", "1", "x"), ("Team", "w", "risk", "2", "x"), ("Solo", "w", "owner", "Li", "x"), ("Team", "v", "status", "open", "x")]
    b = [("group", "w", "completion", "50.4%", "x"), ("group", "w", "planned", "2026-10-31", "x"), ("group", "w", "owner", "Zhao", "x"), ("group", "w", "risk", "1", "x"), ("group", "u", "status", "open", "x"), ("group", "v", "status", "open", "y")]
    alias = spark.createDataFrame([("Group", "Team")], "alias string, canonical string")
    kinds = {"completion": "percentage", "planned": "date"}
    got = {(r.entity, r.work_item, r.field): r.status for r in facts.align(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), kinds, 0.5, alias).collect()}
    assert got == {("team", "w", "completion"): "consistent", ("team", "w", "planned"): "consistent", ("team", "w", "owner"): "needs_semantic", ("team", "w", "risk"): "insufficient", ("solo", "w", "owner"): "insufficient", ("team", "u", "status"): "only_b", ("team", "v", "status"): "insufficient"}


def test_chunks_cover_texts_without_splitting_characters():
    t = "aé日" * 50
    got = text.chunk_bounds(t, 20, 6)
    assert got[0][0] == 0 and got[-1][1] == len(t)
    assert all(len(t[a:b].encode()) <= 20 for a, b in got) and all(x[1] >= y[0] > x[0] for x, y in zip(got, got[1:]))


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 50)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 1 for i in range(1, 50)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_components_of_edges_that_fill_several_parts(spark, monkeypatch):
    monkeypatch.setattr(components, "CONTRACT", 10)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 50)] + [(49, 130)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long").repartition(4)).collect()}
    assert got == dict.fromkeys([*range(1, 50), *range(100, 161)], 1)


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:
            master = "spark://somewhere:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session)


def test_cycle_of_parents_is_an_error(spark):
    with pytest.raises(ValueError):
        queue.ancestors(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "node long, parent long"))


def test_csv_in_blocks_is_csv_as_a_whole(spark, tmp_path):
    import random

    r = random.Random(8)
    field = lambda: r.choice(["", '""', "plain", "é名", '"a, b"', '"two\nlines"', '"win\r\ndows"', '"say ""x"" "', '"\n\n"', "﻿mark", '"""'[:2]])
    texts = {}
    for name in ("a", "b", "c"):
        lines = [",".join(field() for _ in range(3)) for _ in range(r.randint(30, 60))]
        texts[name] = r.choice(["\n", "\r\n"]).join(lines) + r.choice(["", "\n"])
    texts["d"], texts["e"] = "", "﻿" + texts["a"]
    for name, text_ in texts.items():
        (tmp_path / f"{name}.csv").write_bytes(text_.encode())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        found = literal.read_csv(spark, f"{tmp_path}/*.csv", header_row=None).collect()
        headed = literal.read_csv(spark, f"{tmp_path}/e.csv", header_row=1).orderBy("source_row").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = {(x.path[-5:-4], x.source_row): [(c.kind, c.value) for c in x.cells] for x in found}
    records = {k: literal.csv_records(v.removeprefix("﻿"), ",") for k, v in texts.items()}
    assert got == {(k, i): [("null", None) if f == "" and not q else ("text", f) for f, q in rec] for k, recs in records.items() for i, rec in enumerate(recs, 1)}
    assert headed[0].header == [f for f, _ in records["e"][0]] and len(headed) == len(records["e"]) - 1


def book(*sheets, active=0):
    """A workbook of sheets, each a list of rows of inline texts (None: no cell)."""
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    column = lambda i: chr(65 + i)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        names = "".join(f'<sheet name="s{i}" sheetId="{i + 1}" r:id="r{i}"/>' for i in range(len(sheets)))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{r}"><bookViews><workbookView activeTab="{active}"/></bookViews><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(len(sheets)))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for i, rows in enumerate(sheets):
            cells_ = lambda y, row: "".join(f'<c r="{column(x)}{y}" t="inlineStr"><is><t xml:space="preserve">{v}</t></is></c>' for x, v in enumerate(row) if v is not None)
            body = "".join(f'<row r="{y}">{cells_(y, row)}</row>' for y, row in enumerate(rows, 1) if row)
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{ns}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def test_workbooks_as_tables_and_csv(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(book([["ignored"]], [["id", "note"], ["1", 'a, "b"'], [], ["2", None, None], [None, "x\ny"]], active=1))
    lines = {x.source_row: x.line for x in literal.xlsx_as_csv(spark, str(tmp_path)).collect()}
    assert lines == {1: "id,note", 2: '1,"a, ""b"""', 3: ",", 4: "2,", 5: ',"x\ny"'}
    assert [[f for f, _ in r] for r in literal.csv_records("\n".join(lines[i] for i in sorted(lines)) + "\n", ",")] == [["id", "note"], ["1", 'a, "b"'], ["", ""], ["2", ""], ["", "x\ny"]]
    got = literal.read_xlsx_table(spark, str(tmp_path), "s1").orderBy("source_row").collect()
    assert [(x.source_row, x.header, [c.value for c in x.cells]) for x in got] == [(2, ["id", "note"], ["1", 'a, "b"']), (3, ["id", "note"], [None, None]), (4, ["id", "note"], ["2", None]), (5, ["id", "note"], [None, "x\ny"])]
    assert got[1].cells[0].kind == "null" and got[0].cells[0].kind == "text"
    (tmp_path / "a.xlsx").write_bytes(book([["title"], ["id", "note"], ["1", "2", "beyond"]]))
    with pytest.raises(Exception, match="more values than headers"):
        literal.read_xlsx_table(spark, str(tmp_path), header_row=2).collect()
    (tmp_path / "a.xlsx").write_bytes(book([["id", None, "note"], ["1", "2", "3"]]))
    with pytest.raises(Exception, match="without a text"):
        literal.read_xlsx_table(spark, str(tmp_path)).collect()


def test_long_texts_by_units(spark):
    texts = ["a" * 9, "\U0001f600" * 5, "\U0001f600" * 6, "a" * 11, "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(sinks.split_long(F.col("t"), 10)).collect()]
    assert got == [["a" * 9], ["\U0001f600" * 5], ["\U0001f600" * 5, "\U0001f600"], ["aaaaa", "aaaaa", "a"], [""], [None]]
