import io
import random
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from textloom.checks import queries
from textloom.operators import blocks
from textloom.sources import office, sheets
from textloom.sources.archives import Members

ORDERS = "id + 1 o_orderkey", "element_at(array('F', 'O', 'P'), int(id % 3) + 1) o_orderstatus", "date'2024-01-31' o_orderdate", "'1-URGENT' o_orderpriority"


def zipped(members, method=zipfile.ZIP_DEFLATED):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", method) as archive:
        for name, text in members.items():
            archive.writestr(name, text)
    return held.getvalue()


def test_rows_of_packed_orders_stay_where_they_are_read(spark, tmp_path):
    """No window, no join, no order by file: what an order is packed into is read in the worker that packed it."""
    spark.range(5).selectExpr(*ORDERS).write.parquet(f"{tmp_path}/orders.parquet")
    df = queries.workbook_text(spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "from_xml" not in plan and "_cells(pack(" in plan
    status = {1: "F ", 2: "", 3: "P ", 4: "F ", 5: ""}
    assert {r["path"]: r["text"] for r in df.collect()} == {
        str(k): f"{k} {s}\n\n2024-01-31 00:00:00 1-URGENT \n" for k, s in status.items()
    }


def test_packed_archives_are_those_of_zipfile(spark):
    texts = ["", "short", "é😀" * 5000]
    fixed = {"a/fixed.xml": "<a/>" * 600, "b.xml": "<b/>"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", queries._zipped({**fixed, "c.xml": F.col("t"), "d.xml": F.upper("t")}).alias("z")).collect():
        with zipfile.ZipFile(io.BytesIO(row["z"])) as archive:
            assert archive.testzip() is None
            held = {i.filename: (archive.read(i).decode(), i.compress_type, i.external_attr >> 16) for i in archive.infolist()}
        members = {**fixed, "c.xml": row["t"], "d.xml": row["t"].upper()}
        assert held == {n: (t, zipfile.ZIP_DEFLATED, 0o600) for n, t in members.items()}
        assert len(row["z"]) == len(zipped(members))


def outcome(read):
    try:
        return read()
    except Exception as problem:  # noqa: BLE001
        return str(problem) or type(problem).__name__


def test_members_are_those_of_zipfile():
    """Archives of any kind, whole, cut and with bytes changed, give what zipfile gives, errors too."""
    dealt = random.Random(5)
    members = {"a.xml": "text " * 40, "b/c.xml": "", "é.xml": "named", "d.xml": "x"}
    archives = [zipped(members, m) for m in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2)]
    archives += [zipped({n: t for n, t in members.items() if n.isascii()})]
    archives += [b"", b"no zip", archives[1] + b"more", b"more" + archives[3], archives[1][:150]]
    for archive in archives[:4]:
        for _ in range(150):
            changed = bytearray(archive)
            changed[dealt.randrange(len(changed))] ^= 1 << dealt.randrange(8)
            archives.append(bytes(changed))

    def known(content, name):
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            return archive.read(name) if name in archive.NameToInfo else None

    for content in archives:
        for name in (*members, "none.xml"):
            found = outcome(lambda: Members(content).read(name))
            assert found == outcome(lambda: known(content, name)), (content, name)
    assert Members(archives[3])._plain is not None and Members(archives[1])._plain is None


def rows_of(sheet, strings=("s0", "s1"), dates=(1,)):
    out = sheets.Cells()
    sheets._Rows(list(strings), set(dates), out).read(sheet)
    return out.to_arrow().to_pylist()


def test_plain_rows_and_expat_agree(monkeypatch):
    cells = [
        '<c r="A{n}"><v>007</v></c>', '<c t="s"><v>1</v></c>', '<c r="AB{n}" s="1"><v>45322.5</v></c>', '<c t="s"><v>7</v></c>', "<c/>",
        '<c t="inlineStr"><is><t xml:space="preserve"> in </t></is></c>', "<c><f>A1+1</f><v>2</v></c>", '<c t="b"><v>0</v></c>',
        '<c t="str"><v>a b</v></c>', '<c t="str"><v></v></c>', "<c><v>x</v></c>", '<c t="s"><v>+1</v></c>', '<c t="inlineStr"/>',
    ]
    dealt = random.Random(3)
    heads = ['<row r="{n}">', "<row>", '<row r="{n}" spans="1:2" ht="15">', '<row spans="1:2">', '<row r="{n}" a="1" a="2">', '<row r="{n}" r="9">']
    for _ in range(300):
        numbers = sorted(dealt.sample(range(1, 9), dealt.randint(0, 4)))
        sheet = "".join((dealt.choice(heads) + "".join(dealt.choices(cells, k=dealt.randint(0, 4))) + "</row>").replace("{n}", str(n)) for n in numbers)
        quick = rows_of(sheet)
        with monkeypatch.context() as patched:
            patched.setattr(sheets._Rows, "_read_plain", lambda *_: False)
            assert rows_of(sheet) == quick, sheet


def test_what_a_sheet_holds_beside_its_rows_does_not_count():
    sheet = '<worksheet><cols><col min="1"></cols><sheetData><row r="2"><c><v>1</v></c></row><row r="2"><c></row><row><c><v>3</v></c></row></sheetData>'
    assert [tuple(r.values()) for r in rows_of(sheet)] == [
        (1, 1, None, None), (2, 1, "1", None), (None, None, None, "row not well-formed: 2"), (3, 1, "3", None)
    ]


def test_cells_of_many_workbooks_keep_their_files(spark, monkeypatch):
    """Cells beyond what lists hold, and a file that breaks after them: the others keep theirs."""
    monkeypatch.setattr(sheets.Cells, "FULL", 7)
    out = sheets.Cells()
    for i in range(20):
        out.add(i, 1, str(i), None)
    out.cut(10)
    out.add(99, 1, "x", None)
    assert [r["row"] for r in out.to_arrow().to_pylist()] == [*range(10), 99]
    monkeypatch.setattr(sheets, "_TOGETHER", 3)

    def book(sheet):
        links = '<Relationships><Relationship Id="r1" Target="one.xml"/></Relationships>'
        names = '<workbook><sheets><sheet name="a" r:id="r1"/></sheets></workbook>'
        return zipped({"xl/workbook.xml": names, "xl/_rels/workbook.xml.rels": links, "xl/one.xml": sheet})

    contents = [book(f'<row r="{i % 4}"><c><v>{i}</v></c></row>') if i % 5 else b"no zip" for i in range(1, 12)]
    out = sheets.Cells()
    ends = [0, *sheets.read_workbooks(contents, out)]
    told = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), out.to_arrow()).to_pylist()
    for i, cells in enumerate(told, 1):
        assert [c["value"] for c in cells if c["value"]] == ([str(i)] if i % 5 else []) and (cells[-1]["error"] is None) == bool(i % 5)


def test_a_file_is_read_once_and_empty_sheets_have_no_cell(spark):
    book = '<workbook><sheets><sheet name="a" r:id="r1"/></sheets></workbook>'
    links = '<Relationships><Relationship Id="r1" Target="one.xml"/></Relationships>'
    files = [(str(i), zipped({"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": links, "xl/one.xml": "<row/>" * i})) for i in range(3)]
    cells = office.parse_cells(spark.createDataFrame(files, "path string, content binary"))
    assert cells._jdf.queryExecution().executedPlan().toString().count("_cells(content") == 1
    assert {r["path"]: r["text"] for r in blocks.sheet_texts(cells, "path").collect()} == {"1": "\n", "2": "\n\n"}
