import urllib.parse
import zipfile

import pytest
from pyspark.sql import functions as F

from textloom.operators import blocks, privacy
from textloom.operators.insights import insights
from textloom.plans import enrich
from textloom.sinks import tables
from textloom.sources import files, office
from textloom.streaming.files import run_batches, run_on_files

S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def by_name(rows):
    return {r["path"].rsplit("/", 1)[-1]: r for r in rows}


def test_text_files(spark, tmp_path):
    (tmp_path / "plain.txt").write_bytes("é😀".encode())
    (tmp_path / "crlf.txt").write_bytes(b"a\r\nb\rc\n")
    (tmp_path / "bad.txt").write_bytes(b"a\xff")
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "bom.txt").write_bytes(b"\xef\xbb\xbfx")
    local = {k: r["text"] for k, r in by_name(files.read_local_texts(spark, str(tmp_path)).collect()).items()}
    assert local == {"plain.txt": "é😀", "crlf.txt": "a\nb\nc\n", "bad.txt": "", "bom.txt": "﻿x"}
    with pytest.raises(Exception, match="UTF"):
        files.read_object_texts(spark, str(tmp_path)).collect()
    lenient = by_name(files.read_object_texts(spark, str(tmp_path), strict=False).collect())
    assert lenient["crlf.txt"]["text"] == "a\r\nb\rc\n" and lenient["bad.txt"]["error"] == "not UTF-8"


def test_missing_files_give_empty_text(spark):
    requests = spark.createDataFrame([("a", "old"), ("b", "old")], "path string, text string")
    read = spark.createDataFrame([("a", "new")], "path string, text string")
    assert {r["path"]: r["text"] for r in files.attach_texts(requests, read).collect()} == {"a": "new", "b": ""}


def test_transcripts(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"results":{"transcripts":[{"transcript":"a b"},{"transcript":"c"}]}}')
    (tmp_path / "none.json").write_text('{"results":{}}')
    read = files.read_payloads(spark, str(tmp_path)).withColumn("text", files.transcript_text(F.col("payload")))
    assert {k: r["text"] for k, r in by_name(read.collect()).items()} == {"one.json": "a b", "none.json": None}


def workbook(path, rows, active=1):
    with zipfile.ZipFile(path, "w") as book:
        book.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{S}" xmlns:r="{R}"><bookViews><workbookView activeTab="{active}"/></bookViews>'
            '<sheets><sheet name="a" sheetId="1" r:id="r1"/><sheet name="b" sheetId="2" r:id="r2"/></sheets></workbook>',
        )
        book.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships><Relationship Id="r1" Target="worksheets/one.xml"/>'
            '<Relationship Id="r2" Target="/xl/worksheets/two.xml"/></Relationships>',
        )
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{S}"><si><t>first</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>')
        book.writestr(
            "xl/styles.xml",
            f'<styleSheet xmlns="{S}"><numFmts><numFmt numFmtId="170" formatCode="yyyy&quot;x&quot;"/>'
            '<numFmt numFmtId="171" formatCode="0.0&quot;days&quot;"/></numFmts>'
            '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>',
        )
        book.writestr("xl/worksheets/one.xml", f'<worksheet xmlns="{S}"><sheetData/></worksheet>')
        book.writestr("xl/worksheets/two.xml", f'<worksheet xmlns="{S}"><sheetData>{rows}</sheetData></worksheet>')


def test_workbooks(spark, tmp_path):
    workbook(
        tmp_path / "a.xlsx",
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c><c r="AA1"><v>7</v></c></row>'
        '<row r="3"><c r="A3"><v>1.5</v></c><c r="B3" t="b"><v>1</v></c><c r="C3" t="inlineStr"><is><t>in</t></is></c>'
        '<c r="D3"><f>A1+1</f><v>2</v></c><c r="E3" t="e"><v>#N/A</v></c><c r="F3" s="1"><v>45322</v></c>'
        '<c r="G3" s="2"><v>45322.5</v></c><c r="H3" s="3"><v>3</v></c></row><row r="4"><c r="A4"/></row>',
    )
    workbook(tmp_path / "b.xlsx", "", active=0)
    (tmp_path / "c.xlsx").write_bytes(b"no zip")
    good = "".join(f'<row r="{i}"><c r="A{i}"><v>{i}</v></c></row>' for i in range(1, 12_001))
    workbook(tmp_path / "d.xlsx", good + "<row></broken>")
    cells = office.read_cells(spark, str(tmp_path))
    assert sorted(r["path"][-6:] for r in cells.where("error is not null").collect()) == ["c.xlsx", "d.xlsx"]
    texts = by_name(blocks.sheet_texts(office.intact(cells), "path").collect())
    assert {k: r["text"] for k, r in texts.items()} == {
        "a.xlsx": "first rich 7 \n\n1.5 True in =A1+1 #N/A 2024-01-31 00:00:00 2024-01-31 12:00:00 3 \n\n"
    }


def test_word_files(spark, tmp_path):
    def p(inner):
        return f"<w:p>{inner}</w:p>"

    def r(inner):
        return f"<w:r>{inner}</w:r>"

    def cell(text, props=""):
        return f"<w:tc><w:tcPr>{props}</w:tcPr>{p(r(f'<w:t>{text}</w:t>'))}</w:tc>"

    body = (
        p(r("<w:t>one</w:t><w:tab/><w:t>two</w:t><w:br/><w:t>three</w:t><w:br w:type='page'/>"))
        + "<w:tbl><w:tr>" + cell("a", "<w:gridSpan w:val='2'/>") + "</w:tr><w:tr>"
        + cell("b", "<w:vMerge w:val='restart'/>") + cell("c") + "</w:tr><w:tr>" + cell("", "<w:vMerge/>") + cell("d") + "</w:tr></w:tbl>"
        + p("<w:hyperlink>" + r("<w:t>link</w:t>") + "</w:hyperlink>" + r("<w:noBreakHyphen/><w:t>x</w:t>")) + p("")
    )
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as book:
        book.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as book:
        book.writestr("other.xml", "<a/>")
    read = office.read_paragraphs(spark, str(tmp_path))
    assert read.where("error is not null").count() == 1
    assert blocks.paragraph_texts(office.intact(read), "path").first()["text"] == (
        "one\ttwo\nthree\nlink-x\n\n" + "a\na\nb\nc\nb\nd\n"
    )


def test_printed_numbers_dates_and_places(spark, tmp_path):
    numbers = ["007", "-0", "+5", "1.50", "1E3", "1e16", "123456789012345678901234567890", "0.0001", "0.00001234", "1.5e-7", "12345678.25", "1e22", ".5"]
    days = {"0.5": "12:00:00", "1": "1900-01-01 00:00:00", "59": "1900-02-28 00:00:00", "61": "1900-03-01 00:00:00", "45322.999999999": "2024-02-01 00:00:00"}
    rows = (
        "<row>" + "".join(f"<c><v>{n}</v></c>" for n in numbers) + "</row><row r='4'><c r='C4'><v>3</v></c><c><v>4</v></c></row>"
        + "<row>" + "".join(f"<c s='1'><v>{d}</v></c>" for d in days) + "</row>"
        + "<row><c t='inlineStr'><is><r><t xml:space='preserve'>a </t></r><r><t>&lt;b&gt;</t></r></is></c><c t='str'><v> s </v></c></row>"
    )
    workbook(tmp_path / "a.xlsx", rows)
    workbook(tmp_path / "b.xlsx", '<row><c t="s"><v>9</v></c></row>')
    workbook(tmp_path / "c.xlsx", "<row><c><v>x</v></c></row>")
    workbook(tmp_path / "d.xlsx", '<row r="2000000000"><c><v>1</v></c></row>')
    cells = office.read_cells(spark, str(tmp_path))
    errors = {k: r["error"] for k, r in by_name(cells.where("error is not null").collect()).items()}
    assert errors == {"b.xlsx": "no shared string 9", "c.xlsx": "no number: x", "d.xlsx": "row number too large"}
    found = {(r["row"], r["col"]): r["value"] for r in office.intact(cells).collect()}
    printed = [str(float(n)) if any(x in n for x in ".eE") else str(int(n)) for n in numbers]
    assert [found.pop((1, i + 1)) for i in range(len(numbers))] == printed
    assert [found.pop((5, i + 1)) for i in range(len(days))] == list(days.values())
    assert found == {(2, 1): None, (3, 1): None, (4, 3): "3", (4, 4): "4", (6, 1): "a <b>", (6, 2): " s "}


def test_many_shared_strings(spark, tmp_path):
    """Strings beyond the broadcast limit meet their cells by path and index; one index holds a third of all cells."""
    rows = "".join(f'<row r="{i}"><c t="s"><v>{i % 2 if i % 3 else 0}</v></c><c><v>{i}</v></c></row>' for i in range(1, 301))
    for name in "ab":
        workbook(tmp_path / f"{name}.xlsx", rows)
    small = office.read_cells(spark, str(tmp_path))
    assert small.where("col = 1 and value = 'first'").count() == 400 and small.where("error is not null").count() == 0
    assert sorted(office.parse_cells(files.read_binary(spark, str(tmp_path)), max_broadcast=1).collect()) == sorted(small.collect())


def test_word_marks_and_nesting(spark, tmp_path):
    """References stay what they are, runs of nested paragraphs and of changes do not count."""
    inner = "<w:r><w:t>a &amp;lt; &lt;w:t&gt; &#233;</w:t><w:t xml:space='preserve'> b </w:t><w:cr/><w:br w:type='textWrapping'/><w:ptab/></w:r>"
    nested = "<w:ins><w:r><w:t>new</w:t></w:r></w:ins><w:r><w:pict><w:p><w:r><w:t>box</w:t></w:r></w:p></w:pict></w:r>"
    body = f"<w:p>{inner}{nested}</w:p><w:sdt><w:p><w:r><w:t>no</w:t></w:r></w:p></w:sdt>"
    for name, text in (("a", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>'), ("b", "<w:document><w:body></w:document>")):
        with zipfile.ZipFile(tmp_path / f"{name}.docx", "w") as book:
            book.writestr("word/document.xml", text)
    read = by_name(office.read_paragraphs(spark, str(tmp_path)).collect())
    assert read["a.docx"]["text"] == "a &lt; <w:t> é b \n\n\t" and read["b.docx"]["error"] == "not well-formed"


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    tables.write_texts(df, f"{tmp_path}/out")
    tables.write_texts(df, f"{tmp_path}/out")
    assert [r["text"] for r in tables.stored_rows(spark, f"{tmp_path}/out").collect()] == ["a", "a"]
    rejected = tables.stored_rows(spark, f"{tmp_path}/out", False).collect()
    assert [(r["doc_id"], r["error"]) for r in rejected] == [(2, "no text to write")] * 2


def test_payloads_and_paths(values):
    texts = ["a b&c=d/é*~-._+%", ""]
    expected = [
        urllib.parse.urlencode({"content": t, "format": "html", "member_ids": "f 1", "type": "document"}) for t in texts
    ]
    assert values(texts, lambda t: tables.document_payload(t, F.lit("f 1"))) == expected
    assert values(["/a/b c.mp3", "x"], lambda p: tables.upload_path(p, "bkt", "up/")) == ["s3://bkt/up/b c.mp3", "s3://bkt/up/x"]


def documents(spark, folder):
    rows = [(i, f"Good fox {i}, mail a{i}@b.org or a{i}@b.org") for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(folder)
    return spark.read.parquet(folder)


def chain(df):
    return insights(privacy.tokenize(df))


def test_stream_gives_the_batch_result(spark, tmp_path):
    source, target, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    batch = chain(documents(spark, source))
    for _ in range(2):
        run_on_files(spark, source, "doc_id long, text string", chain, target, state, max_files=2).awaitTermination()
        got = spark.read.parquet(target)
        assert got.count() == 20 and got.exceptAll(batch).count() == 0


def test_stream_in_batches(spark, tmp_path):
    source, target, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    spans = privacy.detect_spans(documents(spark, source))
    run_batches(spark, source, "doc_id long, text string", privacy.detect_spans, target, state, 2).awaitTermination()
    got = spark.read.parquet(target).drop("batch")
    assert got.count() == 40 and got.exceptAll(spans).count() == 0


def test_rows_go_through_the_stage_of_their_type(spark):
    df = spark.createDataFrame([("a", "pdf"), ("b", "http"), ("c", "s3")], "text string, input_type string")
    upper = {"pdf": lambda d: d.withColumn("text", F.upper("text")), "http": lambda d: d.withColumn("note", F.lit("x"))}
    rows = {r["text"]: r["note"] for r in enrich.by_input_type(df, upper).collect()}
    assert rows == {"A": None, "b": "x", "c": None}


def test_a_workbook_is_read_once(spark, tmp_path):
    """One opening of each archive, no join: strings go with the rows that show them, however their indexes are written."""
    shown = ["<v>1</v>", "<v> 01 </v>", "<v>&#49;</v>", "<v><![CDATA[1]]></v>", "<v><!-- x -->0</v>"]
    rows = "".join(f'<row r="{i + 1}"><c t="str"><v>s</v></c><x:c r="C{i + 1}" t = "s">{v}</x:c><c><v>7</v></c></row>' for i, v in enumerate(shown))
    workbook(tmp_path / "a.xlsx", rows.replace("<row", '<row xmlns:x="y"'))
    cells = office.read_cells(spark, str(tmp_path))
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and len({line.split("(1)")[0] for line in plan.splitlines() if "ArrowEvalPython" in line}) == 1
    found = cells.where("col = 3").orderBy("row").collect()
    assert [(r["value"], r["error"]) for r in found] == [(v, None) for v in ("rich", "rich", "rich", "rich", "first")]
    assert cells.where("col = 4 and value = '7'").count() == 5
