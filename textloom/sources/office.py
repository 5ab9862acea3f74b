"""Cells of workbooks and paragraphs of word files, one file per row of the input.

Python takes members out of the archives. It reads the XML of workbooks as a stream, in ``sheets``; Spark's XML functions read word files.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, StructType

from textloom.functions.text import decode_entities
from textloom.operators.lookup import MAX_BROADCAST_ROWS
from textloom.session import bound_batches
from textloom.sources.archives import Members
from textloom.sources.files import read_binary
from textloom.sources.sheets import Cells, broken, read_workbooks

_XML = {"ignoreNamespace": "true", "ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE"}


@F.arrow_udf(StructType().add("xml", "string").add("error", "string"))
def _document(contents: pa.Array) -> pa.Array:
    """The document of each word file beside an ``error``; a broken file must not end the job."""

    def read(content: bytes | None) -> tuple[str | None, str | None]:
        try:
            return Members(content).text("word/document.xml"), None
        except Exception as problem:  # noqa: BLE001
            return None, broken(problem)

    texts = list(map(read, contents.to_pylist()))
    return pa.StructArray.from_arrays([pa.array([t[i] for t in texts], pa.string()) for i in (0, 1)], names=["xml", "error"])


@F.arrow_udf(ArrayType(StructType().add("row", "integer").add("col", "integer").add("value", "string").add("error", "string")))
def _cells(contents: pa.Array) -> pa.Array:
    """The cells of each workbook."""
    cells = Cells()
    ends = [0, *read_workbooks(contents.to_pylist(), cells)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cells.to_arrow())


def _parsed(xml: Column, fields: str) -> Column:
    return F.from_xml(xml, f"{fields}, _corrupt_record string", _XML)


def parse_cells(files: DataFrame, max_broadcast: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``cells(path, row, col, value, error)`` of the active sheet of each workbook in files(path, content).

    Values are texts as Python prints them. A row without values, also one that the sheet leaves out, has one cell without
    a value; a sheet without rows has none. A file that breaks has a row with an ``error`` beside what could be read (see
    ``intact``). A path must occur once. An archive is opened once, its XML is read as a stream, and no row moves;
    ``max_broadcast`` stays for callers and limits nothing. The cells of one sheet are one value: Spark holds 2 GB in it.
    """
    bound_batches(files.sparkSession)
    # Of a plain explode Spark asks first whether the list is empty, and reads each file twice.
    read = files.select("path", _cells("content").alias("_cells"))
    return read.select("path", F.explode_outer("_cells").alias("_e")).where("_e is not null").select("path", "_e.*")


def _paragraph_text(inner: Column) -> Column:
    """Text of the runs of a paragraph and of its links; ``inner`` is what the paragraph holds, with references as they were."""
    runs = ("/r", "/hyperlink/r")

    def step(state: Column, token: Column) -> Column:
        path, text = state["path"], state["text"]
        name = F.regexp_extract(token, r"^<(?:\w+:)?([\w.-]+)", 1)
        kind = F.regexp_extract(token, r"""\s(?:\w+:)?type\s*=\s*["']([^"']*)""", 1)
        sign = (
            F.when(name.isin("tab", "ptab"), "\t")
            .when((name == "cr") | ((name == "br") & kind.isin("", "textWrapping")), "\n")
            .when(name == "noBreakHyphen", "-")
            .otherwise("")
        )
        opened = F.struct(F.concat(path, F.lit("/"), name).alias("path"), F.concat(text, F.when(path.isin(*runs), sign).otherwise("")).alias("text"))
        closed = F.struct(F.regexp_replace(path, "/[^/]*$", "").alias("path"), text.alias("text"))
        told = F.when(path.isin(*[f"{r}/t" for r in runs]), decode_entities(token)).otherwise("")
        return (
            F.when(token.startswith("</"), closed)
            .when(token.startswith("<"), opened)
            .otherwise(F.struct(path.alias("path"), F.concat(text, told).alias("text")))
        )

    tokens = F.regexp_extract_all(inner, F.lit("<[^>]*>|[^<]+"), F.lit(0))
    return F.aggregate(tokens, F.struct(F.lit("").alias("path"), F.lit("").alias("text")), step, lambda s: s["text"])


def _table_paragraphs(tables: DataFrame) -> DataFrame:
    """``paragraphs(path, ord, _inner)`` of the cells of tables(path, table, rows); a merged cell stands in every place it covers."""

    def copies(cell: Column) -> Column:
        merge = cell["tcPr"]["vMerge"]
        continues = merge.isNotNull() & (F.coalesce(merge["_val"], F.lit("continue")) == "continue")
        held = F.struct(continues.alias("continues"), F.coalesce(cell["p"], F.array().cast("array<string>")).alias("held"))
        return F.array_repeat(held, F.coalesce(cell["tcPr"]["gridSpan"]["_val"], F.lit(1)))

    grids = F.transform("rows", lambda r: F.coalesce(F.flatten(F.transform(r["tc"], copies)), F.array().cast("array<struct<continues:boolean,held:array<string>>>")))
    rows = tables.select("path", "table", grids.alias("_grids")).select(
        "path", "table", F.transform("_grids", lambda g: F.size(g)).alias("_sizes"), F.posexplode("_grids").alias("_row", "_grid")
    )
    above = F.coalesce(F.get("_sizes", F.col("_row") - 1), F.lit(0)).alias("_above")
    cells = rows.select("path", "table", "_row", above, F.posexplode("_grid").alias("_place", "_cell"))
    own = F.when(~F.col("_cell.continues") | (F.col("_place") >= F.col("_above")), F.col("_cell.held"))
    down = Window.partitionBy("path", "table", "_place").orderBy("_row")
    filled = cells.withColumn("_held", F.last(own, ignorenulls=True).over(down))
    each = filled.select("path", "table", "_row", "_place", F.posexplode("_held").alias("_no", "_inner"))
    reading = Window.partitionBy("path").orderBy("table", "_row", "_place", "_no")
    return each.select("path", (F.row_number().over(reading) - 1).alias("ord"), "_inner")


def parse_paragraphs(files: DataFrame) -> DataFrame:
    """``paragraphs(path, part, ord, text, error)`` of each word file in files(path, content).

    Paragraphs of the body are part 0, those of the cells of its tables part 1. A file that breaks has one row with an
    ``error``. A path must occur once. CDATA sections are read as marked-up text.
    """
    bound_batches(files.sparkSession)
    # References are escaped once more, so that those inside paragraphs outlast the first reading.
    read = files.select("path", _document("content").alias("_m")).select(
        "path", "_m.error", F.col("_m.xml").isNull().alias("_none"), F.replace("_m.xml", F.lit("&"), F.lit("&amp;")).alias("_xml")
    )
    cell = "tcPr:struct<gridSpan:struct<_val:int>,vMerge:struct<_val:string>>,p:array<string>"
    document = _parsed(F.col("_xml"), f"body struct<p:array<string>,tbl:array<struct<tr:array<struct<tc:array<struct<{cell}>>>>>>>")
    missing = F.when(F.col("_none"), "word/document.xml not found")
    corrupt = F.when(F.col("_doc._corrupt_record").isNotNull(), "not well-formed")
    read = read.withColumn("_doc", document).withColumn("error", F.coalesce("error", missing, corrupt))
    whole = read.where("error is null")
    body = whole.select("path", F.lit(0).alias("part"), F.posexplode("_doc.body.p").alias("ord", "_inner"))
    tables = whole.select("path", F.posexplode("_doc.body.tbl").alias("table", "_table")).select("path", "table", F.col("_table.tr").alias("rows"))
    cells = _table_paragraphs(tables).select("path", F.lit(1).alias("part"), "ord", "_inner")
    told = body.unionByName(cells).select("path", "part", "ord", _paragraph_text(F.col("_inner")).alias("text"), F.lit(None).cast("string").alias("error"))
    broken = read.where("error is not null").selectExpr("path", "int(null) part", "int(null) ord", "string(null) text", "error")
    return told.unionByName(broken)


def intact(rows: DataFrame) -> DataFrame:
    """The rows of files without an error; what came before an error goes too."""
    error = F.max("error").over(Window.partitionBy("path"))
    return rows.withColumn("_error", error).where("_error is null").drop("_error", "error")


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    return parse_cells(read_binary(spark, path))


def read_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    return parse_paragraphs(read_binary(spark, path))
