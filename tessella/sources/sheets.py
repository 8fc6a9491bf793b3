"""Workbooks as tables: members of packed files as rows, sheets as sparse cells, cells as Markdown.

Spark reads the files and deals out their members; only members of the wanted names are unpacked. All
that follows is relational: cells are extracted by patterns, shared strings are met by their
number, and gaps are filled when rows become lines.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Members of a workbook that are read.
WORKBOOK = r"xl/(workbook\.xml|_rels/workbook\.xml\.rels|sharedStrings\.xml|worksheets/[^/]+\.xml)"


def members(files: DataFrame, pattern: str = WORKBOOK) -> DataFrame:
    """path, member, content of the members of packed files (path, content) whose whole name fits the pattern; a file that is no archive has none."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_py() or b"")) as z:
                        for name in z.namelist():  # one member is held at a time
                            if re.fullmatch(pattern, name):
                                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([name]), pa.array([z.read(name)], pa.binary())], names=["path", "member", "content"])
                except zipfile.BadZipFile:
                    continue

    return files.select("path", "content").mapInArrow(unpack, "path string, member string, content binary")


def _plain(c: Column) -> Column:
    """XML text without escapes."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#10;", "\n"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def _attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf'(?:^|\s){name}="([^"]*)"', 1)


def _texts(xml: Column) -> Column:
    """All <t> texts of a piece of XML, joined."""
    return _plain(F.array_join(F.regexp_extract_all(F.regexp_replace(xml, r"(?s)<rPh\b.*?</rPh>", ""), F.lit(r"(?s)<t(?:\s[^>]*)?>(.*?)</t>"), F.lit(1)), ""))


def sheets(found: DataFrame) -> DataFrame:
    """path, sheet_no (from 0, in the workbook's order), sheet (its name), xml of the sheets among members (path, member, content)."""
    text = found.select("path", "member", F.decode("content", "UTF-8").alias("xml"))
    named = text.where("member = 'xl/workbook.xml'").select("path", F.posexplode(F.regexp_extract_all("xml", F.lit(r"<sheet\s([^>]*)>"), F.lit(1))).alias("sheet_no", "tag"))
    named = named.select("path", "sheet_no", _plain(_attribute(F.col("tag"), "name")).alias("sheet"), _attribute(F.col("tag"), "r:id").alias("ref"))
    targets = text.where("member = 'xl/_rels/workbook.xml.rels'").select("path", F.explode(F.regexp_extract_all("xml", F.lit(r"<Relationship\s([^>]*)>"), F.lit(1))).alias("tag"))
    target = F.regexp_replace(_attribute(F.col("tag"), "Target"), r"^/?(?:xl/)?", "")
    targets = targets.select("path", _attribute(F.col("tag"), "Id").alias("ref"), F.concat(F.lit("xl/"), target).alias("member"))
    return named.join(targets, ["path", "ref"]).join(text, ["path", "member"]).select("path", "sheet_no", "sheet", "xml")


def sheet_cells(found: DataFrame) -> DataFrame:
    """path, sheet_no, row, col (from 0), value of every filled cell, as a page shows it.

    Numbers are written as doubles (1 is 1.0), truth values as true and false, formulas as their text; bars in
    strings are escaped and line ends are spaces.
    """
    cell = F.explode(F.regexp_extract_all("xml", F.lit(r"(?s)(<c\s[^>]*?(?:/>|>.*?</c>))"), F.lit(1)))
    c = sheets(found).select("path", "sheet_no", cell.alias("cell"))
    tag = F.regexp_extract("cell", r"<c\s([^>]*?)/?>", 1)
    at = _attribute(tag, "r")
    letters = F.split(F.regexp_extract(at, "^([A-Z]+)", 1), "")
    col = F.aggregate(F.filter(letters, lambda x: x != ""), F.lit(0), lambda n, x: n * 26 + F.ascii(x) - 64) - 1
    inside = lambda name: F.regexp_extract("cell", rf"(?s)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1)
    c = c.select("path", "sheet_no", (F.regexp_extract(at, "([0-9]+)$", 1).cast("int") - 1).alias("row"), col.alias("col"), _attribute(tag, "t").alias("kind"), inside("v").alias("v"), _plain(inside("f")).alias("formula"), _texts(inside("is")).alias("inline"))
    strings = found.where("member = 'xl/sharedStrings.xml'").select("path", F.posexplode(F.regexp_extract_all(F.decode("content", "UTF-8"), F.lit(r"(?s)<si(?:\s[^>]*)?(?:/>|>(.*?)</si>)"), F.lit(1))).alias("number", "si"))
    strings = strings.select("path", "number", _texts(F.col("si")).alias("shared"))
    c = c.withColumn("number", F.when(F.col("kind") == "s", F.col("v").try_cast("int"))).join(strings, ["path", "number"], "left")
    shown = F.replace(F.replace(F.coalesce(F.when(F.col("kind") == "s", F.col("shared")).when(F.col("kind") == "inlineStr", F.col("inline")).otherwise(_plain(F.col("v"))), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    value = (
        F.when(F.col("formula") != "", F.col("formula"))
        .when(F.col("kind") == "b", F.when(F.col("v") == "1", "true").otherwise("false"))
        .when(F.col("kind") == "e", "")
        .when(F.col("kind").isin("", "n"), F.coalesce(F.col("v").try_cast("double").cast("string"), F.lit("")))
        .otherwise(shown)
    )
    return c.select("path", "sheet_no", "row", "col", value.alias("value"))


def sheets_markdown(found: DataFrame) -> DataFrame:
    """path, markdown of every workbook: for each sheet a heading and a table of all rows from the first to the last, gaps as empty cells, the first row as header."""
    listed = sheets(found)
    last = F.array_max(F.transform(F.regexp_extract_all("xml", F.lit(r'<row\s(?:[^>]*\s)?r="([0-9]+)"'), F.lit(1)), lambda x: x.cast("int")))
    shape = listed.select("path", "sheet_no", "sheet", F.coalesce(last, F.lit(0)).alias("rows"))
    cells = sheet_cells(found)
    width = cells.groupBy("path", "sheet_no").agg((F.max("col") + 1).alias("width"))
    lines = cells.groupBy("path", "sheet_no", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("filled"))
    shape = shape.join(width, ["path", "sheet_no"], "left").withColumn("width", F.coalesce("width", F.lit(0)))
    grid = shape.where("rows > 0").select("path", "sheet_no", "width", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row")).join(lines, ["path", "sheet_no", "row"], "left")
    cols = F.when(F.col("width") > 0, F.sequence(F.lit(0), F.col("width") - 1)).otherwise(F.array().cast("array<int>"))
    line = F.concat(F.lit("|"), F.array_join(F.transform(cols, lambda c: F.concat(F.lit(" "), F.coalesce(F.try_element_at(F.col("filled"), c), F.lit("")), F.lit(" |"))), ""), F.lit("\n"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.col("width")), F.lit("\n"))
    text = grid.select("path", "sheet_no", F.struct("row", F.when(F.col("row") == 0, F.concat(line, rule)).otherwise(line).alias("text")).alias("line"))
    tables = text.groupBy("path", "sheet_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: x["text"]), "").alias("table"))
    parts = shape.join(tables, ["path", "sheet_no"], "left").select("path", F.struct("sheet_no", F.concat(F.lit("### "), "sheet", F.lit("\n\n"), F.coalesce(F.concat("table", F.lit("\n")), F.lit(""))).alias("text")).alias("part"))
    return parts.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["text"]), "").alias("markdown"))
