"""Workbooks with several sheets, gaps and all kinds of cells."""

import io
import zipfile

from helpers import rows
from pyspark.sql import functions as F

from tessella.sources import sheets


def workbook(named, strings):
    """A packed workbook of (name, member, rows XML) sheets, listed in another order than their members."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", "<workbook><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, (n, _, _) in enumerate(named)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Type="t" Target="{m}"/>' for i, (_, m, _) in reversed(list(enumerate(named)))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", "<sst>" + "".join(strings) + "</sst>")
        for _, m, xml in named:
            z.writestr(f"xl/{m.removeprefix('/xl/')}", f'<worksheet><sheetData>{xml}</sheetData></worksheet>')
        z.writestr("xl/media/image1.png", b"\x00")
    return out.getvalue()


def made(spark):
    first = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="3" spans="1:3"><c r="A3"><v>1</v></c><c r="B3" s="2"/><c r="C3"><f>SUM(A1:A2)</f><v>7</v></c></row>'
    second = '<row r="2"><c r="B2" t="b"><v>1</v></c><c r="AA2" t="inlineStr"><is><t>in</t><t xml:space="preserve"> line</t></is></c></row>'
    strings = ["<si><t>a|b &amp; c</t></si>", "<si><r><t>ri</t></r><r><t>ch\n</t></r><rPh><t>no</t></rPh></si>", "<si/>"]
    book = workbook([("Two &lt;2&gt;", "worksheets/sheet9.xml", second), ("One", "/xl/worksheets/sheet1.xml", first), ("None", "worksheets/sheet3.xml", "")], strings)
    return spark.createDataFrame([("a.xlsx", bytearray(book)), ("b.xlsx", bytearray(b"no archive")), ("c.xlsx", None)], "path string, content binary")


def test_cells_of_a_workbook(spark):
    found = sheets.members(made(spark))
    assert rows(found.select("member")) == sorted([(f"xl/{m}",) for m in ("workbook.xml", "_rels/workbook.xml.rels", "sharedStrings.xml", "worksheets/sheet9.xml", "worksheets/sheet1.xml", "worksheets/sheet3.xml")], key=repr)
    cells = rows(sheets.sheet_cells(found).drop("path"))
    assert cells == sorted([(0, 1, 1, "true"), (0, 1, 26, "in line"), (1, 0, 0, "a\\|b & c"), (1, 0, 2, "rich "), (1, 2, 0, "1.0"), (1, 2, 1, ""), (1, 2, 2, "SUM(A1:A2)")], key=repr)


def test_markdown_of_a_workbook(spark):
    found = sheets.sheets_markdown(sheets.members(made(spark)))
    wide = lambda cells: "|" + "".join(f" {cells.get(i, '')} |" for i in range(27)) + "\n"
    two = "### Two <2>\n\n" + wide({}) + "|" + " --- |" * 27 + "\n" + wide({1: "true", 26: "in line"}) + "\n"
    one = "### One\n\n| a\\|b & c |  | rich  |\n| --- | --- | --- |\n|  |  |  |\n| 1.0 |  | SUM(A1:A2) |\n\n"
    assert rows(found) == [("a.xlsx", two + one + "### None\n\n")]
    assert sheets.sheets_markdown(sheets.members(made(spark).limit(0))).collect() == []
    assert found.where(F.col("path") != "a.xlsx").count() == 0
