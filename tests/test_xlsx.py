"""The spreadsheet source: files, folders, sheets, shared texts, odd cells."""

import zipfile

import pytest

from grovetable.sources import tables, xlsx

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(path, sheets, shared=()):
    """A workbook of (name, rows XML) sheets."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, (n, _) in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="/xl/worksheets/sheet{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, (_, rows) in enumerate(sheets):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{rows}</sheetData></worksheet>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">' + "".join(f"<si>{s}</si>" for s in shared) + "</sst>")


def row(*cells):
    return "<row>" + "".join("<c/>" if c is None else f"<c><v>{c}</v></c>" for c in cells) + "</row>"


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_cells_of_all_kinds(spark, tmp_path):
    shared = ["<t>name</t>", "<r><t>red </t></r><r><t>blue</t></r><rPh><t>x</t></rPh>", "<t/>"]
    rows = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>0</v></c><c r="AA1"><v>7</v></c></row>'
        '<row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2" t="inlineStr"><is><t>in</t></is></c><c r="AB2"><v>beyond</v></c></row>'
        '<row r="5"/><row r="6"><c r="C6" t="s"><v>2</v></c><c><v>next</v></c></row>'
    )
    workbook(tmp_path / "a.xlsx", [("One", rows)], shared)
    df = xlsx.read_xlsx(spark, str(tmp_path / "a.xlsx"))
    assert df.columns[:4] == ["name", "column_1", "name.1", "column_3"] and df.columns[-1] == "7" and len(df.columns) == 27
    got = [tuple(r[:4]) for r in df.collect()]
    assert got == [("red blue", "in", None, None), (None,) * 4, (None, None, "", "next")]


def test_folder_pattern_and_sheets(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n, where in enumerate((tmp_path / "a.xlsx", tmp_path / "b.xlsx", tmp_path / "in" / "c.xlsx")):
        workbook(where, [("First", row("k", "v") + row(n, 1)), ("Second", row("k", "v") + row(n, 2) + row(n, 3)), ("Bare", "")])
    (tmp_path / "_hidden.xlsx").write_bytes(b"no workbook")
    (tmp_path / "~$a.xlsx").write_bytes(b"no workbook")
    assert found(xlsx.read_xlsx(spark, str(tmp_path))) == [("0", "1"), ("1", "1"), ("2", "1")]
    assert found(xlsx.read_xlsx(spark, f"file://{tmp_path}/[ab].xlsx", "Second")) == [("0", "2"), ("0", "3"), ("1", "2"), ("1", "3")]
    all_sheets = spark.read.format("xlsx").option("sheet", "*").load(str(tmp_path))
    assert all_sheets.count() == 9 and all_sheets.rdd.getNumPartitions() == 9
    assert found(all_sheets.groupBy("k").count()) == [("0", 3), ("1", 3), ("2", 3)]
    assert xlsx.read_xlsx(spark, str(tmp_path / "a.xlsx"), "Bare").columns == []
    with pytest.raises(Exception, match="no sheet"):
        xlsx.read_xlsx(spark, str(tmp_path / "a.xlsx"), "Third")
    with pytest.raises(Exception, match="no workbook"):
        xlsx.read_xlsx(spark, str(tmp_path / "none*.xlsx"))


def test_other_headers_are_refused(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", [("S", row("k", "v") + row(1, 2))])
    workbook(tmp_path / "b.xlsx", [("S", row("v", "k") + row(1, 2))])
    with pytest.raises(Exception, match="has the header"):
        xlsx.read_xlsx(spark, str(tmp_path)).collect()


def test_many_rows_come_in_blocks_and_in_order(spark, tmp_path):
    n = 3 * xlsx.BLOCK + 1
    workbook(tmp_path / "a.xlsx", [("S", row("k", "v") + "".join(row(i, None) for i in range(n)))])
    assert [r["k"] for r in tables.read_table(spark, str(tmp_path / "a.xlsx")).collect()] == [str(i) for i in range(n)]
