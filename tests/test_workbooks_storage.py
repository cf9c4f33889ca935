import zipfile

import pytest

from flowloom.errors import ConfigurationError
from flowloom.plans.schema import Field
from flowloom.sources import storage
from flowloom.sources.workbooks import read_workbooks

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def book(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS}><sheets><sheet name="One" sheetId="1" r:id="rId1"/><sheet name="Two" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}><si><t>id</t></si><si><r><t>na</t></r><r><t>me</t></r></si><si><t>Ann</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {NS}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>1</v></c><c r="B2" t="s"><v>2</v></c></row><row r="3"><c r="A3" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {NS}><sheetData><row r="1"/><row r="2"><c r="B2"><v>9</v></c></row></sheetData></worksheet>')


def test_workbook(spark, tmp_path):
    book(tmp_path / "a.xlsx")
    fields = [Field("id", "int"), Field("name")]
    out = read_workbooks(spark, str(tmp_path / "a.xlsx"), fields)
    assert sorted((tuple(r) for r in out["main"].collect()), key=str) == [(1, "Ann"), (None, "9")]
    assert [tuple(r)[:3] for r in out["reject"].collect()] == [("x", "", "TYPE_CONVERSION")]
    assert read_workbooks(spark, str(tmp_path / "a.xlsx"), fields, sheets="T.*")["main"].count() == 1


def test_storage(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    storage.touch(spark, a)
    storage.copy(spark, a, b)
    assert storage.exists(spark, b)
    storage.copy(spark, b, str(tmp_path / "c"), move=True)
    assert not storage.exists(spark, b) and storage.delete(spark, str(tmp_path / "c")) and not storage.delete(spark, b)
    with pytest.raises(ConfigurationError):
        storage.copy(spark, b, a)
    (tmp_path / "l.txt").write_bytes("é\n€".encode("cp1252"))
    storage.change_encoding(spark, str(tmp_path / "l.txt"), str(tmp_path / "out"), "cp1252")
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["é", "€"]
