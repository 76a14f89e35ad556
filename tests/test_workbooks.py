"""Workbooks written here part by part come back typed."""

import zipfile
from datetime import datetime
from xml.sax.saxutils import escape

import pytest

from millrace.sources import workbooks

_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _number(value, style=0):
    return lambda place, _: f'<c r="{place}" s="{style}"><v>{value}</v></c>'


def _shared(text):
    def cell(place, strings):
        strings.append(f'<si><r><t>{escape(text[:2])}</t></r><r><t xml:space="preserve">{escape(text[2:])}</t></r><rPh sb="0" eb="1"><t>no</t></rPh></si>')
        return f'<c r="{place}" t="s"><v>{len(strings) - 1}</v></c>'

    return cell


def _other(kind, value):
    return lambda place, _: f'<c r="{place}" t="{kind}">' + (f"<is><t>{value}</t></is>" if kind == "inlineStr" else f"<v>{value}</v>") + "</c>"


def _write(path, sheets, date1904=False):
    strings = []
    with zipfile.ZipFile(path, "w") as out:
        names, links = "", ""
        for k, (name, rows) in enumerate(sheets.items(), 1):
            body = ""
            for n, row in enumerate(rows, 1):
                body += f'<row r="{n}">' + "".join(cell(f"{chr(65 + c)}{n}", strings) for c, cell in enumerate(row) if cell) + "</row>"
            out.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {_MAIN}><sheetData>{body}</sheetData></worksheet>")
            names += f'<sheet name="{escape(name)}" sheetId="{k}" r:id="rId{k}"/>'
            links += f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>'
        out.writestr("xl/workbook.xml", f'<workbook {_MAIN} xmlns:r="{_REL}"><workbookPr date1904="{int(date1904)}"/><sheets>{names}</sheets></workbook>')
        out.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        out.writestr("xl/sharedStrings.xml", f"<sst {_MAIN}>{''.join(strings)}</sst>")
        formats = '<numFmts count="2"><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd hh:mm"/><numFmt numFmtId="165" formatCode="[Red]0.00&quot; days&quot;"/></numFmts>'
        styles = '<cellXfs count="4"><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs>'
        out.writestr("xl/styles.xml", f'<styleSheet {_MAIN}>{formats}<cellStyleXfs><xf numFmtId="14"/></cellStyleXfs>{styles}</styleSheet>')
    return str(path)


HEAD = [_shared("Invoice"), _shared("Quantity"), _shared("Date"), _shared("Price"), _shared("Gift")]


def test_two_sheets_typed(spark, tmp_path):
    first = [
        HEAD,
        [_number(489434), _number(12), _number("40148.322916666664", 2), _number("6.95", 3), _other("b", 1)],
        [_shared("C489449 <&"), _number(-1), None, _number(3), None],
        [],
        [_other("inlineStr", "A1"), None, _number(40149, 1), _other("e", "#N/A"), _other("b", 0)],
    ]
    second = [[*HEAD[:4], None, _shared("Price")], [_number(7), _number("2.5"), _number(40150, 1), _number(1), _other("str", "x"), _number(9)]]
    path = _write(tmp_path / "book.xlsx", {"Year 1 & 2": first, "Year 3": second})
    df = workbooks.workbook(spark, path, ["Year 1 & 2", "Year 3"])
    assert dict(df.dtypes) == {"Invoice": "string", "Quantity": "double", "Date": "timestamp_ntz", "Price": "double", "Gift": "boolean", "column_4": "string", "Price.1": "bigint", "sheet": "string"}
    rows = {r["Invoice"]: r.asDict() for r in df.collect()}
    assert len(rows) == 4
    assert rows["489434"]["Date"] == datetime(2009, 12, 1, 7, 45) and rows["489434"]["Gift"] is True and rows["489434"]["Price"] == 6.95
    assert rows["C489449 <&"]["Date"] is None and rows["C489449 <&"]["Quantity"] == -1.0 and rows["C489449 <&"]["Price"] == 3.0
    assert rows["A1"]["Price"] is None and rows["A1"]["Quantity"] is None and rows["A1"]["Gift"] is False and rows["A1"]["Date"] == datetime(2009, 12, 2)
    assert rows["7"]["Gift"] is None and rows["7"]["column_4"] == "x" and rows["7"]["Price.1"] == 9 and rows["7"]["sheet"] == "Year 3"
    assert df.rdd.getNumPartitions() == 2


def test_many_rows_come_in_batches(spark, tmp_path):
    rows = [[_shared("nn")], *([_number(k)] for k in range(1000))]
    path = _write(tmp_path / "long.xlsx", {"s": rows})
    found = workbooks.sheet(spark, path, "s", batch_rows=64)
    assert found.dtypes == [("nn", "bigint")] and [r[0] for r in found.collect()] == list(range(1000))


def test_other_epoch_empty_and_unknown_sheets(spark, tmp_path):
    path = _write(tmp_path / "mac.xlsx", {"d": [[_shared("day")], [_number(0.5, 1)]], "none": [], "head": [[_shared("a"), _shared("b")]]}, date1904=True)
    assert workbooks.sheet(spark, path, "d").first()["day"] == datetime(1904, 1, 1, 12)
    assert workbooks.sheet(spark, path, "none").columns == []
    only = workbooks.sheet(spark, path, "head")
    assert only.dtypes == [("a", "string"), ("b", "string")] and only.count() == 0
    with pytest.raises(Exception, match="no sheet 'missing'"):
        workbooks.sheet(spark, path, "missing").count()


@pytest.mark.parametrize(("code", "is_date"), [("General", False), ("0.00", False), ("m/d/yy", True), ("[h]:mm", True), ("[$-409]d mmm", True), ('0 "days"', False), ("#,##0_);[Red](#,##0)", False), ("\\d0", False)])
def test_format_codes(code, is_date):
    assert workbooks._shows_date(code) is is_date
