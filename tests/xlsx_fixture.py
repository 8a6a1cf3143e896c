"""Minimal .xlsx writer for tests (standard library only)."""

import io
import zipfile
from xml.sax.saxutils import escape


def _ref(r, c):
    s = ""
    c += 1
    while c:
        c, m = divmod(c - 1, 26)
        s = chr(65 + m) + s
    return f"{s}{r + 1}"


def make_xlsx(rows, active=0, sheets=1, date_cells=()):
    """rows: list of lists (str / int / float / bool / None); date_cells: (r, c) holding serial numbers."""
    ss, idx = [], {}
    body = []
    for r, row in enumerate(rows):
        cells = []
        for c, v in enumerate(row):
            if v is None:
                continue
            ref = _ref(r, c)
            if isinstance(v, bool):
                cells.append(f'<c r="{ref}" t="b"><v>{int(v)}</v></c>')
            elif isinstance(v, (int, float)):
                style = ' s="1"' if (r, c) in date_cells else ""
                cells.append(f'<c r="{ref}"{style}><v>{v}</v></c>')
            else:
                if v not in idx:
                    idx[v] = len(ss)
                    ss.append(v)
                cells.append(f'<c r="{ref}" t="s"><v>{idx[v]}</v></c>')
        body.append(f'<row r="{r + 1}">{"".join(cells)}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rns = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    sheet = f'<worksheet {ns}><sheetData>{"".join(body)}</sheetData></worksheet>'
    empty = f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>other</t></is></c></row></sheetData></worksheet>'
    sheet_tags = "".join(f'<sheet name="S{i}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i in range(sheets))
    wb = (f'<workbook {ns} {rns}><bookViews><workbookView activeTab="{active}"/></bookViews>'
          f'<sheets>{sheet_tags}</sheets></workbook>')
    rels = ('<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            + "".join(f'<Relationship Id="rId{i + 1}" Type="worksheet" Target="worksheets/sheet{i + 1}.xml"/>'
                      for i in range(sheets)) + "</Relationships>")
    sst = f'<sst {ns}>' + "".join(f"<si><t>{escape(s)}</t></si>" for s in ss) + "</sst>"
    styles = (f'<styleSheet {ns}><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", wb)
        z.writestr("xl/_rels/workbook.xml.rels", rels)
        z.writestr("xl/sharedStrings.xml", sst)
        z.writestr("xl/styles.xml", styles)
        for i in range(sheets):
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", sheet if i == active else empty)
    return buf.getvalue()
