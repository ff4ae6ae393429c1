"""Report sink: a .docx template's placeholders filled from a mapping, with tables and provenance appended."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from costloom.operators.guard import PLACEHOLDER

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def _paragraph(text: str) -> str:
    return f'<w:p><w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'


def _table(rows: list[list[str]]) -> str:
    cell = lambda v: f"<w:tc><w:tcPr/>{_paragraph(str(v))}</w:tc>"
    return "<w:tbl><w:tblPr/>" + "".join("<w:tr>" + "".join(map(cell, row)) + "</w:tr>" for row in rows) + "</w:tbl>"


def new_document(paragraphs: list[str]) -> bytes:
    """A minimal .docx."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_W}"><w:body>{"".join(map(_paragraph, paragraphs))}</w:body></w:document>')
    return out.getvalue()


def render(template: bytes, mapping: dict[str, str], tables: dict[str, list[list[str]]] | None = None) -> bytes:
    """The template with {{name}} replaced; unknown names stay. tables are appended under their titles.

    A paragraph with a placeholder has its text in its first run afterwards, as names may span runs.
    """
    ElementTree.register_namespace("w", _W)
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(template)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for item in old.infolist():
            data = old.read(item.filename)
            if item.filename == "word/document.xml":
                root = ElementTree.fromstring(data)
                for p in root.iter(f"{{{_W}}}p"):
                    runs = list(p.iter(f"{{{_W}}}t"))
                    text = "".join(t.text or "" for t in runs)
                    if re.search(PLACEHOLDER, text):
                        runs[0].text = re.sub(r"\{\{(.*?)\}\}", lambda m: mapping.get(m[1], m[0]), text)
                        for t in runs[1:]:
                            t.text = ""
                body = root.find(f"{{{_W}}}body")
                for title, rows in (tables or {}).items():
                    for x in ElementTree.fromstring(f'<w:body xmlns:w="{_W}">{_paragraph(title)}{_table(rows)}</w:body>'):
                        body.append(x)
                data = ElementTree.tostring(root, encoding="UTF-8", xml_declaration=True)
            new.writestr(item, data)
    return out.getvalue()
