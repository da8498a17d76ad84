"""Sinks: text, DOCX and PDF documents as bytes of a row, and the writer that puts them in files.

Every document is made whole in one task from one row, so writers need no coordination; files are written through
Spark, which commits a task's output once.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelight.operators.geometry import row_pass
from quirelight.operators.placement import Page, operators

# Fixed values of the document formats, in twips: A4, margins of an inch, an indent of two characters of 12 points.
A4, MARGIN, INDENT_TWIPS, HALF_POINTS = (11906, 16838), 1440, 480, 24
_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx_bytes(pages: list[list[dict]], size: tuple[int, int] | None = None) -> bytes:
    """A DOCX of paragraphs (text, first_line_indent); pages after the first begin on a new page."""
    w, h = size or A4
    body = []
    for i, page in enumerate(pages):
        for j, p in enumerate(page):
            style = "<w:pageBreakBefore/>" * (i > 0 and j == 0) + '<w:spacing w:line="240" w:lineRule="auto"/>' + f'<w:ind w:firstLine="{INDENT_TWIPS}"/>' * bool(p["first_line_indent"])
            body.append(_paragraph(p["text"], style))
    if not body:
        body.append(_paragraph("", ""))
    section = f'<w:sectPr><w:pgSz w:w="{w}" w:h="{h}"/><w:pgMar w:top="{MARGIN}" w:right="{MARGIN}" w:bottom="{MARGIN}" w:left="{MARGIN}" w:header="720" w:footer="720" w:gutter="0"/></w:sectPr>'
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    files = {
        "[Content_Types].xml": f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f"{head}<w:document {_W}><w:body>{''.join(body)}{section}</w:body></w:document>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text)
    return out.getvalue()


def _paragraph(text: str, style: str) -> str:
    clean = "".join(c for c in text if c in "\t\n" or c >= " ")
    fonts = '<w:rFonts w:ascii="Times New Roman" w:eastAsia="宋体"/>'
    return f'<w:p><w:pPr>{style}</w:pPr><w:r><w:rPr>{fonts}<w:sz w:val="{HALF_POINTS}"/></w:rPr><w:t xml:space="preserve">{escape(clean)}</w:t></w:r></w:p>'


class Pdf:
    """Objects of a PDF file, numbered as they are added."""

    def __init__(self) -> None:
        self.objects: list[bytes] = []

    def add(self, body: str, stream: bytes | None = None) -> int:
        raw = body.encode("latin-1")
        if stream is not None:
            raw = raw.replace(b">>", f"/Length {len(stream)} >>".encode(), 1) if raw == b"<< >>" else raw[:-2] + f"/Length {len(stream)} >>".encode()
            raw += b"\nstream\n" + stream + b"\nendstream"
        self.objects.append(raw)
        return len(self.objects)

    def bytes(self, root: int) -> bytes:
        out, places = bytearray(b"%PDF-1.5\n"), []
        for i, body in enumerate(self.objects, 1):
            places.append(len(out))
            out += f"{i} 0 obj\n".encode() + body + b"\nendobj\n"
        at = len(out)
        out += f"xref\n0 {len(places) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{p:010d} 00000 n \n".encode() for p in places)
        return bytes(out + f"trailer\n<< /Size {len(places) + 1} /Root {root} 0 R >>\nstartxref\n{at}\n%%EOF\n".encode())


def code_units(texts: list[str]) -> list[int]:
    """Distinct UTF-16 code units of all words and of the space between them, in order."""
    raw = "".join([" ", *["".join(t.split()) for t in texts]]).encode("utf-16-be")
    return sorted({int.from_bytes(raw[i : i + 2], "big") for i in range(0, len(raw), 2)})


def to_unicode(cids: list[int]) -> str:
    """A character map that reads each code as itself (K3)."""
    parts = ["/CIDInit /ProcSet findresource begin 12 dict begin begincmap", "/CMapName /Own def /CMapType 2 def", "1 begincodespacerange <0000> <FFFF> endcodespacerange"]
    for at in range(0, len(cids), 100):
        some = cids[at : at + 100]
        parts += [f"{len(some)} beginbfchar", *[f"<{c:04X}> <{c:04X}>" for c in some], "endbfchar"]
    return "\n".join([*parts, "endcmap CMapName currentdict /CMap defineresource pop end end"])


def image_pdf(jpeg: bytes, width: int, height: int, dpi: float, blocks: list[dict]) -> bytes:
    """One page with a JPEG as it is and invisible text over it (K2, K3, T6). Block boxes are in pixels."""
    from quirelight.functions.text import OTHER_WIDTH, WIDTHS

    scale = 72.0 / dpi
    w, h = width * scale, height * scale
    page = Page(h)
    box = lambda b: {**b, **{k: b[k] * scale for k in ("x0", "y0", "x1", "y1")}}
    sides = lambda b: [b[k] * scale for k in ("x0", "y0", "x1", "y1")]
    runs = [r for b in blocks for r in page.block(b["text"], *sides(b), [box(x) for x in b.get("words") or []])]
    cids = code_units([b["text"] for b in blocks])
    pdf = Pdf()
    image = pdf.add(f"<< /Type /XObject /Subtype /Image /Width {width} /Height {height} /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /DCTDecode >>", jpeg)
    cmap = pdf.add("<< >>", to_unicode(cids).encode())
    widths = " ".join(f"{c} [{WIDTHS[c - 32] if 32 <= c <= 126 else OTHER_WIDTH}]" for c in cids)
    child = pdf.add(f"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Helvetica /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> /DW {OTHER_WIDTH} /W [{widths}] /CIDToGIDMap /Identity >>")
    font = pdf.add(f"<< /Type /Font /Subtype /Type0 /BaseFont /Helvetica /Encoding /Identity-H /DescendantFonts [{child} 0 R] /ToUnicode {cmap} 0 R >>")
    content = pdf.add("<< >>", f"q\n{w:.2f} 0 0 {h:.2f} 0 0 cm\n/Im0 Do\nQ\n{operators(runs)}".encode("latin-1"))
    tree = len(pdf.objects) + 2
    leaf = pdf.add(f"<< /Type /Page /Parent {tree} 0 R /MediaBox [0 0 {w:.2f} {h:.2f}] /Resources << /XObject << /Im0 {image} 0 R >> /Font << /F0 {font} 0 R >> >> /Contents {content} 0 R >>")
    pdf.add(f"<< /Type /Pages /Kids [{leaf} 0 R] /Count 1 >>")
    return pdf.bytes(pdf.add(f"<< /Type /Catalog /Pages {tree} 0 R >>"))


def to_docx(documents: DataFrame, keys: list[str]) -> DataFrame:
    """keys, content: a DOCX from rows with `pages`, an array of arrays of (text, first_line_indent)."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in documents.select(*keys).schema) + ", content binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [docx_bytes(x or []) for x in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(made, pa.binary())], [*keys, "content"])

    return documents.select(*keys, "pages").mapInArrow(run, schema)


def to_pdf(images: DataFrame, keys: list[str]) -> DataFrame:
    """keys, content: a one-page PDF from rows of jpeg, width, height, dpi and blocks in pixels (K2, K3)."""
    make = lambda jpeg, w, h, dpi, blocks: (image_pdf(jpeg, w, h, dpi, blocks or []),)
    return row_pass(images, keys, ["jpeg", "width", "height", "dpi", "blocks"], "content binary", [pa.binary()], make)


def write_text(texts: DataFrame, path: str, text: str = "text") -> None:
    """Texts as text files (K7)."""
    texts.select(F.col(text).alias("value")).write.text(path)


def write_boxes(placed: DataFrame, path: str) -> None:
    """Placed words as JSON lines, flat (K6)."""
    keys = [c for c in placed.columns if c not in ("placed", "content")]
    placed.select(*keys, F.inline("placed")).write.json(path)


def write_scores(scores: DataFrame, path: str) -> None:
    """Score rows as JSON."""
    scores.write.json(path)


def write_cache(blocks: DataFrame, path: str, keys: list[str]) -> None:
    """Recognised blocks, by document, resolution and engine, read back without recognising again."""
    blocks.write.partitionBy(*keys).mode("append").parquet(path)
