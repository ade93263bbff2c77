"""Writers: text, ZIP, word-processor files, PDF, backups. Bytes are made per document inside a map, so a sink scales with its rows."""

from __future__ import annotations

import io
import json
import re
import zipfile
import zlib
from datetime import datetime, timezone
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmint.functions.layout import helvetica_width, win_ansi
from parchmint.sources.packages import safe_path

_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
EPOCH = datetime(1980, 1, 1, tzinfo=timezone.utc)


def esc(s: str) -> str:
    return escape(_ILLEGAL.sub("", s), {'"': "&quot;"})


def esc_column(s: Column) -> Column:
    t = F.regexp_replace(s, r"[\u0000-\u0008\u000b\u000c\u000e-\u001f￾￿]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def dos_date_time(d: datetime) -> tuple[int, int]:
    """(time, date) words of an archive entry; years before 1980 become 1980."""
    y = max(1980, d.year)
    return d.hour << 11 | d.minute << 5 | d.second // 2, (y - 1980) << 9 | d.month << 5 | d.day


def create_zip(files: dict[str, bytes], now: datetime = EPOCH, stored: tuple[str, ...] = (".jpg", ".png", ".zip")) -> bytes:
    """Entries above 64 bytes are compressed, images stored; unsafe names are refused. The same input gives the same bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            if not safe_path(name):
                raise ValueError(f"unsafe path: {name}")
            info = zipfile.ZipInfo(name, now.timetuple()[:6])
            info.compress_type = zipfile.ZIP_STORED if len(data) <= 64 or name.lower().endswith(stored) else zipfile.ZIP_DEFLATED
            z.writestr(info, data)
    return out.getvalue()


_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def _paragraph(text: str, style: str = "") -> str:
    runs = "<w:r><w:br/></w:r>".join(f'<w:r><w:t xml:space="preserve">{esc(t)}</w:t></w:r>' for t in text.split("\n"))
    return f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>' if style else ''}{runs}</w:p>"


def build_docx(title: str, pages: list[str]) -> bytes:
    """A title and the pages' paragraphs (parted by blank lines), pages parted by page breaks."""
    body = [_paragraph(title, "Title")]
    for i, text in enumerate(pages):
        if i:
            body.append('<w:p><w:r><w:br w:type="page"/></w:r></w:p>')
        body += [_paragraph(p) for p in re.split(r"\n\s*\n", text) if p.strip()]
    main = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    files = {
        "[Content_Types].xml": f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="{main}.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="{main}.styles+xml"/></Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/_rels/document.xml.rels": f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/styles" Target="styles.xml"/></Relationships>',
        "word/styles.xml": f'{head}<w:styles {_W}><w:style w:type="paragraph" w:styleId="Title"><w:name w:val="Title"/><w:rPr><w:b/><w:sz w:val="36"/></w:rPr></w:style></w:styles>',
        "word/document.xml": f"{head}<w:document {_W}><w:body>{''.join(body)}<w:sectPr/></w:body></w:document>",
    }
    return create_zip({k: v.encode() for k, v in files.items()})


def pdf_number(n: float) -> str:
    t = f"{n:.3f}".rstrip("0").rstrip(".")
    return "0" if t in ("-0", "") else t


def pdf_date(d: datetime) -> str:
    return d.astimezone(timezone.utc).strftime("D:%Y%m%d%H%M%SZ")


def hex_literal(b: bytes) -> str:
    return f"<{b.hex()}>"


def build_pdf(title: str, pages: list[dict], footer: bool = True, watermark: str = "", now: datetime = EPOCH, protection=None) -> bytes:
    """PDF 1.7 of pages with width, height (points) and words (text, x, y, w, h from the top left corner).

    A page may bring ``jpeg`` (bytes, pixel width and height): its words then lie invisibly above the picture, else they are
    shown. Streams are compressed. The same input gives the same bytes, unless a ``pdf_security.Protection`` is given.
    """
    objects: list[bytes] = []

    def add(body: bytes) -> int:
        objects.append(body)
        return len(objects)

    sealed = protection.encrypt if protection else lambda b: b

    def stream(data: bytes, extra: str = "") -> bytes:
        z = sealed(zlib.compress(data, 6))
        return f"<< /Length {len(z)} /Filter /FlateDecode{extra} >>\nstream\n".encode() + z + b"\nendstream"

    catalog, tree = add(b""), add(b"")
    font = add(b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>")
    kids = []
    for i, p in enumerate(pages, 1):
        w, h = p["width"], p["height"]
        ops, images = [], ""
        if p.get("jpeg"):
            data, iw, ih = p["jpeg"]
            data = sealed(data)
            img = add(f"<< /Type /XObject /Subtype /Image /Width {iw} /Height {ih} /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /DCTDecode /Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream")
            images = f" /XObject << /Im {img} 0 R >>"
            ops.append(f"q {pdf_number(w)} 0 0 {pdf_number(h)} 0 0 cm /Im Do Q")
        ops.append(f"BT {3 if p.get('jpeg') else 0} Tr")
        for word in p.get("words", []):
            raw = win_ansi(word["text"])
            natural = helvetica_width(raw, word["h"])
            ops.append(f"/F1 {pdf_number(word['h'])} Tf {pdf_number(100 * word['w'] / natural if natural else 100)} Tz 1 0 0 1 {pdf_number(word['x'])} {pdf_number(h - word['y'] - word['h'] * 0.8)} Tm {hex_literal(raw)} Tj")
        ops.append("ET")
        if watermark:
            ops.append(f"q 0.8 g BT /F1 {pdf_number(w / 10)} Tf 0.707 0.707 -0.707 0.707 {pdf_number(w * 0.25)} {pdf_number(h * 0.35)} Tm {hex_literal(win_ansi(watermark))} Tj ET Q")
        if footer:
            label = win_ansi(f"{i} / {len(pages)}")
            ops.append(f"BT 0 Tr 100 Tz /F1 9 Tf 1 0 0 1 {pdf_number((w - helvetica_width(label, 9)) / 2)} 18 Tm {hex_literal(label)} Tj ET")
        content = add(stream("\n".join(ops).encode("latin-1")))
        kids.append(add(f"<< /Type /Page /Parent {tree} 0 R /MediaBox [0 0 {pdf_number(w)} {pdf_number(h)}] /Resources << /Font << /F1 {font} 0 R >>{images} >> /Contents {content} 0 R >>".encode()))
    objects[catalog - 1] = f"<< /Type /Catalog /Pages {tree} 0 R >>".encode()
    objects[tree - 1] = f"<< /Type /Pages /Kids [{' '.join(f'{k} 0 R' for k in kids)}] /Count {len(kids)} >>".encode()
    info = add(f"<< /Title {hex_literal(sealed(chr(0xFEFF).encode('utf-16-be') + title.encode('utf-16-be')))} /CreationDate {hex_literal(sealed(pdf_date(now).encode()))} >>".encode())
    lock = f" /Encrypt {add(protection.dictionary.encode())} 0 R /ID [<{'0' * 32}> <{'0' * 32}>]" if protection else ""
    out, places = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += f"{i} 0 obj\n".encode() + body + b"\nendobj\n"
    start = len(out)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{p:010d} 00000 n \n".encode() for p in places)
    out += f"trailer\n<< /Size {len(objects) + 1} /Root {catalog} 0 R /Info {info} 0 R{lock} >>\nstartxref\n{start}\n%%EOF\n".encode()
    return bytes(out)


def export_text(text: Column) -> Column:
    """A byte order mark and the text, as UTF-8 bytes."""
    return F.concat(F.unhex(F.lit("EFBBBF")), F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def documents_as(df: DataFrame, kind: str) -> DataFrame:
    """(id, file, data): a ``docx``, ``pdf`` or ``zip`` of every document (id, title, pages array of text). Nulls are empty."""
    from parchmint.functions.layout import layout_pages

    def run(batches):
        for pdf in batches:
            rows = []
            for id, title, pages in zip(pdf["id"], pdf["title"], pdf["pages"]):
                title, pages = title or "Sans titre", [p or "" for p in ([] if pages is None else pages)]
                if kind == "docx":
                    data = build_docx(title, pages)
                elif kind == "pdf":
                    data = build_pdf(title, [q for p in pages or [""] for q in layout_pages(p)])
                else:
                    data = create_zip({f"page-{i:02d}.txt": p.encode() for i, p in enumerate(pages, 1)})
                rows.append((id, f"{id}.{kind}", data))
            yield pd.DataFrame(rows, columns=["id", "file", "data"])

    return df.select("id", "title", "pages").mapInPandas(run, "id string, file string, data binary")


def backup_bytes(documents: list[dict], folders: list[dict], blobs: dict[str, bytes], now: datetime = EPOCH) -> bytes:
    """An archive with a manifest of records and all blobs; for one library, not for a table."""
    manifest = json.dumps({"version": 1, "documents": documents, "folders": folders, "blobs": sorted(blobs)}, ensure_ascii=False, default=str, sort_keys=True)
    return create_zip({"manifest.json": manifest.encode(), **{f"blobs/{k}": v for k, v in sorted(blobs.items())}}, now)


def write_backup(df: DataFrame, path: str) -> None:
    """Records as compressed JSON lines, one file for each partition."""
    df.write.mode("overwrite").option("compression", "gzip").json(path)
