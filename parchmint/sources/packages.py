"""Readers: what a file is, ZIP packages, tolerant XML, office documents and plain text, as pure functions and as maps over ``binaryFile`` rows."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ENTRIES, MOST_TOTAL, MOST_ENTRY = 10_000, 512 << 20, 256 << 20
MOST_ROWS, MOST_COLUMNS = 1000, 40
# Import limits in bytes by kind.
LIMITS = {"image": 40 << 20, "pdf": 150 << 20, "office": 60 << 20, "text": 10 << 20}


class PackageError(ValueError):
    """What is wrong with a file, as a short code."""


def looks_like_text(sample: bytes) -> bool:
    """No NUL and under 2 % of control characters (escape is allowed); empty is text."""
    if not sample:
        return True
    odd = sum(c < 9 or 13 < c < 32 and c != 27 for c in sample)
    return 0 not in sample and odd / len(sample) < 0.02


# First bytes of known types, in the order of trial.
SIGNATURES = [(b"\xff\xd8\xff", "jpeg"), (b"\x89PNG", "png"), (b"GIF8", "gif"), (b"BM", "bmp"), (b"II*\x00", "tiff"), (b"MM\x00*", "tiff"), (b"PK\x03\x04", "zip"), (b"PK\x03\x06", "zip"), (b"PK\x05\x04", "zip"), (b"PK\x05\x06", "zip"), (b"\xd0\xcf\x11\xe0", "ole")]
HEIC = (b"heic", b"heix", b"mif1", b"heif")


def sniff(data: bytes) -> str:
    """The type by content; a PDF header may have up to 1,024 bytes before it."""
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp"
    if data[4:8] == b"ftyp" and data[8:12] in HEIC:
        return "heic"
    kind = next((k for mark, k in SIGNATURES if data.startswith(mark) and not (k == "bmp" and len(data) <= 26)), None)
    if kind in ("zip", "ole", None) and b"%PDF-" in data[:1024]:
        return "pdf"
    if kind:
        return kind
    if re.match(rb"^\s*(<\?xml[^>]*>\s*)?<svg[\s>]", data[:1024], re.I):
        return "svg"
    return "text" if looks_like_text(data[:4096]) else "unknown"


def sniff_column(content: Column) -> Column:
    """The same in SQL, from the length and the first bytes, but for the test of text (``unknown`` there)."""
    h, start = F.hex(F.substring(content, 1, 12)), F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    pdf = F.instr(start, "%PDF-") > 0
    c = F.when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "webp")
    c = c.when((F.substring(h, 9, 8) == b"ftyp".hex()) & F.substring(h, 17, 8).isin([k.hex().upper() for k in HEIC]), "heic")
    for mark, kind in SIGNATURES:
        here = h.startswith(mark.hex().upper())
        here = here & (F.octet_length(content) > 26) if kind == "bmp" else here & ~pdf if kind in ("zip", "ole") else here
        c = c.when(here, kind)
    return c.when(pdf, "pdf").when(start.rlike(r"(?i)^\s*(<\?xml[^>]*>\s*)?<svg[\s>]"), "svg").otherwise("unknown")


def read_zip(data: bytes) -> dict[str, bytes]:
    """Entries by name, within the limits; encrypted ones, unsafe names and wrong checksums are refused."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise PackageError("corrupt") from e
    infos = [i for i in z.infolist() if not i.is_dir()]
    if len(infos) > MOST_ENTRIES or sum(i.file_size for i in infos) > MOST_TOTAL or any(i.file_size > MOST_ENTRY for i in infos):
        raise PackageError("too-large")
    out = {}
    for i in infos:
        if i.flag_bits & 1:
            raise PackageError("encrypted")
        if not safe_path(i.filename):
            raise PackageError("unsafe-path")
        try:
            with z.open(i) as f:
                body = f.read(i.file_size + 1)
        except (zipfile.BadZipFile, zlib.error) as e:
            raise PackageError("corrupt") from e
        if len(body) != i.file_size:
            raise PackageError("corrupt")
        out[i.filename] = body
    return out


def safe_path(name: str) -> bool:
    return bool(name) and not re.search(r"^/|^[A-Za-z]:|\\|(^|/)\.\.(/|$)", name)


@dataclass
class Element:
    name: str
    attrs: dict = field(default_factory=dict)
    content: list = field(default_factory=list)

    def children(self, name: str | None = None) -> list["Element"]:
        return [c for c in self.content if isinstance(c, Element) and (name is None or c.name == name)]

    def child(self, name: str) -> "Element | None":
        return next(iter(self.children(name)), None)

    def all(self, name: str):
        for c in self.children():
            if c.name == name:
                yield c
            yield from c.all(name)

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.content)


_ENTITY = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def decode_entities(s: str) -> str:
    """Five named and all numeric references; unknown and impossible ones stay as they are."""

    def one(m: re.Match) -> str:
        e = m.group(1)
        if e[0] != "#":
            return _ENTITY.get(e, m.group())
        n = int(e[2:], 16) if e[1] in "xX" else int(e[1:])
        return chr(n) if n <= 0x10FFFF and not 0xD800 <= n <= 0xDFFF else m.group()

    return re.sub(r"&(#[xX][0-9A-Fa-f]{1,8}|#\d{1,8}|\w+);", one, s)


def local_name(q: str) -> str:
    return q.rsplit(":", 1)[-1]


def parse_xml(src: str | bytes) -> Element:
    """A tree of local names. External entities and document types are never resolved; unclosed ends are forgiven."""
    root, stack = Element("#document"), []
    stack.append(root)
    p = expat.ParserCreate()
    p.UseForeignDTD(False)
    p.SetParamEntityParsing(expat.XML_PARAM_ENTITY_PARSING_NEVER)

    def start(name, attrs):
        e = Element(local_name(name), {local_name(k): v for k, v in attrs.items()})
        stack[-1].content.append(e)
        stack.append(e)

    p.StartElementHandler = start
    p.EndElementHandler = lambda name: stack.pop() if len(stack) > 1 else None
    p.CharacterDataHandler = lambda t: stack[-1].content.append(t)
    p.EntityDeclHandler = None
    data = src.encode() if isinstance(src, str) else src
    data = re.sub(rb"<!DOCTYPE[^>\[]*(\[[^\]]*\])?[^>]*>", b"", data)
    data = re.sub(rb"&(?!#|amp;|lt;|gt;|quot;|apos;)", b"&amp;", data)
    try:
        p.Parse(data, True)
    except expat.ExpatError as e:
        if not root.children():
            raise PackageError("xml") from e
    return root.children()[0] if root.children() else root


def rels(files: dict, part: str) -> dict[str, tuple[str, str]]:
    """(target, type) of a part's relationships by id; targets outside the package stay as they are."""
    folder, name = posixpath.split(part)
    raw = files.get(posixpath.join(folder, "_rels", name + ".rels"))
    if raw is None:
        return {}
    out = {}
    for r in parse_xml(raw).all("Relationship"):
        t = r.attrs.get("Target", "")
        if r.attrs.get("TargetMode") != "External":
            t = resolve_path(folder, t)
        out[r.attrs.get("Id", "")] = (t, r.attrs.get("Type", ""))
    return out


def resolve_path(folder: str, target: str) -> str:
    joined = target if target.startswith("/") else posixpath.join("/" + folder, target)
    return posixpath.normpath("/" + joined.lstrip("/")).lstrip("/")


def heading_level(style: str) -> int:
    """1 for a title, N for heading N in five languages, else 0."""
    s = style.strip().lower()
    if s in ("title", "titre"):
        return 1
    m = re.match(r"^(?:heading|titre|.*berschrift|título|titulo|titolo)\s*(\d)$", s)
    return int(m.group(1)) if m else 0


def _runs(p: Element) -> list[dict]:
    out = []
    for r in p.all("r"):
        props = r.child("rPr")
        on = lambda n: props is not None and props.child(n) is not None and props.child(n).attrs.get("val", "1") not in ("0", "false")
        text = "".join({"t": lambda c: c.text(), "tab": lambda c: "\t", "br": lambda c: "\n", "noBreakHyphen": lambda c: "-"}.get(c.name, lambda c: "")(c) for c in r.children())
        if text:
            out.append({"text": text, "bold": on("b"), "italic": on("i")})
    return out


def _block(kind: str, text: str = "", level: int = 0, rows: list | None = None, runs: list | None = None) -> dict:
    return {"kind": kind, "level": level, "text": text, "rows": rows or [], "runs": runs or [{"text": text, "bold": False, "italic": False}] * bool(text)}


def parse_docx(files: dict[str, bytes]) -> list[dict]:
    """Headings, paragraphs, list items, tables, images and page breaks in order."""
    body = next(parse_xml(files["word/document.xml"]).all("body"), None)
    out: list[dict] = []
    for e in body.children() if body else []:
        if e.name == "tbl":
            rows = [["\n".join("".join(r["text"] for r in _runs(p)) for p in c.children("p")) for c in r.children("tc")] for r in e.children("tr")]
            out.append(_block("table", rows=rows))
        elif e.name == "p":
            props = e.child("pPr")
            style = next((s.attrs.get("val", "") for s in props.children("pStyle")), "") if props else ""
            runs = _runs(e)
            text = "".join(r["text"] for r in runs)
            if any(b.attrs.get("type") == "page" for b in e.all("br")):
                out.append(_block("page_break"))
            if any(True for _ in e.all("blip")):
                out.append(_block("image"))
            if heading_level(style):
                out.append(_block("heading", text, heading_level(style), runs=runs))
            elif props is not None and props.child("numPr") is not None:
                lvl = next((int(i.attrs.get("val", 0)) for i in props.all("ilvl")), 0)
                out.append(_block("list_item", text, lvl, runs=runs))
            elif text.strip():
                out.append(_block("paragraph", text, runs=runs))
    return out


def parse_cell_ref(ref: str) -> tuple[int, int]:
    """(column, row) of BC12, both from 0."""
    m = re.match(r"^([A-Z]+)(\d+)$", ref.upper())
    if not m:
        return 0, 0
    col = 0
    for c in m.group(1):
        col = col * 26 + ord(c) - 64
    return col - 1, int(m.group(2)) - 1


def excel_date(serial: float) -> str:
    t = datetime(1970, 1, 1) + timedelta(seconds=round((serial - 25569) * 86400))
    return t.strftime("%Y-%m-%d") if serial == int(serial) else t.strftime("%Y-%m-%d %H:%M")


def format_number(v: float) -> str:
    return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(round(v, 10))


def parse_xlsx(files: dict[str, bytes], most_rows: int = MOST_ROWS, most_columns: int = MOST_COLUMNS) -> list[dict]:
    """A heading and a table for each sheet: shared and inline strings, booleans, errors, dates by style, cached formulas.

    Cells beyond ``most_rows`` and ``most_columns`` are left out; ``truncated`` of the table says so.
    """
    book = parse_xml(files["xl/workbook.xml"])
    links = rels(files, "xl/workbook.xml")
    shared = ["".join(t.text() for t in s.all("t")) for s in parse_xml(files["xl/sharedStrings.xml"]).children("si")] if "xl/sharedStrings.xml" in files else []
    dates: set[int] = set()
    if "xl/styles.xml" in files:
        st = parse_xml(files["xl/styles.xml"])
        own = {int(n.attrs["numFmtId"]): n.attrs.get("formatCode", "") for n in st.all("numFmt")}
        xfs = st.child("cellXfs")
        for i, x in enumerate(xfs.children("xf") if xfs else []):
            f = int(x.attrs.get("numFmtId", 0))
            if 14 <= f <= 22 or re.search(r"[dmyh]", re.sub(r"\"[^\"]*\"|\[[^\]]*\]", "", own.get(f, "")).lower()):
                dates.add(i)
    out = []
    for sheet in book.all("sheet"):
        part = links.get(sheet.attrs.get("id", ""), ("", ""))[0]
        if part not in files:
            continue
        rows: dict[int, dict[int, str]] = {}
        cut = False
        for c in parse_xml(files[part]).all("c"):
            col, row = parse_cell_ref(c.attrs.get("r", ""))
            kind, v = c.attrs.get("t", "n"), c.child("v")
            raw = v.text() if v else ""
            if kind == "inlineStr":
                val = "".join(t.text() for t in c.all("t"))
            elif not raw:
                continue
            elif kind == "s":
                val = shared[int(raw)] if int(raw) < len(shared) else ""
            elif kind == "b":
                val = "VRAI" if raw == "1" else "FAUX"
            elif kind in ("str", "e"):
                val = raw
            else:
                val = excel_date(float(raw)) if int(c.attrs.get("s", 0)) in dates else format_number(float(raw))
            if row < most_rows and col < most_columns:
                rows.setdefault(row, {})[col] = val
            else:
                cut = True
        width = max((max(r) + 1 for r in rows.values() if r), default=0)
        table = [[r.get(k, "") for k in range(width)] for _, r in sorted(rows.items()) if any(r.values())]
        out += [_block("heading", sheet.attrs.get("name", ""), 1), _block("table", rows=table) | {"truncated": cut}]
    return out


def parse_pptx(files: dict[str, bytes]) -> list[dict]:
    """Slides in the presentation's order, parted by page breaks: title first, then bullets, tables and pictures."""
    links = rels(files, "ppt/presentation.xml")
    out: list[dict] = []
    for n, s in enumerate(parse_xml(files["ppt/presentation.xml"]).all("sldId"), 1):
        part = links.get(s.attrs.get("id", ""), ("", ""))[0]
        if part not in files:
            continue
        if out:
            out.append(_block("page_break"))
        title, rest = None, []
        for shape in parse_xml(files[part]).all("spTree"):
            for e in shape.children():
                if e.name == "graphicFrame":
                    rows = [["\n".join(p.text() for p in c.all("p")) for c in r.children("tc")] for r in e.all("tr")]
                    rest += [_block("table", rows=rows)] if rows else []
                elif e.name == "pic":
                    rest.append(_block("image"))
                elif e.name == "sp":
                    kind = next((p.attrs.get("type", "") for p in e.all("ph")), "")
                    texts = ["".join(t.text() for t in p.all("t")) for p in e.all("p")]
                    if kind in ("title", "ctrTitle") and title is None and any(texts):
                        title = " ".join(t for t in texts if t)
                    else:
                        rest += [_block("list_item", t) for t in texts if t.strip()]
        out += [_block("heading", title or f"Diapositive {n}", 1), *rest]
    return out


def parse_txt(data: bytes) -> list[dict]:
    """UTF-8, else Windows-1252; one paragraph for each line, a line with a form feed alone breaks the page."""
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = data.decode("cp1252", errors="replace")
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return [_block("page_break") if t == "\f" else _block("paragraph", t) for t in lines]


def ooxml_kind(content_types: str) -> str | None:
    """docx, xlsx or pptx by the package's main type; none for packages with macros."""
    if re.search("macroEnabled", content_types):
        return None
    for mark, kind in (("wordprocessingml.document.main", "docx"), ("spreadsheetml.sheet.main", "xlsx"), ("presentationml.presentation.main", "pptx")):
        if mark in content_types:
            return kind
    return None


def blocks_text(blocks: list[dict]) -> str:
    lines = []
    for b in blocks:
        lines += ["\t".join(r) for r in b["rows"]] if b["kind"] == "table" else [b["text"]] if b["kind"] in ("heading", "paragraph", "list_item") else []
    return "\n".join(lines)


def read_document(name: str, data: bytes) -> tuple[str, list[dict]]:
    """(kind, blocks) by real content, not by name; PackageError says why not."""
    if not data:
        raise PackageError("empty")
    kind, ext = sniff(data), name.rsplit(".", 1)[-1].lower() if "." in name else ""
    group = "image" if kind in ("jpeg", "png", "webp", "gif", "bmp") else {"pdf": "pdf", "zip": "office", "text": "text"}.get(kind)
    if kind == "svg" or kind == "text" and ext in ("html", "htm", "js", "xml", "svg"):
        raise PackageError("dangerous")
    if kind == "ole":
        raise PackageError("legacy-office")
    if group and len(data) > LIMITS[group]:
        raise PackageError("too-large")
    if kind == "zip":
        files = read_zip(data)
        office = ooxml_kind(files.get("[Content_Types].xml", b"").decode("utf-8", "replace"))
        if office is None:
            raise PackageError("unsupported")
        return office, {"docx": parse_docx, "xlsx": parse_xlsx, "pptx": parse_pptx}[office](files)
    if kind == "text":
        if ext not in ("txt", "text", "md", "csv", "log", ""):
            raise PackageError("mismatch")
        return "txt", parse_txt(data)
    if group in ("pdf", "image"):
        return group, []
    raise PackageError("unsupported")


_IMPORTED = "path string, kind string, error string, text string, blocks array<struct<kind:string,level:int,text:string,rows:array<array<string>>>>"


def _import(batches):
    for pdf in batches:
        rows = []
        for path, data in zip(pdf["path"], pdf["content"]):
            try:
                kind, blocks = read_document(path, bytes(data))
                rows.append((path, kind, None, blocks_text(blocks), [{k: b[k] for k in ("kind", "level", "text", "rows")} for b in blocks]))
            except Exception as e:  # one bad file becomes a row, never an end of the job
                rows.append((path, None, str(e) if isinstance(e, PackageError) else "corrupt", None, None))
        yield pd.DataFrame(rows, columns=["path", "kind", "error", "text", "blocks"])


def import_files(files: DataFrame) -> DataFrame:
    """(path, kind, error, text, blocks) of ``binaryFile`` rows; files that can't be read have an error code instead."""
    return files.select("path", "content").mapInPandas(_import, _IMPORTED)


def parse_tsv(lines: Column) -> Column:
    """Recognised words of a table with 12 tab-parted columns as array of struct(block, par, line, text, conf, x, y, w, h)."""
    rows = F.filter(F.transform(F.split(lines, "\n"), lambda r: F.split(r, "\t")), lambda c: (F.size(c) >= 12) & (F.get(c, F.lit(0)) == "5"))
    num = lambda c, i: F.get(c, F.lit(i)).try_cast("double")
    words = F.transform(rows, lambda c: F.struct(num(c, 2).alias("block"), num(c, 3).alias("par"), num(c, 4).alias("line"), F.array_join(F.slice(c, 12, 100), "\t").alias("text"), num(c, 10).alias("conf"), num(c, 6).alias("x"), num(c, 7).alias("y"), num(c, 8).alias("w"), num(c, 9).alias("h")))
    return F.filter(words, lambda w: F.length(F.trim(w["text"])) > 0)


def tsv_text(words: Column) -> Column:
    """Their text: words by spaces, lines by line feeds, paragraphs by blank lines."""

    def add(acc: Column, w: Column) -> Column:
        same_par = (acc["block"] == w["block"]) & (acc["par"] == w["par"])
        glue = F.when(acc["t"] == "", "").when(~same_par, "\n\n").when(acc["line"] != w["line"], "\n").otherwise(" ")
        return F.struct(F.concat(acc["t"], glue, w["text"]).alias("t"), w["block"].alias("block"), w["par"].alias("par"), w["line"].alias("line"))

    nothing = F.lit(-1.0)
    return F.aggregate(words, F.struct(F.lit("").alias("t"), nothing.alias("block"), nothing.alias("par"), nothing.alias("line")), add)["t"]
