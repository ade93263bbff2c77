"""Text set in lines and pages, with the widths of the standard sans-serif font."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

# Advance widths (thousandths of the size) of the printable ASCII characters, from the space on.
_ASCII = [
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
]
# Widths of characters that aren't a letter with an accent.
_OTHER = {"€": 556, "‚": 222, "„": 333, "…": 1000, "‰": 1000, "‹": 333, "›": 333, "Œ": 1000, "œ": 944, "‘": 222, "’": 222, "“": 333, "”": 333, "•": 350, "–": 556, "—": 1000, "™": 1000, "Æ": 1000, "æ": 889, "Ø": 778, "ø": 611, "ß": 611, "°": 400, "«": 556, "»": 556, "©": 737, "®": 737, "·": 333, " ": 278, "í": 278, "ì": 278, "î": 278, "ï": 278}
# A4 at 150 dots an inch, and the measures of its text.
PAGE_WIDTH, PAGE_HEIGHT, MARGIN, BASE_SIZE, LEADING = 1240, 1754, 130, 22, 1.4
# Size of a heading by its level, in parts of the base size.
HEADINGS = {1: 1.75, 2: 1.45, 3: 1.25, 4: 1.12, 5: 1.05}
# Gaps, in parts of the text's size: around headings, after paragraphs, tables and pictures, for a blank paragraph.
BEFORE_HEADING, AFTER_HEADING, WITH_HEADING, AFTER_PARAGRAPH, AFTER_WHOLE, BLANK_LINES, INDENT = 0.6, 0.3, 3.0, 0.35, 0.6, 0.6, 1.5
# Tables, with sizes in parts of the base size and the width of a column in characters.
CELL_SIZE, SMALL_CELLS, LEAST_CELL_SIZE, PADDING, CELL_LEADING, FEWEST_CHARS, MOST_CHARS = 0.85, 0.75, 12, 8, 1.25, 4, 40
# Place of the base line in a line, and of a word's box above it.
MIDDLE, DROP, RISE, BOX = 0.5, 0.35, 0.8, 1.05
POINTS_WIDE, MOST_OF_PAGE = 595.28, 0.9


def win_ansi(text: str) -> bytes:
    """Windows-1252; other letters by their base letter, the rest as question marks; tabs and line ends as spaces."""
    out = bytearray()
    for c in text:
        if c in "\t\n\r":
            out.append(32)
            continue
        for t in (c, unicodedata.normalize("NFD", c)[0]):
            try:
                b = t.encode("cp1252")
            except UnicodeEncodeError:
                continue
            if b[0] >= 32 and b[0] != 127:
                out += b
                break
        else:
            out += b"?"
    return bytes(out)


def _width_of(code: int) -> int:
    if 32 <= code <= 126:
        return _ASCII[code - 32]
    c = bytes([code]).decode("cp1252", errors="replace")
    if c in _OTHER:
        return _OTHER[c]
    base = unicodedata.normalize("NFD", c)[0]
    return _ASCII[ord(base) - 32] if 32 <= ord(base) <= 126 else 556


_WIDTHS = [0] * 32 + [_width_of(i) for i in range(32, 256)]


def helvetica_width(data: bytes, size: float) -> float:
    return sum(_WIDTHS[b] for b in data) * size / 1000


@lru_cache(maxsize=100_000)
def measure(text: str, size: float) -> float:
    return helvetica_width(win_ansi(text), size)


@dataclass(frozen=True)
class Font:
    size: float
    bold: bool = False
    italic: bool = False


Measure = Callable[[str, Font], float]


@dataclass
class Line:
    """Words (text, font, x, width) of a line; blanks between them are words of one space."""

    words: list[tuple[str, Font, float, float]] = field(default_factory=list)
    height: float = 0.0

    @property
    def width(self) -> float:
        return self.words[-1][2] + self.words[-1][3] if self.words else 0.0

    @property
    def text(self) -> str:
        return "".join(w[0] for w in self.words)


def _tokens(runs: list[dict], size: float, bold: bool = False) -> Iterator[tuple[str, Font]]:
    """Words, single spaces and line feeds of text runs; a tab is a space like any other."""
    for r in runs:
        font = Font(size, bold or bool(r.get("bold")), bool(r.get("italic")))
        for t in re.findall(r"\n|[ \t]+|[^\n \t]+", r["text"]):
            yield (" " if t[0] in " \t" else t), font


def _chopped(word: str, font: Font, most: float, measure: Measure) -> Iterator[str]:
    """A word in pieces that fit a line, each of at least one character."""
    while word and measure(word, font) > most:
        n = max(1, bisect_right(range(1, len(word) + 1), most, key=lambda k: measure(word[:k], font)))
        yield word[:n]
        word = word[n:]
    if word:
        yield word


def wrap(tokens: Iterator[tuple[str, Font]], most: float, measure: Measure, leading: float) -> list[Line]:
    """Greedy lines: a word that doesn't fit begins the next, one wider than a line is cut, line feeds end lines, blanks at both ends go."""
    done: list[Line] = []
    now, size = Line(), 0.0

    def end() -> None:
        nonlocal now
        while now.words and now.words[-1][0] == " ":
            now.words.pop()
        done.append(now)
        now = Line()

    for text, font in tokens:
        size = size or font.size
        if text == "\n":
            now.height = max(now.height, font.size * leading)
            end()
            continue
        if text == " " and not now.words:
            continue
        pieces = [text] if text == " " else list(_chopped(text, font, most, measure))
        for piece in pieces:
            w = measure(piece, font)
            if text != " " and now.words and (len(pieces) > 1 or now.width + w > most):
                end()
            now.words.append((piece, font, now.width, w))
            now.height = max(now.height, font.size * leading)
    if now.words or not done:
        now.height = now.height or (size or 16) * leading
        end()
    return done


def break_lines(text: str, most: float, width: Callable[[str], float]) -> list[str]:
    """The texts of the lines of one font, where ``width`` measures a text."""
    return [line.text for line in wrap(_tokens([{"text": text}], 1.0), most, lambda t, _: width(t), 1.0)]


@dataclass
class Row:
    """What is set in one go: its height, its words (text, x, y, width, height; y from its top) and its text."""

    height: float
    words: list[tuple[str, float, float, float, float]]
    text: str | None = None


def _boxes(line: Line, x: float, top: float = 0.0) -> list[tuple]:
    base = top + line.height * MIDDLE + max((w[1].size for w in line.words), default=1) * DROP
    return [(t, x + at, base - f.size * RISE, w, f.size * BOX) for t, f, at, w in line.words if t != " "]


def _table_rows(rows: list[list[str]], wide: float, margin: float, size: float, measure: Measure) -> Iterator[Row]:
    """A table's rows, never split: columns share the width by their longest cell, the first row is bold."""
    columns = range(max(map(len, rows), default=0) or 1)
    cell = lambda r, c: r[c] if c < len(r) else ""
    share = [min(MOST_CHARS, max([FEWEST_CHARS, *(len(cell(r, c)) for r in rows)])) for c in columns]
    widths = [wide * k / sum(share) for k in share]
    left = [0.0, *accumulate(widths)]
    size *= CELL_SIZE
    if min(widths) < 3 * size:
        size = max(LEAST_CELL_SIZE, size * SMALL_CELLS)
    for at, r in enumerate(rows):
        cells = [wrap(_tokens([{"text": cell(r, c)}], size, at == 0), max(10, widths[c] - 2 * PADDING), measure, CELL_LEADING) for c in columns]
        words = [b for c, lines in zip(columns, cells) for line, top in zip(lines, accumulate((x.height for x in lines), initial=float(PADDING))) for b in _boxes(line, margin + left[c] + PADDING, top)]
        yield Row(max(sum(x.height for x in lines) for lines in cells) + 2 * PADDING, words, "\t".join(cell(r, c) for c in columns))


class _Pages:
    """Pages being filled from top to bottom."""

    def __init__(self, width: float, height: float, margin: float):
        self.size, self.top, self.bottom, self.done = (width, height), float(margin), height - margin, []
        self._begin()

    def _begin(self) -> None:
        self.y, self.page = self.top, {"width": self.size[0], "height": self.size[1], "words": [], "pictures": [], "text": ""}
        self.used = False

    def turn(self) -> None:
        self.done.append(self.page)
        self._begin()

    def skip(self, gap: float, also_on_top: bool = True) -> None:
        self.y += gap if also_on_top or self.y > self.top else 0.0

    def want(self, room: float, also_on_top: bool = False) -> None:
        if self.y + room > self.bottom and (also_on_top or self.y > self.top):
            self.turn()

    def put(self, row: Row) -> None:
        self.want(row.height)
        self.page["words"] += [{"text": t, "x": x, "y": self.y + dy, "w": w, "h": h} for t, x, dy, w, h in row.words]
        self.page["text"] += "" if row.text is None else row.text + "\n"
        self.used = self.used or bool(row.words)
        self.y += row.height


def layout_blocks(blocks: list[dict], size: float = BASE_SIZE, width: float = PAGE_WIDTH, height: float = PAGE_HEIGHT, margin: float = MARGIN, leading: float = LEADING, measure_text: Measure | None = None, picture_size: Callable[[int], tuple[float, float] | None] | None = None) -> list[dict]:
    """Pages (width, height, text, words with boxes, pictures) of headings, paragraphs, list items, tables, pictures and page breaks.

    A block has ``kind``, ``text`` or ``runs``, ``level`` of a heading, ``rows`` of a table; a list item may have
    ``number``, a paragraph ``align``, a picture ``width_pt`` and ``height_pt``. ``measure_text`` gives the width of a text
    in a font, ``picture_size`` that of a picture by its place among the blocks; without it pictures are left out. The
    last page is given only if something stands on it, or if there is no other.
    """
    measure_font = measure_text or (lambda t, f: measure(t, f.size))
    pages, wide = _Pages(width, height, margin), width - 2 * margin

    def lines(b: dict, s: float, bold: bool = False, indent: float = 0.0, lead: str = "") -> None:
        runs = [{"text": lead}] * bool(lead) + list(b.get("runs") or [{"text": b.get("text") or ""}])
        for line in wrap(_tokens(runs, s, bold), wide - indent, measure_font, leading):
            shift = {"center": 0.5, "right": 1.0}.get(b.get("align") or "", 0.0) * (wide - line.width)
            pages.put(Row(line.height, _boxes(line, margin + indent + shift), line.text))

    for at, b in enumerate(blocks):
        kind = b["kind"]
        if kind == "page_break":
            if pages.y > pages.top or pages.used:
                pages.turn()
        elif kind == "heading":
            s = size * HEADINGS.get(b.get("level") or 0, 1.0)
            pages.skip(s * BEFORE_HEADING, also_on_top=False)
            pages.want(s * WITH_HEADING, also_on_top=True)
            lines(b, s, bold=True)
            pages.skip(s * AFTER_HEADING)
        elif kind in ("paragraph", "list_item"):
            if not (b.get("text") or "").strip() and not any(r["text"].strip() for r in b.get("runs") or []):
                pages.skip(size * leading * BLANK_LINES)
                pages.want(0.0, also_on_top=True)
                continue
            lead = "" if kind == "paragraph" else f"{b['number']}. " if b.get("number") else "• "
            lines(b, size, indent=INDENT * size if lead else 0.0, lead=lead)
            pages.skip(size * AFTER_PARAGRAPH)
        elif kind == "table":
            for row in _table_rows(b["rows"], wide, margin, size, measure_font):
                pages.put(row)
            pages.skip(size * AFTER_WHOLE)
        elif kind == "image" and picture_size and (natural := picture_size(at)):
            w, h = (b[k] * width / POINTS_WIDE if b.get(k) else n for k, n in zip(("width_pt", "height_pt"), natural))
            fit = min(1.0, wide / w, (pages.bottom - pages.top) * MOST_OF_PAGE / h)
            w, h = w * fit, h * fit
            pages.want(h, also_on_top=True)
            pages.page["pictures"].append({"block": at, "x": margin + (wide - w) / 2, "y": pages.y, "w": w, "h": h})
            pages.used = True
            pages.skip(h + size * AFTER_WHOLE)
    if pages.used or not pages.done:
        pages.turn()
    return pages.done


def layout_pages(text: str) -> list[dict]:
    """The pages of a plain text on A4 in points."""
    blocks = [{"kind": "paragraph", "level": 0, "text": p, "rows": []} for p in text.split("\n")]
    return layout_blocks(blocks, size=10, width=595, height=842, margin=56)
