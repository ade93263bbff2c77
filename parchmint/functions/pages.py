"""Ordered page lists as arrays: pages are structs with an ``id``; the place in the array is the page's place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _array(ids: list[str]) -> Column:
    return F.array(*[F.lit(i) for i in ids]).cast("array<string>")


def add_pages(pages: Column, added: Column, at: Column) -> Column:
    """Inserted at a place clamped to the list."""
    k = F.least(F.greatest(at, F.lit(0)), F.size(pages))
    return F.concat(F.slice(pages, F.lit(1), k), added, F.slice(pages, k + 1, F.size(pages) + 1))


def remove_pages(pages: Column, ids: list[str]) -> Column:
    return F.filter(pages, lambda p: ~F.array_contains(_array(ids), p["id"]))


def selected_pages(pages: Column, ids: list[str]) -> Column:
    """The given pages in the document's order; no ids mean all."""
    return F.filter(pages, lambda p: F.array_contains(_array(ids), p["id"])) if ids else pages


def move_page(pages: Column, start: Column, to: Column) -> Column:
    """One page moved; a bad start changes nothing, the target is clamped after the removal."""
    rest = F.filter(pages, lambda p, i: i != start)
    moved = add_pages(rest, F.slice(pages, start + 1, F.lit(1)), to)
    return F.when((start >= 0) & (start < F.size(pages)), moved).otherwise(pages)


def duplicate_page(pages: Column, id: str, new_id: Column) -> Column:
    """A copy with another id right after the page; an unknown id changes nothing."""
    return F.flatten(F.transform(pages, lambda p: F.when(p["id"] == id, F.array(p, p.withField("id", new_id))).otherwise(F.array(p))))


def replace_page(pages: Column, id: str, page: Column) -> Column:
    return F.transform(pages, lambda p: F.when(p["id"] == id, page).otherwise(p))


def rotate_page(page: Column, turns: Column) -> Column:
    """Quarter turns modulo 4, negative ones too; odd turns swap width and height."""
    odd = F.pmod(turns, F.lit(2)) == 1
    turned = page.withField("rotation", F.pmod(page["rotation"] + turns, F.lit(4)).cast("int"))
    return turned.withField("width", F.when(odd, page["height"]).otherwise(page["width"])).withField("height", F.when(odd, page["width"]).otherwise(page["height"]))


def set_filter(pages: Column, ids: list[str] | None, name: str) -> Column:
    hit = (lambda p: F.lit(True)) if ids is None else (lambda p: F.array_contains(_array(ids), p["id"]))
    return F.transform(pages, lambda p: F.when(hit(p), p.withField("filter", F.lit(name))).otherwise(p))


def page_ranges(spec: Column, n: Column) -> Column:
    """"1-3, 5" as sorted distinct places from 0; null for anything malformed, out of range or empty."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda x: F.trim(x)), lambda p: p != "")
    ends = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^(\d{1,9})", 1).alias("a"), F.coalesce(F.nullif(F.regexp_extract(p, r"-\s*(\d{1,9})$", 1), F.lit("")), F.regexp_extract(p, r"^(\d{1,9})", 1)).alias("b"), p.alias("p")))
    ok = F.forall(ends, lambda e: e["p"].rlike(r"^\d{1,9}(\s*-\s*\d{1,9})?$") & (F.expr("1") <= e["a"].try_cast("int")) & (e["a"].try_cast("int") <= e["b"].try_cast("int")) & (e["b"].try_cast("int") <= n))
    places = F.flatten(F.transform(ends, lambda e: F.sequence(e["a"].try_cast("int") - 1, e["b"].try_cast("int") - 1)))
    return F.when((F.size(parts) > 0) & ok, F.array_sort(F.array_distinct(places)))


def extract_pages(pages: Column, places: Column) -> Column:
    """Pages by place, in the given order; places that don't exist are left out."""
    return F.transform(F.filter(places, lambda i: (i >= 0) & (i < F.size(pages))), lambda i: F.get(pages, i))


def split_every(pages: Column, every: int) -> Column:
    """Parts of ``every`` pages; null where that gives fewer than two parts."""
    parts = F.ceil(F.size(pages) / every).cast("int")
    return F.when(parts >= 2, F.transform(F.sequence(F.lit(0), F.greatest(parts - 1, F.lit(0))), lambda k: F.slice(pages, k * every + 1, F.lit(every))))


def split_at(pages: Column, starts: list[int]) -> Column:
    """Parts that begin at the given places; the first page always begins one; null below two parts."""
    cuts = sorted({0, *(s for s in starts if s > 0)})
    bounds = F.array_distinct(F.concat(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.size(pages)), F.array(F.size(pages))))
    parts = F.transform(F.slice(bounds, F.lit(1), F.greatest(F.size(bounds) - 1, F.lit(0))), lambda a, i: F.slice(pages, a + 1, F.get(bounds, i + 1) - a))
    return F.when(F.size(parts) >= 2, parts)


def page_text(ocr_text: Column, text: Column) -> Column:
    """What was recognised, even if empty, else the text layer, else nothing."""
    return F.coalesce(ocr_text, text, F.lit(""))


def document_text(texts: Column) -> Column:
    """The texts of pages that have some, parted by blank lines."""
    return F.array_join(F.filter(texts, lambda t: F.length(t) > 0), "\n\n")


def content_blobs(pages: Column, original: Column) -> Column:
    """Distinct ids of the blobs a document holds: three for each page, images among annotations, the original file."""
    own = F.flatten(F.transform(pages, lambda p: F.array(p["original"], p["processed"], p["thumb"])))
    return F.array_distinct(F.filter(F.concat(own, F.array(original)), lambda b: F.coalesce(F.length(b), F.lit(0)) > 0))


def remap_blobs(ids: Column, mapping: Column) -> Column:
    return F.transform(ids, lambda i: F.coalesce(mapping[i], i))


def blank_pages(pages: Column) -> Column:
    """Ids of pages marked blank that have neither text nor annotations."""
    blank = F.filter(pages, lambda p: F.coalesce(p["blank"], F.lit(False)) & (F.length(F.trim(F.coalesce(p["text"], F.lit("")))) == 0) & (F.coalesce(p["annotations"], F.lit(0)) == 0))
    return F.transform(blank, lambda p: p["id"])


def merge_concurrent(latest: Column, edited: Column) -> Column:
    """The edited page; text that it lacks comes from the latest one, if both show the same part of the same image."""
    same = latest["rotation"].eqNullSafe(edited["rotation"]) & latest["quad"].eqNullSafe(edited["quad"]) & latest["original"].eqNullSafe(edited["original"])
    out = edited
    for f in ("ocr_text", "text"):
        out = out.withField(f, F.coalesce(edited[f], F.when(same, latest[f])))
    return out


class UndoStack:
    """States with undo and redo, ``limit`` of them; a push clears what could be redone."""

    def __init__(self, state, limit: int = 50):
        self.state, self.limit, self._back, self._ahead = state, limit, [], []

    def push(self, state) -> None:
        self._back = [*self._back, self.state][-self.limit :]
        self.state, self._ahead = state, []

    def undo(self):
        if self._back:
            self._ahead.append(self.state)
            self.state = self._back.pop()
        return self.state

    def redo(self):
        if self._ahead:
            self._back.append(self.state)
            self.state = self._ahead.pop()
        return self.state

    def sync(self, state) -> None:
        self.state = state

    def reset(self, state) -> None:
        self.state, self._back, self._ahead = state, [], []
