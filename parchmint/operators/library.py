"""Writes to the library: folders, trash, history, blobs, and documents made of others' pages. Frames in, frames out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmint.functions.pages import extract_pages
from parchmint.operators.hierarchy import may_move, name_is_free
from parchmint.operators.repository import marked, touch, trash


# -- folders -------------------------------------------------------------------------------------------------------------
def create_folder(folders: DataFrame, id: str, name: str, parent: str | None, at: str, color: str | None = None) -> DataFrame:
    """One folder more; its name is trimmed, must not be blank and must be free under its parent, accents and case aside."""
    name = name.strip()
    if not name:
        raise ValueError("a folder needs a name")
    if not name_is_free(folders, name, parent):
        raise ValueError(f"there is a folder {name!r} already")
    row = folders.sparkSession.range(1).select(*[F.lit({"id": id, "name": name, "parent_id": parent, "color": color, "created_at": at, "updated_at": at}.get(c)).cast(kind).alias(c) for c, kind in folders.dtypes])
    return folders.unionByName(row)


def rename_folder(folders: DataFrame, id: str, name: str, at: str) -> DataFrame:
    """The folder under another name, which must be free among its neighbours; a name it bears already changes nothing but the time."""
    name = name.strip()
    own = folders.where(F.col("id") == id).select("parent_id").first()
    if own is None or not name:
        raise ValueError("no such folder, or no name")
    if not name_is_free(folders.where(F.col("id") != id), name, own.parent_id):
        raise ValueError(f"there is a folder {name!r} already")
    return _changed(folders, id, at, {"name": F.lit(name)})


def move_folder(folders: DataFrame, id: str, target: str | None, at: str) -> DataFrame:
    """The folder under another parent (None: the root), never under itself or what lies below it."""
    if not may_move(folders, id, target):
        raise ValueError("a folder can't go under itself")
    return _changed(folders, id, at, {"parent_id": F.lit(target)})


def recolor_folders(folders: DataFrame, ids: DataFrame, color: str | None, at: str) -> DataFrame:
    hit = marked(folders, ids)
    new = {"color": F.lit(color), "updated_at": F.lit(at)}
    return hit.withColumns({c: F.when(F.col("_hit"), v.cast(dict(folders.dtypes)[c])).otherwise(F.col(c)) for c, v in new.items()}).drop("_hit")


def _changed(df: DataFrame, id: str, at: str, changes: dict[str, Column]) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.when(F.col("id") == id, v.cast(kinds[c])).otherwise(F.col(c)) for c, v in (changes | {"updated_at": F.lit(at)}).items()})


# -- trash and history ---------------------------------------------------------------------------------------------------
def empty_trash(docs: DataFrame, folders: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, folders, ids of what went): all that lies in the trash is gone for good, folders too."""
    gone = trash(docs).select("id").union(trash(folders).select("id"))
    return docs.where("deleted_at is null"), folders.where("deleted_at is null"), gone


def logged(entries: DataFrame, new: DataFrame) -> DataFrame:
    """The history with new entries; one that is there already (by id) is not written again, repeats among the new count once."""
    return entries.unionByName(new.dropDuplicates(["id"]).join(entries.select("id").distinct(), "id", "left_anti").select(entries.columns))


def cleared(entries: DataFrame) -> DataFrame:
    return entries.limit(0)


# -- blobs ---------------------------------------------------------------------------------------------------------------
def put_blobs(blobs: DataFrame, new: DataFrame) -> DataFrame:
    """The table of blobs (blob_id, content) with the new ones; an id that exists gets the new content."""
    return blobs.join(new.select("blob_id"), "blob_id", "left_anti").unionByName(new)


def get_blobs(blobs: DataFrame, ids: DataFrame) -> DataFrame:
    """(blob_id, content) of the wanted ids; content is null where there is none."""
    return ids.select("blob_id").distinct().join(blobs, "blob_id", "left")


def delete_blobs(blobs: DataFrame, ids: DataFrame) -> DataFrame:
    return blobs.join(ids.select("blob_id"), "blob_id", "left_anti")


# -- documents from pages ------------------------------------------------------------------------------------------------
def split_titles(title: Column, parts: Column) -> Column:
    """Array of (title, first page from 1, pages) of the parts of a document, or null where it isn't split."""
    starts = F.transform(parts, lambda p, k: F.aggregate(F.slice(parts, F.lit(1), k), F.lit(1), lambda n, q: n + F.size(q)))
    return F.transform(parts, lambda p, k: F.struct(F.concat(title, F.lit(" (partie "), (k + 1).cast("string"), F.lit(")")).alias("title"), F.get(starts, k).alias("first"), F.size(p).alias("pages")))


def extracted(title: Column, pages: Column, places: Column) -> Column:
    """(title, pages) of a document made of some pages of another; null where no wanted page exists."""
    label = F.concat(F.lit(" (p. "), (F.get(places, F.lit(0)) + 1).cast("string"), F.when(F.size(places) > 1, F.concat(F.lit("-"), (F.try_element_at(places, F.lit(-1)) + 1).cast("string"))).otherwise(""), F.lit(")"))
    own = extract_pages(pages, places)
    return F.when(F.size(own) > 0, F.struct(F.concat(title, label).alias("title"), own.alias("pages")))


def keep_unlocked(docs: DataFrame, ids: DataFrame | list[str], at: str, flag: str = "relock_pending") -> DataFrame:
    """Documents opened for a time stay open: the mark to lock them again is taken away, as a touching write."""
    return touch(docs, ids, at, {flag: F.lit(None)})
