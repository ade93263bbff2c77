"""The document repository: views, trash, retention, history, tags, blobs, merges. Frames in, frames out; no clock inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TRASH_DAYS, MOST_HISTORY, MOST_TAGS, MOST_NOTES = 30, 500, 30, 20_000
# Labels of document sources.
FORMATS = {"pdf": "PDF", "image": "Image", "docx": "Word", "xlsx": "Excel", "pptx": "PowerPoint", "txt": "Texte"}


def current_documents(versions: DataFrame) -> DataFrame:
    """The row with the greatest revision of each id; rows identical in every column count once.

    Ties go to the later update, then to the greater title. One aggregation with a partial step.
    """
    rest = [c for c in versions.columns if c not in ("id", "revision", "updated_at", "title")]
    row = F.struct("revision", "updated_at", "title", *rest)
    best = versions.where(F.col("id").isNotNull()).groupBy("id").agg(F.max_by(row, F.struct("revision", "updated_at", "title")).alias("_r"))
    return best.select("id", *[F.col(f"_r.{c}").alias(c) for c in versions.columns if c != "id"])


def live(df: DataFrame) -> DataFrame:
    return df.where(F.col("deleted_at").isNull())


def trash(df: DataFrame) -> DataFrame:
    """Tombstoned rows, the newest first."""
    return df.where(F.col("deleted_at").isNotNull()).orderBy(F.desc("deleted_at"), "id")


def in_folder(docs: DataFrame, folder: str | None) -> DataFrame:
    """Live documents of a folder; None is the root."""
    return live(docs).where(F.col("folder_id").eqNullSafe(F.lit(folder)))


def subfolders(folders: DataFrame, parent: str | None) -> DataFrame:
    return live(folders).where(F.col("parent_id").eqNullSafe(F.lit(parent)))


def format_label(source: Column) -> Column:
    c = F.lit("Scan")
    for k, v in FORMATS.items():
        c = F.when(source == k, v).otherwise(c)
    return c


def days_left(deleted_at: Column, as_of: str, days: int = TRASH_DAYS) -> Column:
    age = F.floor((F.lit(as_of).cast("timestamp").cast("double") - deleted_at.cast("double")) / 86400)
    return F.greatest(F.lit(0), F.lit(days) - age).cast("bigint")


def expired(df: DataFrame, as_of: str, days: int = TRASH_DAYS) -> DataFrame:
    """Rows that have lain in the trash for longer than the retention."""
    return df.where(F.col("deleted_at") < F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS"))


def after_retention(df: DataFrame, as_of: str, days: int = TRASH_DAYS) -> DataFrame:
    """What a start of the library keeps."""
    return df.where(F.col("deleted_at").isNull() | (F.col("deleted_at") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")))


def recent(docs: DataFrame, limit: int = 12) -> DataFrame:
    """Live documents by their last update or opening, newest first."""
    return live(docs).withColumn("last_used", F.greatest("updated_at", F.coalesce("opened_at", "updated_at"))).orderBy(F.desc("last_used"), "id").limit(limit)


def sort_documents(docs: DataFrame, by: str = "date") -> DataFrame:
    """By date (newest first), name (French, figures by value), size (largest first) or type, ties by date and id."""
    if by == "name":
        padded = F.regexp_replace(F.regexp_replace("title", r"(\d+)", "00000000000000000000$1"), r"0*(\d{20})(?!\d)", "$1")
        return docs.orderBy(F.collate(padded, "fr_CI_AI"), F.desc("updated_at"), "id")
    first = {"date": [], "size": [F.desc("size_bytes")], "type": [F.asc_nulls_last(format_label(F.col("source")))]}[by]
    return docs.orderBy(*first, F.desc("updated_at"), "id")


def history(entries: DataFrame, limit: int = 200) -> DataFrame:
    """Entries sent twice count once (the one received first); the newest first."""
    once = entries.groupBy("id").agg(F.min_by(F.struct("happened_at", "history_action", "doc_id", "title", "detail"), F.struct("received_at", "happened_at")).alias("_r")).select("id", "_r.*")
    return once.orderBy(F.desc("happened_at"), F.desc("id")).limit(limit)


def history_filtered(entries: DataFrame, action: str, limit: int = 300) -> DataFrame:
    """Entries of one action among the newest ``limit``: the limit comes first."""
    return history(entries, limit).where(F.col("history_action") == action)


def all_tags(docs: DataFrame) -> DataFrame:
    return live(docs).select(F.explode("tags").alias("tag")).distinct()


def normalized_tags(tags: Column) -> Column:
    """Trimmed, lower case, each once in order, ``MOST_TAGS`` at most."""
    t = F.filter(F.transform(tags, lambda x: F.lower(F.trim(x))), lambda x: F.length(x) > 0)
    return F.slice(F.array_distinct(t), 1, MOST_TAGS)


def tag_suggestions(docs: DataFrame, prefix: str, taken: list[str], limit: int = 8) -> DataFrame:
    return all_tags(docs).where(F.col("tag").startswith(prefix.lower()) & ~F.col("tag").isin(taken)).orderBy("tag").limit(limit)


def unreferenced(blobs: DataFrame, references: DataFrame, keep: DataFrame | None = None, id: str = "blob_id") -> DataFrame:
    """Blobs that nothing refers to. Distinct ids meet; references by many rows are combined before the shuffle."""
    used = references.select(id) if keep is None else references.select(id).union(keep.select(id))
    return blobs.join(used.where(F.col(id).isNotNull()).distinct(), id, "left_anti")


def document_sizes(references: DataFrame, blobs: DataFrame) -> DataFrame:
    """(doc_id, size): the distinct blobs of a document added up; missing blobs are 0."""
    return references.distinct().join(blobs.select("blob_id", "size"), "blob_id", "left").groupBy("doc_id").agg(F.sum(F.coalesce("size", F.lit(0))).alias("size"))


def merge_by(existing: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """Upsert of a backup: an incoming row replaces one of a lower version and adds a new key; equal versions keep what is there.

    Nested and null columns go along. One shuffle of both sides.
    """
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.select(existing.columns).withColumn("_new", F.lit(1)))
    row = F.struct(*existing.columns)
    best = both.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(row, F.struct(F.col(version), -F.col("_new"))).alias("_r"))
    return best.select("_r.*")


def merge_history(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return existing.unionByName(incoming.join(existing.select("id"), "id", "left_anti").dropDuplicates(["id"]))


def retained_history(entries: DataFrame, most: int = MOST_HISTORY) -> DataFrame:
    """The newest ``most`` entries: a top-k, so no single window over all rows."""
    return entries.orderBy(F.desc("happened_at"), F.desc("id")).limit(most)


def touch(docs: DataFrame, ids: DataFrame | list[str], at: str, changes: dict[str, Column]) -> DataFrame:
    """A touching write: the changes, a new time and the next revision for the given documents (a frame with id, or a short list)."""
    new = changes | {"updated_at": F.lit(at), "revision": F.col("revision") + 1}
    kinds = dict(docs.dtypes)
    return marked(docs, ids).withColumns({c: F.when(F.col("_hit"), v.cast(kinds[c])).otherwise(F.col(c)) for c, v in new.items()}).select(docs.columns)


def marked(df: DataFrame, ids: DataFrame | list[str], name: str = "_hit") -> DataFrame:
    """``df`` with a boolean ``name``: whether the row's id is among ``ids``, a frame with a column id or a short list."""
    if isinstance(ids, list):
        return df.withColumn(name, F.coalesce(F.col("id").isin(ids), F.lit(False)))
    hits = ids.select("id").distinct().withColumn(name, F.lit(True))
    return df.join(hits, "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def rename(docs: DataFrame, id: str, title: str, at: str) -> DataFrame:
    if not title.strip():
        raise ValueError("a title can't be blank")
    return touch(docs, [id], at, {"title": F.lit(title.strip())})


def toggle_favorite(docs: DataFrame, id: str, at: str) -> DataFrame:
    return touch(docs, [id], at, {"favorite": ~F.col("favorite")})


def move_documents(docs: DataFrame, folders: DataFrame, ids: DataFrame | list[str], folder: str | None, at: str) -> DataFrame:
    if folder is not None and live(folders).where(F.col("id") == folder).isEmpty():
        raise ValueError("no such folder")
    return touch(docs, ids, at, {"folder_id": F.lit(folder).cast("string")})


def mark_opened(docs: DataFrame, id: str, at: str) -> DataFrame:
    return docs.withColumn("opened_at", F.when(F.col("id") == id, F.lit(at).cast("timestamp")).otherwise(F.col("opened_at")))


def trash_documents(docs: DataFrame, ids: DataFrame | list[str], at: str) -> DataFrame:
    """Tombstones for live documents, one time for all; neither revision nor update time changes."""
    gone = F.when(F.col("_hit"), F.coalesce("deleted_at", F.lit(at).cast("timestamp"))).otherwise(F.col("deleted_at"))
    return marked(docs, ids).withColumn("deleted_at", gone).select(docs.columns)


def restore_documents(docs: DataFrame, folders: DataFrame, ids: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """Documents (None: all) out of the trash; a folder that is gone becomes the root, one in the trash lives again."""
    have = folders.select(F.col("id").alias("_f"))
    d = docs.join(have, docs["folder_id"] == F.col("_f"), "left")
    hit = F.lit(True) if ids is None else F.col("id").isin(ids)
    d = d.withColumn("folder_id", F.when(hit & F.col("_f").isNull(), F.lit(None)).otherwise(F.col("folder_id"))).withColumn("deleted_at", F.when(hit, F.lit(None)).otherwise(F.col("deleted_at"))).drop("_f")
    again = docs.where(hit).select(F.col("folder_id").alias("_g")).distinct()
    f = folders.join(again, folders["id"] == F.col("_g"), "left").withColumn("deleted_at", F.when(F.col("_g").isNotNull(), F.lit(None)).otherwise(F.col("deleted_at"))).drop("_g")
    return d, f


def purge(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select("id"), "id", "left_anti")


def folder_summary(docs: DataFrame) -> DataFrame:
    """(folder_id, documents, bytes, favorites, newest) of live documents."""
    return live(docs).groupBy("folder_id").agg(F.count("*").alias("documents"), F.sum("size_bytes").alias("bytes"), F.sum(F.col("favorite").cast("bigint")).alias("favorites"), F.max("updated_at").alias("newest"))


def merge_documents(pages: DataFrame, ids: DataFrame | list[str]) -> DataFrame:
    """(page_id, position): the pages of the given documents, in the given order of documents, numbered from 0.

    ``ids`` is a list or a frame (id, place). A document's pages are numbered by document; its first number is the sum of
    the counts before it, so only counts by document meet in one place.
    """
    order = pages.sparkSession.createDataFrame([(i, k) for k, i in enumerate(ids)], "id string, place int") if isinstance(ids, list) else ids
    some = pages.join(order.withColumnRenamed("id", "doc_id"), "doc_id")
    counts = some.groupBy("place").agg(F.count("*").alias("n"))
    before = counts.select("place", (F.sum("n").over(W.orderBy("place")) - F.col("n")).alias("before"))
    own = F.row_number().over(W.partitionBy("place").orderBy("page_index", "page_id")) - 1
    return some.withColumn("own", own).join(before, "place").select("page_id", (F.col("before") + F.col("own")).cast("int").alias("position"))


def merged_title(titles: list[str]) -> str:
    rest = len(titles) - 1
    return f"{titles[0]} + {rest} autre{'s' if rest > 1 else ''}"
