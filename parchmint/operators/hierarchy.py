"""Folder trees: closure, paths, cascades. A tree is (id, parent_id) of any depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.session import cut_lineage

def closure(tree: DataFrame, id: str = "id", parent: str = "parent_id") -> DataFrame:
    """(ancestor, id, depth) for every folder and each of its ancestors, itself at depth 0.

    By doubling: each round joins the known ancestors with themselves, so a tree of depth d takes log2(d) joins. Parents
    that don't exist and cycles end the walk. A folder that is its own ancestor keeps its shortest distance.
    """
    edges = tree.where(F.col(id).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.max(parent).alias("parent"))
    ids = edges.select("id")
    known = ids.select(F.col("id").alias("ancestor"), "id", F.lit(0).alias("depth")).union(edges.join(ids.select(F.col("id").alias("parent")), "parent").where("parent <> id").select(F.col("parent").alias("ancestor"), "id", F.lit(1).alias("depth")))
    known = cut_lineage(known)
    size = known.count()
    while True:
        up = known.where("depth > 0")
        a = up.select("ancestor", F.col("id").alias("mid"), F.col("depth").alias("d1"))
        b = up.select(F.col("ancestor").alias("mid"), "id", F.col("depth").alias("d2"))
        more = a.join(b, "mid").select("ancestor", "id", (F.col("d1") + F.col("d2")).alias("depth"))
        known = cut_lineage(known.union(more).groupBy("ancestor", "id").agg(F.min("depth").alias("depth")))
        before, size = size, known.count()
        if size == before:
            return known


def folder_paths(folders: DataFrame, tree: DataFrame | None = None, separator: str = " / ") -> DataFrame:
    """(id, path): the names from the root down to each folder."""
    c = closure(folders) if tree is None else tree
    named = c.join(folders.select(F.col("id").alias("ancestor"), "name"), "ancestor")
    steps = F.sort_array(F.collect_list(F.struct("depth", "name")), asc=False)
    return named.groupBy("id").agg(F.array_join(F.transform(steps, lambda s: s["name"]), separator).alias("path"))


def descendants(folders: DataFrame, root: str) -> DataFrame:
    """(id): strict descendants of a folder."""
    return closure(folders).where((F.col("ancestor") == root) & (F.col("depth") > 0)).select("id")


def may_move(folders: DataFrame, folder: str, target: str | None) -> bool:
    """Whether a folder may go under ``target``: not under itself or a descendant. The root (None) is always allowed."""
    return target is None or closure(folders).where((F.col("ancestor") == folder) & (F.col("id") == target)).isEmpty()


def name_is_free(folders: DataFrame, name: str, parent: str | None) -> bool:
    """Whether no live folder under ``parent`` has that name, accents and case aside."""
    here = folders.where(F.col("deleted_at").isNull() & F.col("parent_id").eqNullSafe(F.lit(parent)))
    return here.where(F.collate(F.trim("name"), "fr_CI_AI") == F.collate(F.lit(name.strip()), "fr_CI_AI")).isEmpty()


def trash_folder(folders: DataFrame, docs: DataFrame, root: str, at: str) -> tuple[DataFrame, DataFrame]:
    """Folders and documents with a folder, its descendants and their live documents in the trash, all at one time ``at``."""
    below = closure(folders).where(F.col("ancestor") == root).select(F.col("id").alias("_in"))
    when = F.lit(at).cast("timestamp")
    f = folders.join(below, folders["id"] == F.col("_in"), "left")
    f = f.withColumn("deleted_at", F.when(F.col("_in").isNotNull(), F.coalesce("deleted_at", when)).otherwise(F.col("deleted_at"))).drop("_in")
    d = docs.join(below, docs["folder_id"] == F.col("_in"), "left")
    d = d.withColumn("deleted_at", F.when(F.col("_in").isNotNull(), F.coalesce("deleted_at", when)).otherwise(F.col("deleted_at"))).drop("_in")
    return f, d


def restore_folder(folders: DataFrame, docs: DataFrame, root: str, with_documents: bool = True) -> tuple[DataFrame, DataFrame]:
    """The inverse: descendants and trashed ancestors live again, documents only if they went with the folder."""
    c = closure(folders)
    down = c.where(F.col("ancestor") == root).select(F.col("id").alias("_in"))
    up = c.where(F.col("id") == root).select(F.col("ancestor").alias("_in"))
    alive = down.union(up).distinct()
    f = folders.join(alive, folders["id"] == F.col("_in"), "left")
    f = f.withColumn("deleted_at", F.when(F.col("_in").isNull(), F.col("deleted_at"))).drop("_in")
    if not with_documents:
        return f, docs
    when = folders.where(F.col("id") == root).select(F.col("deleted_at").alias("_when"))
    mark = down.crossJoin(F.broadcast(when))  # one row: the time at which the folder went
    d = docs.join(mark, docs["folder_id"] == F.col("_in"), "left")
    return f, d.withColumn("deleted_at", F.when(F.col("_in").isNotNull() & F.col("deleted_at").eqNullSafe(F.col("_when")), F.lit(None)).otherwise(F.col("deleted_at"))).drop("_in", "_when")
