"""Queries that call one operator after the other on whole tables, each with the SQL that must give the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from parchmint.functions import geometry as G
from parchmint.functions import pages as P
from parchmint.operators import duplicates as D
from parchmint.operators import library as L
from parchmint.operators import repository as R
from parchmint.plans.more import _pages
from parchmint.plans.registry import AS_OF, DOCS, PAGES, docs, page_rows, query, table

AT = f"TIMESTAMPTZ '{AS_OF}+00'"


# -- geometry ------------------------------------------------------------------------------------------------------------
_Q = "WITH q AS (SELECT s_suppkey AS k, (s_suppkey % 7)::DOUBLE AS x0, (s_suppkey % 5)::DOUBLE AS y0, (60 + s_suppkey % 11)::DOUBLE AS x1, (s_suppkey % 3)::DOUBLE AS y1, (60 + s_suppkey % 13)::DOUBLE AS x2, (80 + s_suppkey % 17)::DOUBLE AS y2, (s_suppkey % 9)::DOUBLE AS x3, (75 + s_suppkey % 19)::DOUBLE AS y3 FROM supplier) "


def _quads(spark, d):
    k = F.col("s_suppkey")
    points = [(k % 7, k % 5), (60 + k % 11, k % 3), (60 + k % 13, 80 + k % 17), (k % 9, 75 + k % 19)]
    return table(spark, d, "supplier").select(k.alias("k"), F.array(*[G.point(x, y) for x, y in points]).alias("q"))


def _dist(a: str, b: str) -> str:
    return f"sqrt((x{a} - x{b}) ** 2 + (y{a} - y{b}) ** 2)"


@query(_Q + f"SELECT k, round({_dist('0', '1')} + {_dist('1', '2')} + {_dist('2', '3')} + {_dist('3', '0')}, 6) AS perimeter, round((x0 + x1 + x2 + x3) / 4, 6) AS cx, round((y0 + y1 + y2 + y3) / 4, 6) AS cy, true AS convex, round(degrees(acos(((x3 - x0) * (x1 - x0) + (y3 - y0) * (y1 - y0)) / ({_dist('3', '0')} * {_dist('1', '0')}))), 4) AS angle FROM q")
def quad_shapes(spark, d):
    q = F.col("q")
    c = G.centroid(q)
    return _quads(spark, d).select("k", F.round(G.perimeter(q), 6).alias("perimeter"), F.round(c["x"], 6).alias("cx"), F.round(c["y"], 6).alias("cy"), G.is_convex(q).alias("convex"), F.round(G.quad_angles(q)[0], 4).alias("angle"))


@query(_Q + "SELECT k, concat_ws(',', x0::INT, x1::INT, x2::INT, x3::INT) AS xs, concat_ws(',', y0::INT, y1::INT, y2::INT, y3::INT) AS ys FROM q")
def ordered_quads(spark, d):
    """Corners given crosswise, put in order from the upper left one."""
    crossed = F.array(*[F.col("q")[i] for i in (2, 0, 3, 1)])
    o = _quads(spark, d).select("k", G.order_quad(crossed).alias("o"))
    text = lambda f: F.array_join(F.transform("o", lambda p: p[f].cast("int").cast("string")), ",")
    return o.select("k", text("x").alias("xs"), text("y").alias("ys"))


@query(_Q + "SELECT k, (x0 + x1 + x2 + x3) * 1.5 AS wide, (y0 + y1 + y2 + y3) * 0.5 AS high, least(64, x0) + least(64, x1) + least(64, x2) + least(64, x3) AS clamped, round(x0 + ((x0 + x1 + x2 + x3) / 4 - x0) * 0.2, 6) AS inset, round(greatest(0.1 * sqrt(x0 * x0 + y0 * y0), 0.1 * sqrt(x1 * x1 + y1 * y1), 0.1 * sqrt(x2 * x2 + y2 * y2), 0.1 * sqrt(x3 * x3 + y3 * y3)), 6) AS moved, (k + 90) * 40.0 AS frame, x0 + y0 + x1 + y1 + x2 + y2 + x3 + y3 AS flat FROM q")
def changed_quads(spark, d):
    """Quads scaled, clamped to a frame, inset, compared, whole frames, and flat lists."""
    q = F.col("q")
    total = lambda c, f: F.aggregate(c, F.lit(0.0), lambda s, p: s + p[f])
    scaled = G.scale_quad(q, F.lit(1.5), F.lit(0.5))
    frame = G.polygon_area(G.full_frame_quad(F.col("k") + 100, F.lit(50), 5))
    return _quads(spark, d).select(
        "k", total(scaled, "x").alias("wide"), total(scaled, "y").alias("high"), total(G.clamp_quad(q, F.lit(64), F.lit(1000)), "x").alias("clamped"), F.round(G.inset_quad(q, 0.1)[0]["x"], 6).alias("inset"),
        F.round(G.max_corner_distance(q, G.scale_quad(q, F.lit(1.1))), 6).alias("moved"), frame.alias("frame"), F.aggregate(G.quad_to_array(q), F.lit(0.0), lambda s, v: s + v).alias("flat"),
    )


@query(
    _Q + "SELECT k, round(x0 + t * (x2 - x0), 6) AS x, round(y0 + t * (y2 - y0), 6) AS y, x1 + (x2 - x1) * (40 - y1) / (y2 - y1) > 64 AND x3 + (x0 - x3) * (40 - y3) / (y0 - y3) < 64 AS inside, "
    "CASE k % 4 WHEN 0 THEN x1 WHEN 1 THEN 120 - y1 WHEN 2 THEN 100 - x1 ELSE y1 END AS rx, CASE k % 4 WHEN 0 THEN y1 WHEN 1 THEN x1 WHEN 2 THEN 120 - y1 ELSE 100 - x1 END AS ry "
    "FROM (SELECT *, ((x1 - x0) * (y3 - y1) - (y1 - y0) * (x3 - x1)) / ((x2 - x0) * (y3 - y1) - (y2 - y0) * (x3 - x1)) AS t FROM q)"
)
def crossed_lines(spark, d):
    """Where the diagonals meet, whether a point lies inside, and a corner after quarter turns of the page."""
    q = F.col("q")
    m = G.line_intersection(q[0], q[2], q[1], q[3])
    turned = G.rotate_point_90(q[1], F.lit(100), F.lit(120), F.col("k") % 4)
    return _quads(spark, d).select("k", F.round(m["x"], 6).alias("x"), F.round(m["y"], 6).alias("y"), G.point_in_polygon(G.point(F.lit(64), F.lit(40)), q).alias("inside"), turned["x"].alias("rx"), turned["y"].alias("ry"))


@query(_Q + "SELECT k, 2 * x1 + k AS x, 3 * y1 + 1 AS y, x1 AS back_x, y1 AS back_y FROM q")
def mapped_points(spark, d):
    """A corner through a matrix and back through its inverse."""
    h = F.array(*[F.lit(v).cast("double") if v != "k" else F.col("k").cast("double") for v in (2, 0, "k", 0, 3, 1, 0, 0, 1)])
    p = _quads(spark, d).select("k", G.apply_homography(h, F.col("q")[1]).alias("p"), G.invert3(h).alias("i"))
    back = G.apply_homography(F.col("i"), F.col("p"))
    return p.select("k", F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.round(back["x"], 6).alias("back_x"), F.round(back["y"], 6).alias("back_y"))


_RATIO = "CASE WHEN abs(r - 297 / 210) / (297 / 210) < 0.06 THEN 297 / 210 WHEN abs(r - 11 / 8.5) / (11 / 8.5) < 0.06 THEN 11 / 8.5 WHEN abs(r - 85.6 / 53.98) / (85.6 / 53.98) < 0.06 THEN 85.6 / 53.98 ELSE r END"


@query(f"SELECT k, floor(w / f + 0.5)::INTEGER AS width, floor(w + 0.5)::INTEGER AS height FROM (SELECT k, w, {_RATIO} AS f FROM (SELECT s_suppkey AS k, (300 + s_suppkey % 50)::DOUBLE AS w, (300 + s_suppkey % 50) / (160.0 + s_suppkey % 130) AS r FROM supplier))")
def output_sizes(spark, d):
    """The size of a straightened page: an upright rectangle snapped to a known format."""
    k = F.col("s_suppkey")
    w, h = (160 + k % 130).cast("double"), (300 + k % 50).cast("double")
    zero = F.lit(0.0)
    size = G.estimate_output_size(F.array(G.point(zero, zero), G.point(w, zero), G.point(w, h), G.point(zero, h)))
    return table(spark, d, "supplier").select(k.alias("k"), size.alias("s")).select("k", "s.width", "s.height")


# -- writes --------------------------------------------------------------------------------------------------------------
@query(f"SELECT id, CASE WHEN page_count >= 3 THEN NOT favorite ELSE favorite END AS favorite, revision + CASE WHEN page_count >= 3 THEN 1 ELSE 0 END AS revision, floor(epoch(CASE WHEN page_count >= 3 THEN {AT} ELSE updated_at END))::BIGINT AS updated FROM {DOCS}")
def toggled_favorites(spark, d):
    """Long documents marked or unmarked by one touching write."""
    cur = docs(spark, d)
    return R.touch(cur, cur.where("page_count >= 3").select("id"), AS_OF, {"favorite": ~F.col("favorite")}).select("id", "favorite", "revision", F.unix_timestamp("updated_at").alias("updated"))


@query(f"SELECT id, floor(epoch(coalesce(deleted_at, CASE WHEN page_count = 1 THEN {AT} END)))::BIGINT::VARCHAR AS deleted, revision FROM {DOCS}")
def trashed_documents(spark, d):
    cur = docs(spark, d)
    return R.trash_documents(cur, cur.where("page_count = 1").select("id"), AS_OF).select("id", F.unix_timestamp("deleted_at").cast("string").alias("deleted"), "revision")


@query(f"SELECT id, CASE WHEN favorite THEN (SELECT min(id) FROM folders WHERE deleted_at IS NULL) ELSE folder_id END AS folder_id FROM {DOCS}")
def moved_documents(spark, d):
    """All favourites moved into the first folder."""
    cur, folders = docs(spark, d), table(spark, d, "folders")
    first = folders.where("deleted_at is null").agg(F.min("id")).first()[0]
    return R.move_documents(cur, folders, cur.where("favorite").select("id"), first, AS_OF).select("id", "folder_id")


@query("SELECT id, name, parent_id FROM folders UNION ALL SELECT 'new', 'Dossier ajouté', (SELECT min(id) FROM folders)")
def created_folders(spark, d):
    folders = table(spark, d, "folders")
    parent = folders.agg(F.min("id")).first()[0]
    return L.create_folder(folders, "new", " Dossier ajouté ", parent, AS_OF).select("id", "name", "parent_id")


@query(f"SELECT id, CASE WHEN id = (SELECT min(id) FROM folders) THEN 'Autre nom' ELSE name END AS name, floor(epoch(CASE WHEN id = (SELECT min(id) FROM folders) THEN {AT} ELSE updated_at END))::BIGINT AS updated FROM folders")
def renamed_folders(spark, d):
    folders = table(spark, d, "folders")
    return L.rename_folder(folders, folders.agg(F.min("id")).first()[0], "Autre nom", AS_OF).select("id", "name", F.unix_timestamp("updated_at").alias("updated"))


@query("SELECT id, CASE WHEN id = (SELECT min(id) FROM folders) THEN NULL ELSE parent_id END AS parent_id FROM folders")
def moved_folders(spark, d):
    """The first folder moved to the root."""
    folders = table(spark, d, "folders")
    return L.move_folder(folders, folders.agg(F.min("id")).first()[0], None, AS_OF).select("id", "parent_id")


@query("SELECT id, CASE WHEN parent_id IS NULL THEN 'teal' ELSE color END AS color FROM folders")
def recolored_folders(spark, d):
    folders = table(spark, d, "folders")
    return L.recolor_folders(folders, folders.where("parent_id is null").select("id"), "teal", AS_OF).select("id", "color")


@query(f"SELECT id, 'document' AS what FROM {DOCS} WHERE deleted_at IS NULL UNION ALL SELECT id, 'folder' FROM folders WHERE deleted_at IS NULL UNION ALL SELECT id, 'gone' FROM {DOCS} WHERE deleted_at IS NOT NULL UNION ALL SELECT id, 'gone' FROM folders WHERE deleted_at IS NOT NULL")
def emptied_trash(spark, d):
    left, folders, gone = L.empty_trash(docs(spark, d), table(spark, d, "folders"))
    return left.select("id", F.lit("document").alias("what")).union(folders.select("id", F.lit("folder"))).union(gone.select("id", F.lit("gone")))


@query("SELECT history_action, count(*)::BIGINT AS entries FROM (SELECT DISTINCT ON (id) id, history_action FROM history_entries) GROUP BY history_action")
def logged_history(spark, d):
    """Entries written as they arrive: what was sent twice is written once."""
    new = table(spark, d, "history_entries")
    return L.logged(L.cleared(new), new).groupBy("history_action").agg(F.count("*").alias("entries"))


@query(f"SELECT page_id AS blob_id, CASE WHEN page_index = 0 THEN 'cover' ELSE text END AS content FROM {PAGES} WHERE page_index < 2")
def stored_blobs(spark, d):
    """Page texts as blobs: first pages replaced, pages after the second removed."""
    p = page_rows(spark, d)
    blobs = p.select(F.col("page_id").alias("blob_id"), F.encode("text", "UTF-8").alias("content"))
    covers = p.where("page_index = 0").select(F.col("page_id").alias("blob_id"), F.encode(F.lit("cover"), "UTF-8").alias("content"))
    left = L.delete_blobs(L.put_blobs(blobs, covers), p.where("page_index >= 2 or page_index is null").select(F.col("page_id").alias("blob_id")))
    return L.get_blobs(left, left.select("blob_id")).select("blob_id", F.decode("content", "UTF-8").alias("content"))


@query(f"SELECT id, title || ' (partie ' || (k + 1) || ')' AS title, k * 2 + 1 AS first, least(2, page_count - k * 2)::INTEGER AS pages FROM (SELECT id, title, page_count, unnest(range(0, ((page_count + 1) // 2)::INTEGER))::INTEGER AS k FROM {DOCS} WHERE page_count > 2)")
def split_titles(spark, d):
    """The documents that come of splitting every document after every second page: title, first page and number of pages."""
    t = _pages(docs(spark, d)).join(docs(spark, d).select("id", "title"), "id")
    parts = t.select("id", F.explode(L.split_titles(F.col("title"), P.split_every(F.col("pages"), 2))).alias("p"))
    return parts.select("id", "p.title", "p.first", "p.pages")


@query(f"SELECT id, CASE WHEN page_count > 3 THEN 'p0,p1,p2;' || array_to_string(list_transform(range(3, page_count::INTEGER), lambda i: 'p' || i), ',') WHEN page_count > 1 THEN 'p0;' || array_to_string(list_transform(range(1, page_count::INTEGER), lambda i: 'p' || i), ',') END AS parts FROM {DOCS}")
def split_places(spark, d):
    """Documents cut before the fourth page, shorter ones before the second."""
    text = lambda parts: F.array_join(F.transform(parts, lambda part: F.array_join(F.transform(part, lambda p: p["id"]), ",")), ";")
    t = _pages(docs(spark, d))
    return t.select("id", F.when(F.size("pages") > 3, text(P.split_at(F.col("pages"), [3]))).otherwise(text(P.split_at(F.col("pages"), [1]))).alias("parts"))


@query(f"SELECT id, title || CASE WHEN page_count = 1 THEN ' (p. 1-2)' ELSE ' (p. 1-2)' END AS title, CASE WHEN page_count = 1 THEN 'p0' ELSE 'p0,p1' END AS pages FROM {DOCS} WHERE page_count >= 1")
def extracted_pages(spark, d):
    """The first two pages of every document as a document of its own."""
    t = _pages(docs(spark, d)).join(docs(spark, d).select("id", "title"), "id")
    e = L.extracted(F.col("title"), F.col("pages"), F.array(F.lit(0), F.lit(1)))
    return t.select("id", e.alias("e")).where("e is not null").select("id", "e.title", F.array_join(F.transform("e.pages", lambda p: p["id"]), ",").alias("pages"))


@query(f"SELECT id, CASE WHEN favorite THEN NULL ELSE locked END AS relock_pending, revision + CASE WHEN favorite THEN 1 ELSE 0 END AS revision FROM {DOCS}")
def kept_unlocked(spark, d):
    """Locked documents opened for a time; the favourites among them stay open."""
    cur = docs(spark, d).withColumn("relock_pending", F.col("locked"))
    return L.keep_unlocked(cur, cur.where("favorite").select("id"), AS_OF).select("id", "relock_pending", "revision")


@query(f"SELECT id, array_to_string(list_filter(list_distinct(list_transform(coalesce(tags, []), lambda t: lower(trim(t)))), lambda t: t <> ''), '|') <> '' AS tagged, list_sort(list_filter(list_distinct(list_transform(coalesce(tags, []), lambda t: lower(trim(t)))), lambda t: t <> ''))::VARCHAR AS tags FROM {DOCS}")
def written_tags(spark, d):
    """Tags as they are kept: each of them, in order of spelling."""
    t = docs(spark, d).select("id", R.normalized_tags(F.coalesce("tags", F.array().cast("array<string>"))).alias("t"))
    return t.select("id", (F.size("t") > 0).alias("tagged"), F.concat(F.lit("["), F.array_join(F.array_sort("t"), ", "), F.lit("]")).alias("tags"))


@query()
def duplicate_groups(spark, d):
    """Pages by the first page that they look like, alone or in groups; the test hashes stand for their pictures."""
    h = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("page_id"), F.col("vec_id").alias("place"), D.difference_hash(F.col("embedding")).alias("h"), F.lit(False).alias("blank"), F.lit("").alias("text"))
    return D.anchor_groups(h, "place", 12).groupBy("anchor").agg(F.count("*").alias("pages"))
