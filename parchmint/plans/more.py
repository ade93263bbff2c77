"""Further queries: page arithmetic, geometry, codecs, images. Imported for its entries in the registry."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from parchmint.functions import analytics as A
from parchmint.functions import geometry as G
from parchmint.functions import pages as P
from parchmint.operators import duplicates as D
from parchmint.operators import levels as V
from parchmint.operators import repository as R
from parchmint.plans.registry import AS_OF, DOCS, PAGES, SEARCH, docs, page_rows, query, search_rows, table
from parchmint.session import spread

_LIST = "range(0, greatest(coalesce(page_count, 0), 0))"


def _pages(df):
    """Pages of a document as structs with ids p0, p1, ... and a size that depends on the place."""
    n = F.coalesce("page_count", F.lit(0)).cast("int")
    page = lambda i: F.struct(F.concat(F.lit("p"), i.cast("string")).alias("id"), F.lit(0).alias("rotation"), (i + 10).cast("int").alias("width"), (i * 2 + 20).cast("int").alias("height"), F.lit("document").alias("filter"))
    return df.select("id", n.alias("n"), F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), page)).otherwise(F.array()).alias("pages"))


def _ids(c):
    return F.array_join(F.transform(c, lambda p: p["id"]), ",")


@query(f"SELECT id, array_to_string(list_transform({_LIST}, lambda i: 'p' || (CASE WHEN page_count < 2 THEN i WHEN i = least(2, page_count - 1) THEN 0 WHEN i < least(2, page_count - 1) THEN i + 1 ELSE i END)), ',') AS moved FROM {DOCS}")
def moved_pages(spark, d):
    """The first page moved to the third place, or to the end of a shorter list."""
    return _pages(docs(spark, d)).select("id", _ids(P.move_page(F.col("pages"), F.lit(0), F.lit(2))).alias("moved"))


@query(f"SELECT id, array_to_string(list_filter(list_transform({_LIST}, lambda i: 'p' || i), lambda x: x <> 'p1'), ',') AS kept FROM {DOCS}")
def removed_pages(spark, d):
    return _pages(docs(spark, d)).select("id", _ids(P.remove_pages(F.col("pages"), ["p1"])).alias("kept"))


@query(f"SELECT id, array_to_string(list_transform({_LIST}, lambda i: 'p' || i || CASE WHEN i = 0 THEN ',copy' ELSE '' END), ',') AS pages FROM {DOCS}")
def duplicated_pages(spark, d):
    return _pages(docs(spark, d)).select("id", _ids(P.duplicate_page(F.col("pages"), "p0", F.lit("copy"))).alias("pages"))


@query(f"SELECT id, coalesce(list_sum(list_transform({_LIST}, lambda i: CASE WHEN i % 2 = 0 THEN i + 10 ELSE i * 2 + 20 END)), 0)::BIGINT AS widths FROM {DOCS}")
def rotated_pages(spark, d):
    """Odd pages turned by a quarter: their widths are then their heights."""
    turned = F.transform(F.col("pages"), lambda p, i: P.rotate_page(p, i % 2))
    return _pages(docs(spark, d)).select("id", F.aggregate(turned, F.lit(0).cast("bigint"), lambda s, p: s + p["width"]).alias("widths"))


@query(f"SELECT id, CASE WHEN page_count >= 3 THEN '0,2' WHEN page_count >= 1 THEN NULL END AS places FROM {DOCS} WHERE page_count >= 1")
def page_range_places(spark, d):
    """The places that "1, 3-3" means, or null where the document is too short."""
    df = docs(spark, d).where("page_count >= 1")
    return df.select("id", F.array_join(P.page_ranges(F.lit("1, 3-3"), F.col("page_count").cast("int")), ",").alias("places"))


@query(f"SELECT id, CASE WHEN ceil(coalesce(page_count, 0) / 2) >= 2 THEN ceil(page_count / 2)::INTEGER ELSE 1 END AS parts FROM {DOCS}")
def split_documents(spark, d):
    """Number of parts when a document is split every two pages; 1 for fewer than two."""
    return _pages(docs(spark, d)).select("id", F.coalesce(F.size(P.split_every(F.col("pages"), 2)), F.lit(1)).alias("parts"))


@query(f"SELECT id, floor(1200 + coalesce(list_sum(list_transform({_LIST}, lambda i: (i + 10) * (i * 2 + 20) * (0.25 + 0.75 * 0.75 * 1.9) * (CASE WHEN i % 2 = 0 THEN 0.6 ELSE 1 END) / 8 + 900)), 0) + 0.5)::BIGINT AS bytes FROM {DOCS}")
def estimated_pdf_sizes(spark, d):
    """Expected size of an export at the standard quality; every other page is gray."""
    pages = F.transform(F.col("pages"), lambda p, i: p.withField("grayscale", i % 2 == 0))
    return _pages(docs(spark, d)).select("id", G.estimate_pdf_size(pages).alias("bytes"))


@query(f"SELECT page_id, CASE WHEN height > width THEN 595.28 ELSE 841.89 END AS page_w, round(width * least((CASE WHEN height >= width THEN 595.28 ELSE 841.89 END - 40) / width, (CASE WHEN height >= width THEN 841.89 ELSE 595.28 END - 40) / height), 4) AS w FROM (SELECT DISTINCT page_id, width, height FROM ocr_results)")
def page_layouts(spark, d):
    """Pictures placed on A4 inside margins."""
    p = table(spark, d, "ocr_results").select("page_id", "width", "height").distinct()
    box = G.layout_page(F.col("width").cast("double"), F.col("height").cast("double"), margin=20.0)
    return p.select("page_id", box.alias("b")).select("page_id", "b.page_w", F.round("b.w", 4).alias("w"))


@query(f"SELECT id, sha256(coalesce(title, '')) AS sha, base64(encode(coalesce(title, ''))) AS b64, lower(hex(encode(coalesce(title, '')))) AS hex FROM {DOCS}")
def codecs(spark, d):
    t = F.coalesce("title", F.lit(""))
    return docs(spark, d).select("id", F.sha2(t, 256).alias("sha"), F.regexp_replace(F.base64(F.encode(t, "UTF-8")), r"\s", "").alias("b64"), F.lower(F.hex(F.encode(t, "UTF-8"))).alias("hex"))


@query("SELECT id, replace(replace(replace(replace(coalesce(content, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS xml FROM " + SEARCH)
def escaped_contents(spark, d):
    from parchmint.sinks.packages import esc_column

    return search_rows(spark, d).select("id", esc_column(F.coalesce("content", F.lit(""))).alias("xml"))


@query(f"SELECT id, lower(regexp_extract(id || '.' || coalesce(source, 'bin'), '\\.([^.]*)$', 1)) AS ext, id AS base FROM {DOCS}")
def file_parts(spark, d):
    name = F.concat("id", F.lit("."), F.coalesce("source", F.lit("bin")))
    return docs(spark, d).select("id", A.extension(name).alias("ext"), A.base_name(name).alias("base"))


@query(f"SELECT id, array_to_string(list_distinct(list_transform(tags, lambda t: lower(trim(t)))), ',') <> '' AS tagged, len(list_distinct(list_transform(tags, lambda t: lower(trim(t)))))::INTEGER AS tags FROM {DOCS} WHERE tags IS NOT NULL")
def normalized_tags(spark, d):
    t = docs(spark, d).where("tags is not null").select("id", R.normalized_tags(F.col("tags")).alias("t"))
    return t.select("id", (F.array_join("t", ",") != "").alias("tagged"), F.size("t").alias("tags"))


@query(f"SELECT d.id, CASE WHEN f.id IS NULL THEN NULL ELSE d.folder_id END AS folder_id FROM {DOCS} d LEFT JOIN folders f ON f.id = d.folder_id WHERE d.deleted_at IS NOT NULL")
def restored_documents(spark, d):
    """All of the trash restored: documents whose folder is gone come back to the root."""
    cur, folders = docs(spark, d), table(spark, d, "folders")
    gone = cur.where("deleted_at is not null")
    back, _ = R.restore_documents(gone, folders, None)
    return back.select("id", "folder_id")


@query(f"SELECT page_id, coalesce(text, '') AS text, confidence >= 62 AS readable FROM {PAGES}")
def effective_texts(spark, d):
    return page_rows(spark, d).select("page_id", P.page_text(F.col("text"), F.lit(None)).alias("text"), (F.col("confidence") >= 62).alias("readable"))


@query(f"SELECT count(*)::BIGINT AS expired FROM {DOCS} WHERE deleted_at < TIMESTAMPTZ '{AS_OF}+00' - INTERVAL 30 DAYS")
def expired_documents(spark, d):
    return R.expired(docs(spark, d), AS_OF).agg(F.count("*").alias("expired"))


_Q = [("l_quantity + 1", "l_discount * 100"), ("l_quantity + 40", "l_tax * 100"), ("l_quantity + 44", "l_tax * 100 + 60"), ("l_quantity - 3", "l_discount * 100 + 55")]


def _quad():
    q, t, c = F.col("l_quantity"), F.col("l_tax") * 100, F.col("l_discount") * 100
    return F.array(G.point(q + 1, c), G.point(q + 40, t), G.point(q + 44, t + 60), G.point(q - 3, c + 55))


def _dist(a, b):
    return f"sqrt((({a[0]}) - ({b[0]}))^2 + (({a[1]}) - ({b[1]}))^2)"


def _cross(o, a, b):
    return f"((({a[0]}) - ({o[0]})) * (({b[1]}) - ({o[1]})) - (({a[1]}) - ({o[1]})) * (({b[0]}) - ({o[0]})))"


@query(f"SELECT l_orderkey, l_linenumber, round({' + '.join(_dist(_Q[i], _Q[(i + 1) % 4]) for i in range(4))}, 6) AS perimeter, {' AND '.join(_cross(_Q[i], _Q[(i + 1) % 4], _Q[(i + 2) % 4]) + ' > 0' for i in range(4))} AS convex FROM lineitem")
def quad_measures(spark, d):
    """Perimeter and convexity of quads made of columns."""
    return spread(table(spark, d, "lineitem")).select("l_orderkey", "l_linenumber", F.round(G.perimeter(_quad()), 6).alias("perimeter"), G.is_convex(_quad()).alias("convex"))


@query("SELECT p_partkey, (77 * r + 150 * g + 29 * b) // 256 AS gray, CASE WHEN (77 * r + 150 * g + 29 * b) // 256 > 120 THEN 255 ELSE 0 END AS bit FROM (SELECT p_partkey, p_size * 5 AS r, (p_partkey * 7) % 256 AS g, (p_partkey * 13) % 256 AS b FROM part)")
def gray_levels(spark, d):
    """Colours of columns as gray levels and black or white."""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 5).alias("r"), (F.col("p_partkey") * 7 % 256).alias("g"), (F.col("p_partkey") * 13 % 256).alias("b"))
    gray = F.shiftright((77 * F.col("r") + 150 * F.col("g") + 29 * F.col("b")).cast("bigint"), 8)
    return p.select("p_partkey", gray.alias("gray"), F.when(gray > 120, 255).otherwise(0).alias("bit"))


@query("WITH v AS (SELECT abs(value) AS v FROM events WHERE abs(value) > 0), b AS (SELECT least(1023, floor(v / 1448 * 1024)) AS b, count(*) AS n FROM v GROUP BY 1), c AS (SELECT b, sum(n) OVER (ORDER BY b) AS c, sum(n) OVER () AS t FROM b) SELECT (min(b) + 0.5) / 1024 * 1448 AS value FROM c WHERE c >= t * 0.85")
def magnitude_quantile(spark, d):
    return V.quantile_of_magnitudes(table(spark, d, "events"), F.abs("value"), 0.85)


@query("SELECT vec_id, bit_count(h)::INTEGER AS bits FROM (SELECT vec_id, list_sum(list_transform(range(1, 64), lambda i: CASE WHEN embedding[i] > embedding[i + 1] THEN (1::BIGINT << (i - 1)::INTEGER) ELSE 0 END))::BIGINT AS h FROM embeddings)")
def hash_weights(spark, d):
    """Number of set bits of every image hash."""
    return table(spark, d, "embeddings").select("vec_id", F.bit_count(D.difference_hash(F.col("embedding"))).alias("bits"))


@query()
def detected_outlines(spark, d):
    """A drawn page on a desk for every supplier, its outline found and compared: one Arrow map over all rows."""
    from parchmint.vision.detect import assess_quality, detect_document, quad_masks
    from parchmint.vision.kernels import clamp, gaussian_blur

    def run(batches):
        for pdf in batches:
            rows = []
            for key in pdf["s_suppkey"]:
                rng = np.random.default_rng(int(key))
                c, a = np.array([180.0, 135.0]) + rng.uniform(-15, 15, 2), rng.uniform(-0.3, 0.3)
                r = np.array([rng.uniform(90, 120), rng.uniform(60, 85)])
                turn = np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]])
                q = np.array([[-1, -1], [1, -1], [1, 1], [-1, 1]]) * r @ turn + c + rng.uniform(-8, 8, (4, 2))
                img = rng.uniform(30, 90) + rng.normal(0, 4, (270, 360))
                img[quad_masks(q, 360, 270, 1)[0]] = rng.uniform(180, 235)
                frame = gaussian_blur(clamp(img), 0.7)
                found, score, partial = detect_document(frame)
                error = None if found is None else float(min(np.abs(np.roll(found, k, axis=0) - q).max() for k in range(4)))
                rows.append((key, score, partial, error, assess_quality(frame, found)["blurry"]))
            yield pd.DataFrame(rows, columns=["s_suppkey", "score", "partial", "error_px", "blurry"])

    s = table(spark, d, "supplier").select("s_suppkey").repartition(spark.sparkContext.defaultParallelism)
    return s.mapInPandas(run, "s_suppkey bigint, score double, partial boolean, error_px double, blurry boolean")


@query()
def exported_documents(spark, d):
    """Every search record as a word-processor file: size and checksum of the bytes."""
    from parchmint.sinks.packages import documents_as

    r = search_rows(spark, d).select("id", "title", F.array(F.coalesce("content", F.lit(""))).alias("pages"))
    return documents_as(r, "docx").select("id", "file", F.octet_length("data").alias("bytes"), F.crc32("data").alias("crc"))


@query()
def laid_out_pages(spark, d):
    """Pages and words that every document's text takes on A4."""
    from parchmint.functions.layout import layout_pages

    def run(batches):
        for pdf in batches:
            pages = [layout_pages(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "pages": [len(p) for p in pages], "words": [sum(len(q["words"]) for q in p) for p in pages]})

    return table(spark, d, "documents").where("text is not null").select("doc_id", "text").mapInPandas(run, "doc_id bigint, pages int, words int")


@query(f"SELECT id, true AS opened, true AS bound FROM {DOCS} WHERE title IS NOT NULL")
def sealed_titles(spark, d):
    """Titles sealed and opened again: all must come back, none under another id."""
    from parchmint.functions.vault import derive_key, seal, unseal

    key = derive_key("mot de passe", b"0123456789abcdef", 1000)
    t = docs(spark, d).where("title is not null").select("id", "title", seal(F.col("title"), key, F.col("id")).alias("s"))
    return t.select("id", (unseal(F.col("s"), key, F.col("id")).cast("string") == F.col("title")).alias("opened"), unseal(F.col("s"), key, F.concat("id", F.lit("x"))).isNull().alias("bound"))
