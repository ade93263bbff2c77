"""Records with pages as nested arrays: creating, copying, editing, locking documents; scanning sessions; three-way page merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmint.functions.vault import seal_json, unseal_json

# Modes of a scanning session with filter (None: the user's own), crop, and snap to known formats.
MODES = {"document": (None, True, True), "multipage": (None, True, True), "card": ("enhanced", True, True), "book": (None, True, False), "whiteboard": ("enhanced", True, False), "photo": ("original", False, False), "receipt": ("document", True, False)}


def mode_defaults(mode: Column, own: str = "document") -> Column:
    """Struct of filter, crop, snap; an unknown mode counts as a document. ``own`` is the user's preferred filter."""

    def pick(i: int) -> Column:
        table = F.create_map(*[F.lit(x) for k, v in MODES.items() for x in (k, own if v[i] is None else v[i])])
        return F.coalesce(table[mode], F.lit(own if i == 0 else MODES["document"][i]))

    return F.struct(pick(0).alias("filter"), pick(1).alias("crop"), pick(2).alias("snap"))


def scan_title(at: Column) -> Column:
    return F.concat(F.lit("Scan du "), F.date_format(at, "dd/MM/yyyy HH:mm"))


def created(rows: DataFrame, at: str) -> DataFrame:
    """New records: a blank title becomes ``Sans titre``, revision 1, both times ``at``."""
    t = F.trim(F.coalesce("title", F.lit("")))
    when = F.lit(at).cast("timestamp")
    return rows.withColumn("title", F.when(t == "", "Sans titre").otherwise(t)).withColumn("revision", F.lit(1)).withColumn("created_at", when).withColumn("updated_at", when)


def duplicated(docs: DataFrame, id: str, new_id: str, at: str) -> DataFrame:
    """A copy of an unlocked document under another id; its page ids get that id in front, so no page or blob is shared."""
    one = docs.where((F.col("id") == id) & ~F.coalesce(F.col("locked"), F.lit(False)))
    pages = F.transform("pages", lambda p: p.withField("id", F.concat(F.lit(new_id + "-"), p["id"])))
    return created(one.withColumn("id", F.lit(new_id)).withColumn("title", F.concat("title", F.lit(" (copie)"))).withColumn("pages", pages), at)


def edited_text(docs: DataFrame, id: str, page: str, text: str) -> DataFrame:
    """One page's text replaced, with the mark that a person did it."""
    pages = F.transform("pages", lambda p: F.when(p["id"] == page, p.withField("text", F.lit(text)).withField("edited", F.lit(True))).otherwise(p))
    return docs.withColumn("pages", F.when(F.col("id") == id, pages).otherwise(F.col("pages")))


def lock(docs: DataFrame, ids: list[str], key: bytes, private: list[str]) -> DataFrame:
    """The private columns sealed into ``sealed`` and emptied for the given documents; locked ones stay as they are."""
    hit = F.col("id").isin(ids) & F.col("sealed").isNull()
    out = docs.withColumn("_new", F.when(hit, seal_json(F.struct(*private), key, F.col("id"))))
    for c in private:
        out = out.withColumn(c, F.when(hit, F.lit(None)).otherwise(F.col(c)))
    return out.withColumn("sealed", F.coalesce("_new", "sealed")).drop("_new")


def unlock(docs: DataFrame, ids: list[str], key: bytes, private: list[str]) -> DataFrame:
    """The inverse; with a wrong key nothing changes."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    open_ = unseal_json(F.col("sealed"), key, F.col("id"), "struct<" + ",".join(f"{c}:{kinds[c]}" for c in private) + ">")
    out = docs.withColumn("_open", F.when(F.col("id").isin(ids), open_))
    for c in private:
        out = out.withColumn(c, F.when(F.col("_open").isNotNull(), F.col(f"_open.{c}")).otherwise(F.col(c)))
    return out.withColumn("sealed", F.when(F.col("_open").isNotNull(), F.lit(None)).otherwise(F.col("sealed"))).drop("_open")


def committed(snapshot: DataFrame, latest: DataFrame, edited: DataFrame) -> DataFrame:
    """Three-way merge of pages (doc_id, page_id, place, body): what the editor left alone takes its latest version.

    The edited list decides which pages there are and where; one shuffle by page.
    """
    k = ["doc_id", "page_id"]
    e = edited.select(*k, "place", F.col("body").alias("mine"))
    joined = e.join(snapshot.select(*k, F.col("body").alias("base")), k, "left").join(latest.select(*k, F.col("body").alias("theirs")), k, "left")
    body = F.when(F.col("mine").eqNullSafe(F.col("base")) & F.col("theirs").isNotNull(), F.col("theirs")).otherwise(F.col("mine"))
    return joined.select(*k, "place", body.alias("body"))


def restored_sessions(captures: DataFrame, blobs: DataFrame) -> DataFrame:
    """Captures whose blob is still there; a session without any is gone."""
    return captures.join(blobs.select("blob_id").distinct(), "blob_id", "left_semi")


def session_after(captures: Column, capture: Column, replaces: Column) -> Column:
    """A session's captures with one more; a session that replaces a page keeps only the new one."""
    return F.when(replaces, F.array(capture)).otherwise(F.concat(captures, F.array(capture)))


def settings_with_defaults(stored: Column, defaults: dict) -> Column:
    """Struct of typed preferences out of JSON text; missing and wrongly typed values take their defaults."""

    def one(name: str, value) -> Column:
        raw = F.get_json_object(stored, f"$.{name}")
        if isinstance(value, bool):
            got = F.when(raw.isin("true", "false"), raw == "true")
        elif isinstance(value, (int, float)):
            got = raw.try_cast("double")
        else:
            got = raw
        return F.coalesce(got, F.lit(float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else value)).alias(name)

    return F.struct(*[one(k, v) for k, v in defaults.items()])


def newest_signatures(signatures: Column, added: Column, most: int = 12) -> Column:
    return F.slice(F.concat(F.array(added), signatures), 1, most)


def rotated_annotations(annotations: Column, turns: Column) -> Column:
    """Annotations with points in shares of the page (x, y from 0 to 1) after quarter turns of it."""
    t = F.pmod(turns, F.lit(4))

    def turn(p: Column) -> Column:
        x = F.when(t == 1, 1 - p["y"]).when(t == 2, 1 - p["x"]).when(t == 3, p["y"]).otherwise(p["x"])
        y = F.when(t == 1, p["x"]).when(t == 2, 1 - p["y"]).when(t == 3, 1 - p["x"]).otherwise(p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(annotations, lambda a: a.withField("points", F.transform(a["points"], turn)))


def bounding_box(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def lines_of_items(items: Column) -> Column:
    """Text of positioned items (text, x, y, height) in reading order: a new line where y moves by more than half the height."""

    def add(acc: Column, it: Column) -> Column:
        new = F.abs(it["y"] - acc["y"]) > 0.5 * it["height"]
        glue = F.when(acc["t"] == "", "").when(new, "\n").otherwise(" ")
        return F.struct(F.concat(acc["t"], glue, it["text"]).alias("t"), it["y"].cast("double").alias("y"))

    return F.aggregate(items, F.struct(F.lit("").alias("t"), F.lit(0.0).alias("y")), add)["t"]
