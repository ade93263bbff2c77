"""Records with pages, locks, sessions and merges."""

from pyspark.sql import functions as F

from parchmint.functions.vault import derive_key
from parchmint.operators import sessions as S


def test_documents(spark):
    df = spark.createDataFrame([("a", " ", False, [("p1", "x", False)], None, "n"), ("b", "B", True, [("q1", "y", False)], None, "m")], "id string, title string, locked boolean, pages array<struct<id:string,text:string,edited:boolean>>, sealed string, notes string")
    assert [r.title for r in S.created(df, "2024-01-01").orderBy("id").collect()] == ["Sans titre", "B"]
    assert S.duplicated(df, "b", "c", "2024-01-01").count() == 0 and S.duplicated(df, "a", "c", "2024-01-01").first().pages[0].id == "c-p1"
    r = S.edited_text(df, "a", "p1", "neu").where("id = 'a'").first().pages[0]
    assert (r.text, r.edited) == ("neu", True)
    key, bad = derive_key("secret", b"x" * 16, 10), derive_key("autre", b"x" * 16, 10)
    locked = S.lock(df, ["a"], key, ["pages", "notes"])
    r = locked.where("id = 'a'").first()
    assert r.pages is None and r.notes is None and r.sealed
    assert S.unlock(locked, ["a"], bad, ["pages", "notes"]).where("id = 'a'").first().notes is None
    r = S.unlock(locked, ["a"], key, ["pages", "notes"]).where("id = 'a'").first()
    assert r.notes == "n" and r.pages[0].text == "x" and r.sealed is None


def test_merges_and_small_functions(spark):
    base = spark.createDataFrame([("d", "p", 0, "1"), ("d", "q", 1, "1")], "doc_id string, page_id string, place int, body string")
    latest = spark.createDataFrame([("d", "p", 0, "2"), ("d", "q", 1, "2")], base.schema)
    edited = spark.createDataFrame([("d", "q", 0, "mine"), ("d", "p", 1, "1"), ("d", "r", 2, "new")], base.schema)
    assert {(r.page_id, r.place, r.body) for r in S.committed(base, latest, edited).collect()} == {("q", 0, "mine"), ("p", 1, "2"), ("r", 2, "new")}
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    m = one(S.mode_defaults(F.lit("receipt")))
    assert (m["filter"], m.crop, m.snap) == ("document", True, False) and one(S.mode_defaults(F.lit("?")))["filter"] == "document"
    assert one(S.scan_title(F.lit("2024-03-05 14:07:00").cast("timestamp"))) == "Scan du 05/03/2024 14:07"
    s = one(S.settings_with_defaults(F.lit('{"a": true, "n": "x", "t": "hi"}'), {"a": False, "n": 3, "t": "", "z": True}))
    assert (s.a, s.n, s.t, s.z) == (True, 3.0, "hi", True)
    items = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(10.0).alias("height")) for t, x, y in (("a", 0.0, 0.0), ("b", 9.0, 2.0), ("c", 0.0, 20.0))])
    assert one(S.lines_of_items(items)) == "a b\nc"
    ann = F.array(F.struct(F.lit("line").alias("type"), F.array(F.struct(F.lit(0.1).alias("x"), F.lit(0.2).alias("y"))).alias("points")))
    assert tuple(one(S.rotated_annotations(ann, F.lit(1)))[0].points[0]) == (0.8, 0.1) and one(S.rotated_annotations(ann, F.lit(4)))[0].points[0].x == 0.1
    caps = spark.createDataFrame([("s", "b1"), ("s", "b2")], "session string, blob_id string")
    assert S.restored_sessions(caps, caps.where("blob_id = 'b1'")).count() == 1
