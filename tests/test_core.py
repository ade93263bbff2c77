"""Golden values of text, search, analytics, repository, pages, geometry, images, streams and files."""

import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchmint.functions import analytics as A
from parchmint.functions import geometry as G
from parchmint.functions import layout as L
from parchmint.functions import pages as P
from parchmint.functions import text as T
from parchmint.functions import vault as V
from parchmint.operators import duplicates as D
from parchmint.operators import hierarchy as H
from parchmint.operators import repository as R
from parchmint.operators import search as S
from parchmint.operators.components import connected_components
from parchmint.operators.current import current_rows
from parchmint.sources import packages as Q

INVOICE = "EDF SA\n22-30 avenue de Wagram 75008 Paris\nFACTURE N° F-2024-0117\nDate : 12/03/2024\nClient : Jean Dupont\nConsommation électricité mars\nTotal HT 70,17 €\nTVA (20%) 14,03 €\nTotal TTC 84,20 €\nNet à payer 84,20 €"
RECEIPT = "CARREFOUR MARKET\nTICKET DE CAISSE\nPain 1,20\nLait 0,99\nTOTAL 2,19 EUR\nCB ****1234\nMERCI DE VOTRE VISITE\n02.05.2024 18:32"
NOW = datetime(2024, 5, 1)


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("v")).first().v


def texts(spark, f, rows):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    return [r.v for r in df.orderBy("i").select(f(F.col("t")).alias("v")).collect()]


def test_normalize(spark):
    rows = ["Électricité  — ŒUVRE, l’été !", "", None, "Straße ﬁ Ægir", "Ångström 42"]
    got = texts(spark, T.normalize, rows)
    assert got[0] == "electricite oeuvre l ete" and got[1] == "" and got[2] is None
    assert got[3:] == [T.normalize_py(r) for r in rows[3:]]
    assert texts(spark, T.tokenize, ["", None, "a b"]) == [[], [], ["a", "b"]]


def test_edit_distance(spark):
    df = spark.createDataFrame([("facture", "factura"), ("facture", "contrat")], ["a", "b"])
    assert [r.d for r in df.select(T.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()] == [1, 3]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [
        ("scan27", "Scan 27", "", [], "", "ELECTRICITE DE FRANCE\nFacture EDF n° 1234\nMontant TTC : 84,20 €\nÉchéance le 15/04/2024", "scan facture", NOW, NOW),
        ("bail", "Contrat de location", "Logement", ["bail", "appartement"], "", "Entre les soussignés…", "scan", NOW, NOW),
        ("note", "Liste de courses", "", [], "penser à la facture du plombier", "lait, œufs, pain", "scan", NOW, NOW),
        ("old", "Relevé 2021", "", None, None, "Relevé de compte", "scan", datetime(2021, 6, 2), datetime(2021, 6, 2)),
    ]
    return spark.createDataFrame(rows, "id string, title string, folder_path string, tags array<string>, notes string, content string, type string, created_at timestamp, updated_at timestamp")


@pytest.mark.parametrize(
    ("query", "kw", "want"),
    [
        ("facture EDF", {}, ["scan27"]), ("electricite", {}, ["scan27"]), ("ÉCHÉANCE", {}, ["scan27"]), ("appartement", {}, ["bail"]), ("logement", {}, ["bail"]), ("plombier", {}, ["note"]), ("location", {}, ["bail"]),
        ("juin 2021", {}, ["old"]), ("contr", {}, ["bail"]), ("electricte", {}, ["scan27"]), ("factrue", {}, []), ("facture contrat", {}, []), ('"montant ttc"', {}, ["scan27"]), ('"ttc montant"', {}, []), ("", {"type": "facture"}, ["scan27"]), ("releve", {"since": "2022-01-01"}, []),
    ],
)
def test_search(corpus, query, kw, want):
    assert [r.id for r in S.search(corpus, query, "2024-05-01", **kw).collect()] == want


def test_search_details(spark, corpus):
    assert {r.id for r in S.search(corpus, "facture", "2024-05-01").collect()} == {"note", "scan27"}
    assert S.parse_query('facture "montant ttc" EDF') == (["facture", "edf"], ["montant ttc"])
    hit = S.with_snippets(S.search(corpus, "facture EDF", "2024-05-01"), corpus, "facture EDF").first()
    assert "Facture EDF" in hit.snippet and "content" in hit.fields
    text, marks = S.make_snippet("Bonjour, voici la facture EDF du mois.", ["facture", "edf"])
    assert len(marks) == 2 and text[slice(*marks[0])] == "facture"
    by_scan = {r.id: round(r.score, 6) for r in S.search(corpus, "facture edf", "2034-05-01").collect()}
    by_index = {r.id: round(r.score, 6) for r in S.search_postings(S.build_postings(corpus), "facture edf").collect()}
    assert by_scan == by_index
    r = spark.createDataFrame([([[0, 4], [2, 6], [4, 8]],)], "r array<array<int>>").select(S.without_overlaps(F.col("r")).alias("v")).first().v
    assert [list(x) for x in r] == [[0, 4], [4, 8]]


def test_amounts_and_dates(spark):
    assert texts(spark, A.parse_amount, ["1 234,56", "1,234.56", "84,20", "12", "abc", None]) == [1234.56, 1234.56, 84.2, 12.0, None, None]
    assert texts(spark, A.find_date, ["12/03/2024", "02.05.2024", "2024-01-31", "1er février 2023", "rien", "le 99/99/2024 puis 5 mai 2021"]) == ["2024-03-12", "2024-05-02", "2024-01-31", "2023-02-01", None, "2021-05-05"]


def test_invoice(spark):
    a, b = texts(spark, A.invoice_data, [INVOICE, RECEIPT])
    assert (a.company, a.number, a.date, a.total_ht, a.vat, a.total_ttc, a.currency) == ("EDF SA", "F-2024-0117", "2024-03-12", 70.17, 14.03, 84.2, "EUR")
    assert (b.total_ttc, b.currency, b.date, b.company) == (2.19, "EUR", "2024-05-02", "CARREFOUR MARKET")
    rows = [INVOICE, RECEIPT, "CONTRAT DE LOCATION\nEntre les soussignés, il a été convenu. Signature", "Bonjour le monde", "Rapport : la facture a été payée.", None]
    assert texts(spark, A.classify, rows) == ["facture", "recu", "contrat", None, None, None]
    df = spark.createDataFrame([(INVOICE,), ("Compte rendu de réunion\n…",)], "t string").select("t", A.classify(F.col("t")).alias("k"), A.invoice_data(F.col("t")).alias("i"))
    out = df.select(A.suggest_title(F.col("t"), F.col("k"), F.col("i")).alias("title"), A.suggest_tags(F.col("t"), F.col("k"), F.col("i")).alias("tags")).collect()
    assert [r.title for r in out] == ["Facture — EDF SA — 2024-03-12", "Compte rendu de réunion"] and out[0].tags == ["facture", "edf", "2024"]


def test_names_of_files(spark):
    assert texts(spark, A.sanitize_file_name, ["../a/b:c?.txt", "CON", "...", "é" * 200]) == ["b c .txt", "_CON", "document", "é" * 120]
    assert texts(spark, A.is_safe_zip_path, ["a/b.txt", "../x", "/x", "C:x", "a\\b", ""]) == [True, False, False, False, False, False]
    assert texts(spark, A.is_default_title, ["Scan 27", "Scan du 1/2", "Contrat de location"]) == [True, True, False]
    assert one(spark, A.format_bytes(F.lit(2_500_000))) == "2,4 Mo"


def test_current_rows(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), (None, 9, "z"), ("b", None, "w")], "k string, v int, t string")
    assert sorted(map(tuple, current_rows(df, "k", "v", ["t"]).collect())) == [("a", "y"), ("b", "w")]
    assert current_rows(df.limit(0), "k", "v", ["t"]).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (3, 1), (7, 7), (None, 1)], "a int, b int")
    assert sorted(map(tuple, connected_components(links, "a", "b").collect())) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in connected_components(chain, "a", "b").collect()} == {0}
    assert connected_components(links.limit(0), "a", "b").count() == 0


def test_folders(spark):
    f = spark.createDataFrame([("a", "Administratif", None, None), ("i", "Impôts", "a", None), ("y", "2024", "i", None), ("x", "X", "gone", None), ("c1", "C", "c2", None), ("c2", "D", "c1", None)], "id string, name string, parent_id string, deleted_at timestamp")
    assert {r.id: r.path for r in H.folder_paths(f).collect()}["y"] == "Administratif / Impôts / 2024"
    assert {r.id for r in H.descendants(f, "a").collect()} == {"i", "y"}
    assert not H.may_move(f, "a", "y") and H.may_move(f, "y", "a") and H.may_move(f, "a", None)
    assert not H.name_is_free(f, "impots", "a") and H.name_is_free(f, "Divers", "a")
    d = spark.createDataFrame([("d1", "y", None), ("d2", "y", datetime(2020, 1, 1)), ("d3", None, None)], "id string, folder_id string, deleted_at timestamp")
    f2, d2 = H.trash_folder(f, d, "a", "2024-01-01")
    assert {r.id for r in d2.where("deleted_at is null").collect()} == {"d3"} and f2.where("deleted_at is not null").count() == 3
    f3, d3 = H.restore_folder(f2, d2, "a")
    assert f3.where("deleted_at is not null").count() == 0 and {r.id for r in d3.where("deleted_at is null").collect()} == {"d1", "d3"}


def test_repository(spark):
    old = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "id string, title string, revision int")
    new = spark.createDataFrame([("a", "z", 2), ("b", "w", 2), ("c", "v", 1)], "id string, title string, revision int")
    merged = R.merge_by(old, new, "id", "revision")
    assert sorted(map(tuple, merged.collect())) == [("a", "z", 2), ("b", "y", 2), ("c", "v", 1)]
    assert sorted(map(tuple, R.merge_by(merged, new, "id", "revision").collect())) == sorted(map(tuple, merged.collect()))
    blobs = spark.createDataFrame([("p", 14), ("q", 9), ("r", 1)], "blob_id string, size int")
    refs = spark.createDataFrame([("d", "p"), ("d", "q"), ("d", "p"), ("d", "zz")], "doc_id string, blob_id string")
    assert [r.blob_id for r in R.unreferenced(blobs, refs).collect()] == ["r"] and R.document_sizes(refs, blobs).first()["size"] == 23
    t = spark.createDataFrame([([" Logement ", "logement", "Bail"],)], "t array<string>")
    assert t.select(R.normalized_tags(F.col("t")).alias("v")).first().v == ["logement", "bail"]
    assert R.merged_title(["A", "B", "C"]) == "A + 2 autres"


def test_pages(spark):
    df = spark.createDataFrame([([("a", 0, 3, 4), ("b", 0, 3, 4), ("c", 0, 3, 4)],)], "p array<struct<id:string,rotation:int,width:int,height:int>>")
    ids = lambda c: [r.id for r in df.select(c.alias("v")).first().v]
    p = F.col("p")
    assert ids(P.move_page(p, F.lit(0), F.lit(2))) == ["b", "c", "a"] and ids(P.move_page(p, F.lit(2), F.lit(0))) == ["c", "a", "b"] and ids(P.move_page(p, F.lit(7), F.lit(0))) == ["a", "b", "c"]
    assert ids(P.remove_pages(p, ["b"])) == ["a", "c"] and ids(P.duplicate_page(p, "a", F.lit("a2"))) == ["a", "a2", "b", "c"] and ids(P.duplicate_page(p, "q", F.lit("a2"))) == ["a", "b", "c"]
    r = df.select(P.rotate_page(p[0], F.lit(-1)).alias("v")).first().v
    assert (r.rotation, r.width, r.height) == (3, 4, 3)
    s = spark.createDataFrame([("1-3, 5",), ("2,2",), ("0",), ("4-2",), ("",), ("9",), ("x",)], "s string")
    assert [r.v for r in s.select(P.page_ranges(F.col("s"), F.lit(6)).alias("v")).collect()] == [[0, 1, 2, 4], [1], None, None, None, None, None]
    assert ids(P.extract_pages(p, F.array(F.lit(2), F.lit(0), F.lit(9)))) == ["c", "a"]
    parts = lambda c: [[x.id for x in y] for y in df.select(c.alias("v")).first().v]
    assert parts(P.split_every(p, 2)) == [["a", "b"], ["c"]] and parts(P.split_at(p, [1])) == [["a"], ["b", "c"]]
    u = P.UndoStack(1)
    u.push(2), u.push(3)
    assert (u.undo(), u.undo(), u.undo(), u.redo()) == (2, 1, 1, 2)


def test_geometry(spark):
    q = [(60.0, 40.0), (300.0, 55.0), (290.0, 230.0), (50.0, 220.0)]
    df = spark.createDataFrame([(q[2:] + q[:2], q)], "m array<struct<x:double,y:double>>, q array<struct<x:double,y:double>>")
    r = df.select(G.order_quad(F.col("m")).alias("o"), G.polygon_area(F.col("q")).alias("a"), G.is_convex(F.col("q")).alias("c"), G.quad_angles(F.col("q")).alias("g"), G.point_in_polygon(G.point(F.lit(100), F.lit(100)), F.col("q")).alias("i"), G.max_corner_distance(F.col("q"), F.col("q")).alias("z")).first()
    assert [tuple(p) for p in r.o] == q and r.c and r.i and r.z == 0 and abs(sum(r.g) - 360) < 1e-9 and abs(r.a - 42725.0) < 1
    m = one(spark, G.invert3(F.array(*[F.lit(float(v)) for v in (2, 0, 1, 0, 4, 0, 0, 0, 1)])))
    assert np.allclose(np.array(m).reshape(3, 3) @ np.array([[2, 0, 1], [0, 4, 0], [0, 0, 1]]), np.eye(3))
    h = G.homography(np.array(q), np.array([[0, 0], [1, 0], [1, 1], [0, 1]], float))
    p = h @ [290, 230, 1]
    assert np.allclose(p[:2] / p[2], [1, 1]) and G.homography(np.zeros((4, 2)), np.ones((4, 2))) is None
    size = one(spark, G.estimate_output_size(F.array(*[G.point(F.lit(float(x)), F.lit(float(y))) for x, y in [(0, 0), (210, 0), (210, 300), (0, 300)]])))
    assert (size.width, size.height) == (212, 300)
    assert len(G.convex_hull(np.array([[0, 0], [1, 0], [2, 0], [2, 2], [0, 2], [1, 1]]))) == 4


def _scene(seed):
    from parchmint.vision.detect import quad_masks
    from parchmint.vision.kernels import clamp, gaussian_blur

    rng = np.random.default_rng(seed)
    w, h = 360, 270
    c = np.array([w / 2, h / 2]) + rng.uniform(-20, 20, 2)
    a, rx, ry = rng.uniform(-0.3, 0.3), rng.uniform(90, 130), rng.uniform(65, 95)
    q = np.array([[-rx, -ry], [rx, -ry], [rx, ry], [-rx, ry]]) @ np.array([[math.cos(a), math.sin(a)], [-math.sin(a), math.cos(a)]]) + c + rng.uniform(-8, 8, (4, 2))
    img = rng.uniform(30, 90) + rng.normal(0, 4, (h, w))
    img[quad_masks(q, w, h, 1)[0]] = rng.uniform(180, 235)
    return gaussian_blur(clamp(img + rng.normal(0, 3, img.shape)), 0.7), q


def test_detection():
    from parchmint.vision.detect import assess_quality, detect_document

    errors, missed = [], 0
    for seed in range(24):
        img, q = _scene(seed)
        if (q < 8).any() or (q[:, 0] > 352).any() or (q[:, 1] > 262).any():
            continue
        found, score, partial = detect_document(img)
        if found is None:
            missed += 1
            continue
        errors.append(min(np.abs(np.roll(found, k, axis=0) - q).max() for k in range(4)))
    assert len(errors) > 12 and missed <= 1 and np.median(errors) <= 1.5 and np.quantile(errors, 0.9) <= 4
    flat = np.full((270, 360), 128, np.uint8)
    assert detect_document(flat)[0] is None and assess_quality(flat)["blurry"] and assess_quality(flat // 4)["too_dark"]


def test_kernels():
    from parchmint.vision import kernels as K

    rng = np.random.default_rng(2)
    img = rng.integers(0, 256, (40, 60, 3), dtype=np.uint8)
    assert (K.rotate90(K.rotate90(img, 1), 3) == img).all() and K.box_resize(img, 60, 40).tolist() == img.tolist()
    assert set(np.unique(K.apply_preset(img, "bw"))) <= {0, 255}
    assert K.otsu_threshold(np.bincount([10] * 50 + [200] * 50, minlength=256)) == 10 and K.otsu_threshold(np.zeros(256, int)) == 127
    ramp = np.tile(np.arange(90, dtype=np.uint8), (80, 1))
    assert K.d_hash(ramp) == "0" * 16 and K.d_hash(ramp[:, ::-1]) == "f" * 16
    assert K.blank_page_score(np.full((100, 80, 3), 250, np.uint8))[1]
    page = np.full((200, 200, 3), 245, np.uint8)
    for y in range(20, 180, 12):
        page[y : y + 5, 20:180] = 20
    assert K.text_direction(page)[0] == 0 and K.text_direction(K.rotate90(page, 1))[0] == 1
    lab = K.label(np.array([[1, 0, 1], [0, 1, 0], [0, 0, 0], [1, 1, 0]]) > 0)
    assert lab.max() == 2 and lab[0, 0] == lab[0, 2] == lab[1, 1] != lab[3, 0]
    w = K.warp(img, np.array([[0, 0], [60, 0], [60, 40], [0, 40]]), 60, 40)
    assert np.abs(w.astype(int) - img).max() <= 1


def _frames(n, quad, step=66, **kw):
    return [{"t_ms": float(i * step), "quad": quad, "score": 0.9, "partial": False, "blurry": False, "too_dark": False, "enabled": True} | kw for i in range(n)]


def test_automata():
    from parchmint.streaming.automata import Session, Settings, step

    o, q = Settings(600.0), [10.0, 10.0, 200.0, 12.0, 198.0, 300.0, 9.0, 301.0]
    s = Session()
    out = [step(s, o, f) for f in _frames(40, q)]
    assert sum(r["fire"] for r in out) == 1 and out[-1]["status"] == "cooldown"
    for kw, status in ((dict(blurry=True), "blurry"), (dict(partial=True), "partial"), (dict(enabled=False), "detected"), (dict(too_dark=True), "too-dark")):
        s = Session()
        out = [step(s, o, f) for f in _frames(40, q, **kw)]
        assert not any(r["fire"] for r in out) and out[-1]["status"] == status
    s, far = Session(), [v + 150 for v in q]
    frames = _frames(20, q)
    frames[10] = frames[10] | {"quad": far}
    assert max(abs(a - b) for r in [step(s, o, f) for f in frames] for a, b in zip(r["quad"], q)) < 1
    s = Session()
    out = [step(s, o, f) for f in _frames(5, q) + [f | {"t_ms": f["t_ms"] + 400} for f in _frames(5, far)]]
    assert abs(out[-1]["quad"][0] - far[0]) < 20
    s = Session()
    out = [step(s, o, f) for f in _frames(5, q) + [f | {"t_ms": f["t_ms"] + 400, "quad": None} for f in _frames(12, q)]]
    assert out[-1]["quad"] is None and out[-1]["status"] == "searching"


def test_stream_equals_batch(spark, tmp_path):
    from parchmint.streaming.automata import Settings
    from parchmint.streaming.frames import FRAME, capture_batch, capture_stream

    q = [10.0, 10.0, 200.0, 12.0, 198.0, 300.0, 9.0, 301.0]
    rows = [(f"s{k}", f["t_ms"], None if i % 17 == k else f["quad"], 0.9, False, False, False, True) for k in range(3) for i, f in enumerate(_frames(60, q))]
    df = spark.createDataFrame(rows, FRAME)
    df.where("t_ms < 2000").coalesce(1).write.parquet(str(tmp_path / "in/a.parquet"))
    df.where("t_ms >= 2000").coalesce(1).write.parquet(str(tmp_path / "in/b.parquet"))
    frames = spark.readStream.schema(FRAME).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    w = capture_stream(frames, Settings(600.0)).writeStream.format("memory").queryName("decisions").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    w.awaitTermination(120)
    key = lambda d: sorted((r.session, r.t_ms, r.status, r.fire, round(r.confidence, 9)) for r in d.collect())
    batch = key(capture_batch(df, Settings(600.0)))
    assert len(batch) == 180 and key(spark.table("decisions")) == batch and sum(r[3] for r in batch) >= 3


def test_packages(spark):
    from parchmint.sinks import packages as W
    from parchmint.sources import packages as Q

    z = W.create_zip({"a.txt": b"x" * 500, "b/c.txt": b"y"})
    assert Q.read_zip(z) == {"a.txt": b"x" * 500, "b/c.txt": b"y"} and W.create_zip({"a.txt": b"x" * 500, "b/c.txt": b"y"}) == z
    with pytest.raises(ValueError):
        W.create_zip({"../x": b""})
    with pytest.raises(Q.PackageError):
        Q.read_zip(z[:-30])
    kind, blocks = Q.read_document("a.docx", W.build_docx("Titre & co", ["Bonjour\nà tous\n\nFin", "Page 2"]))
    assert kind == "docx" and [b["kind"] for b in blocks] == ["heading", "paragraph", "paragraph", "page_break", "paragraph"] and "Titre & co" in Q.blocks_text(blocks)
    assert Q.parse_cell_ref("AB10") == (27, 9) and Q.excel_date(45352) == "2024-03-01"
    x = Q.parse_xml('<a:r x="1 &amp; 2"><b>&lt;b&gt; é€<![CDATA[<raw>]]>&amp;e;</b></a:r>')
    assert x.name == "r" and x.attrs["x"] == "1 & 2" and x.text() == "<b> é€<raw>&e;"
    assert Q.decode_entities("&#233;&#x20AC;&nope;&lt;") == "é€&nope;<"
    assert Q.parse_txt("Première\nDeuxième ligne".encode("cp1252"))[1]["text"] == "Deuxième ligne"
    for name, data, code in (("x.pdf", b"hello", "mismatch"), ("x.doc", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1..", "legacy-office"), ("x", b"", "empty"), ("x.html", b"<p>", "dangerous"), ("x.png", b"<svg >", "dangerous"), ("x.bin", b"\x00\x01", "unsupported")):
        with pytest.raises(Q.PackageError, match=code):
            Q.read_document(name, data)
    files = spark.createDataFrame([("a.docx", W.build_docx("T", ["u"])), ("b.docx", z), ("c.txt", b"Notes")], "path string, content binary")
    got = {r.path: (r.kind, r.error) for r in Q.import_files(files).collect()}
    assert got == {"a.docx": ("docx", None), "b.docx": (None, "unsupported"), "c.txt": ("txt", None)}
    pdf = W.build_pdf("Été", [{"width": 595.28, "height": 841.89, "words": [{"text": "Bonjour", "x": 50, "y": 60, "w": 80, "h": 12}]}])
    assert pdf.startswith(b"%PDF-1.7") and Q.sniff(pdf) == "pdf" and pdf.rstrip().endswith(b"%%EOF")
    at = int(pdf.rsplit(b"startxref\n", 1)[1].split()[0])
    assert pdf[at : at + 4] == b"xref" and len(W.build_docx("x", [])) > 100
    tsv = "\n".join("\t".join(map(str, r)) for r in [(5, 1, 1, 1, 1, 1, 10, 20, 80, 30, 96.5, "Facture"), (5, 1, 1, 1, 1, 2, 100, 20, 40, 30, 90, "EDF"), (5, 1, 1, 1, 2, 1, 10, 60, 80, 30, 85, "Montant"), (5, 1, 1, 2, 1, 1, 10, 99, 30, 30, 84, "Fin"), (4, 1, 1, 2, 1, 0, 1, 1, 1, 1, -1, "")])
    df = spark.createDataFrame([(tsv,)], "t string").select(Q.parse_tsv(F.col("t")).alias("w"))
    r = df.select(Q.tsv_text(F.col("w")).alias("t"), F.aggregate("w", F.lit(0.0), lambda a, w: a + w["conf"] / 4).alias("c")).first()
    assert r.t == "Facture EDF\nMontant\n\nFin" and abs(r.c - 88.875) < 1e-9


def test_layout():
    w = lambda s: len(s) * 10.0
    assert L.break_lines("aaa bbb ccc ddd", 70, w) == ["aaa bbb", "ccc ddd"] and len(L.break_lines("x" * 12, 50, w)) == 3
    assert L.win_ansi("é€œş") == b"\xe9\x80\x9cs" and L.helvetica_width(b"A", 1000) == 667
    pages = L.layout_blocks([{"kind": "paragraph", "level": 0, "text": "mot " * 3000, "rows": []}])
    assert len(pages) > 1 and pages[0]["words"]


def test_layout_measures():
    """Places worked out from the stated measures: characters half as wide as their size."""
    half = lambda t, f: len(t) * f.size / 2
    blocks = [{"kind": "heading", "level": 1, "text": "Titre"}, {"kind": "paragraph", "text": "un\tdeux"}, {"kind": "list_item", "text": "x", "number": 3}, {"kind": "table", "rows": [["a", "b"], ["c"]]}]
    (page,) = L.layout_blocks(blocks, measure_text=half)
    places = [(w["text"], round(w["x"], 3), round(w["y"], 3), round(w["h"], 3)) for w in page["words"]]
    assert places == [("Titre", 130, 139.625, 40.425), ("un", 130, 200.95, 23.1), ("deux", 163, 200.95, 23.1), ("3.", 163, 239.45, 23.1), ("x", 196, 239.45, 23.1), ("a", 138, 283.722, 19.635), ("b", 628, 283.722, 19.635), ("c", 138, 323.097, 19.635)]
    assert page["text"] == "Titre\nun deux\n3. x\na\tb\nc\t\n"
    lines = lambda n: [{"kind": "paragraph", "text": "\n".join(["mot"] * n)}]
    full = int((1754 - 2 * 130) // 30.8)
    assert len(L.layout_blocks(lines(full), measure_text=half)) == 1 and len(L.layout_blocks(lines(full + 1), measure_text=half)) == 2
    assert len(L.layout_blocks([])) == 1 and len(L.layout_blocks([{"kind": "page_break"}, *lines(1), {"kind": "page_break"}])) == 1
    # a heading goes to the next page with what follows it
    pages = L.layout_blocks(lines(full - 1) + [{"kind": "heading", "level": 2, "text": "Suite"}, *lines(1)], measure_text=half)
    assert [p["text"].split()[-2:] for p in pages] == [["mot", "mot"], ["Suite", "mot"]]
    (page,) = L.layout_blocks([{"kind": "paragraph", "text": "mot", "align": "right"}, {"kind": "image"}], measure_text=half, picture_size=lambda at: (4000, 1000))
    assert page["words"][0]["x"] == 1240 - 130 - 33 and page["pictures"][0]["w"] == 980 and page["pictures"][0]["h"] == 245
    assert [x.text for x in L.wrap(L._tokens([{"text": "un ", "bold": True}, {"text": "x" * 25}], 20), 100, half, 1.4)] == ["un", "x" * 10, "x" * 10, "x" * 5]


def test_anchor_groups(spark):
    """Against the greedy pass over all pages."""
    import random

    rnd = random.Random(8)
    base = [rnd.getrandbits(64) for _ in range(6)]
    rows = []
    for n in range(150):
        h = rnd.choice(base)
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 4])):
            h ^= 1 << rnd.randrange(64)
        rows.append((f"p{n:03}", n // 2, h - (1 << 64) if h >> 63 else h, rnd.choice(["", "", "Facture", "Bail " * 60]), rnd.random() < 0.05))
    rows += [("none", 1, None, "", False)]
    df = spark.createDataFrame(rows, "page_id string, place int, h bigint, text string, blank boolean")
    want, anchors = {}, []
    for page, place, h, text, blank in sorted((r for r in rows if r[2] is not None and not r[4]), key=lambda r: (r[1], r[0])):
        head = text.strip()[:200]
        found = next((a for v, t, a in anchors if ((v ^ h) & (2**64 - 1)).bit_count() <= 5 and (not t or not head or t == head)), None)
        if found is None:
            anchors.append((h, head, page))
        want[page] = found or page
    assert {r.page_id: r.anchor for r in D.anchor_groups(df, "place").collect()} == want
    assert D.anchor_groups(df.limit(0), "place").count() == 0
    pairs = {(r.id_a, r.id_b, r.distance) for r in D.near_hashes(df, "page_id", "h", 7).collect()}
    ok = [r for r in rows if r[2] is not None]
    assert pairs == {(a[0], b[0], d) for a in ok for b in ok if a[0] < b[0] and (d := ((a[2] ^ b[2]) & (2**64 - 1)).bit_count()) <= 7}


def test_folder_writes(spark):
    from parchmint.operators import library as B

    folders = spark.createDataFrame([("a", "Été", None), ("b", "Sous", "a")], "id string, name string, parent_id string")
    folders = folders.withColumns({"created_at": F.lit(None).cast("timestamp"), "updated_at": F.lit(None).cast("timestamp"), "deleted_at": F.lit(None).cast("timestamp"), "color": F.lit(None).cast("string")})
    for bad in (lambda: B.create_folder(folders, "c", " ete ", None, "2026-01-01"), lambda: B.create_folder(folders, "c", " ", None, "2026-01-01"), lambda: B.move_folder(folders, "a", "b", "2026-01-01"), lambda: B.rename_folder(folders, "zz", "x", "2026-01-01")):
        with pytest.raises(ValueError):
            bad()
    assert B.create_folder(folders, "c", "Été", "a", "2026-01-01").count() == 3 and B.rename_folder(folders, "a", "ÉTÉ", "2026-01-01").where("name = 'ÉTÉ'").count() == 1
    chain = spark.createDataFrame([(str(n), str(n - 1) if n else None) for n in range(200)], "id string, parent_id string")
    assert H.closure(chain).where("id = '199'").count() == 200


def test_sniffed_columns(spark):
    """The column function agrees with the Python one."""
    samples = [b"\xff\xd8\xff\xe0", b"BM" + b"x" * 10, b"BM" + b"x" * 30, b"\0\0\0\x18ftypheic", b"<svg xmlns=''>", b"<?xml version='1.0'?>\n<svg >", b"RIFF\0\0\0\0WEBP", b"PK\x03\x04 %PDF-1.4", b"PK\x03\x04aa", b"x%PDF-1", b"\x89PNG", b"\x00\x01\x02"]
    df = spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate(samples)], "k int, b binary").select("k", Q.sniff_column(F.col("b")).alias("t"))
    got = {r.k: r.t for r in df.collect()}
    assert [got[k] for k in range(len(samples))] == [t if (t := Q.sniff(b)) != "text" else "unknown" for b in samples]


def test_vault(spark):
    k, bad = V.derive_key("secret!", b"s" * 16, 1000), V.derive_key("autre!!", b"s" * 16, 1000)
    df = spark.createDataFrame([("d1", "texte"), ("d2", None)], "id string, t string").withColumn("s", V.seal(F.col("t"), k, F.col("id")))
    r = df.select("id", V.unseal(F.col("s"), k, F.col("id")).cast("string").alias("ok"), V.unseal(F.col("s"), bad, F.col("id")).alias("no"), V.unseal(F.col("s"), k, F.lit("dx")).alias("other"), V.is_sealed(F.col("s")).alias("m")).orderBy("id").collect()
    assert (r[0].ok, r[0].no, r[0].other, r[0].m) == ("texte", None, None, True) and (r[1].ok, r[1].m) == (None, False)
    assert V.check_password("12345") and not V.check_password("123456")


def test_pdf_protection(spark):
    import re
    import zlib

    from parchmint.sinks.packages import build_pdf
    from parchmint.sinks.pdf_security import Cbc, file_key, permissions, protect

    pdf = build_pdf("Été", [{"width": 100, "height": 100, "words": [{"text": "secret", "x": 5, "y": 6, "w": 30, "h": 12}]}], protection=protect(spark, "mot de passe"))
    assert b"/Encrypt" in pdf and permissions() < 0
    u, ue = (bytes.fromhex(re.search(rb"/%s <([0-9a-f]+)>" % n, pdf).group(1).decode()) for n in (b"U", b"UE"))
    assert file_key(spark, "faux", u, ue) is None
    key = file_key(spark, "mot de passe", u, ue)
    body = re.search(rb"/Length (\d+) /Filter /FlateDecode >>\nstream\n", pdf)
    raw = pdf[body.end() : body.end() + int(body.group(1))]
    assert b"<" + b"secret".hex().encode() + b">" in zlib.decompress(Cbc(spark).run(key, raw[:16], raw[16:], padded=True, decrypt=True))
