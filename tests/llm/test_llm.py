"""The dealt operators against brute force, exact round trips, held-out accuracy and awkward input."""

import random

import pytest
from pyspark.sql import functions as F

from parchmint.functions.text import normalize_py, tokenize
from parchmint.llm import languages, leaks, name_links, near_duplicates, packing, personal, residue, scan_noise
from parchmint.llm.boosting import Boosted

WORDS = [f"mot{i}" for i in range(400)]


def _variants(seed, groups, copies, length=60, edits=3):
    rnd = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [rnd.choice(WORDS) for _ in range(length)]
        for c in range(copies):
            w = list(base)
            for _ in range(edits if c else 0):
                w[rnd.randrange(len(w))] = rnd.choice(WORDS)
            rows.append((f"g{g:03d}c{c}", " ".join(w)))
    return rows


def _brute(rows, n, threshold, least):
    sets = {}
    for k, t in rows:
        w = normalize_py(t or "").split()
        if k is not None and len(w) >= least:
            sets[k] = frozenset(zip(*(w[i:] for i in range(n))))
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in ids if sum(root(j) == root(k) for j in ids) > 1}


def _groups(df, **kw):
    return {r.key: r.group_key for r in near_duplicates.near_duplicate_groups(df, "key", tokenize(F.col("text")), **kw).collect()}


def test_near_duplicates_brute_force(spark):
    rows = _variants(1, 40, 4) + [("short", "a b c"), ("null", None), (None, "x " * 40), ("empty", ""), ("long", "lang " * 30_000), ("g000c0x", _variants(1, 1, 1)[0][1])]
    df = spark.createDataFrame(rows + [("g000c0", rows[0][1])], "key string, text string").withColumn("cls", F.lit(1)).withColumn("sh", F.lit(2))
    assert _groups(df, n=3, threshold=0.6) == _brute(rows, 3, 0.6, 20)
    assert _groups(df.limit(0)) == {}


def test_near_duplicates_hot_group(spark, monkeypatch):
    """A third of all records alike each other: the last level's node is compared with pivots and in blocks."""
    monkeypatch.setattr(near_duplicates, "LEAF", 6)
    monkeypatch.setattr(near_duplicates, "MOST_DEPTH", 2)
    rows = _variants(2, 1, 60, 80, 4) + _variants(3, 30, 2)
    df = spark.createDataFrame([(f"h{i}-{k}", t) for i, (k, t) in enumerate(rows)], "key string, text string")
    assert _groups(df, n=3, threshold=0.6) == _brute([(r.key, r.text) for r in df.collect()], 3, 0.6, 20)


def test_near_duplicates_links_in_hot_group(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "LEAF", 6)
    monkeypatch.setattr(near_duplicates, "MOST_DEPTH", 2)
    monkeypatch.setattr(near_duplicates, "BLOCK", 16, raising=False)
    rows = _variants(9, 1, 90)
    sets = {k: frozenset(zip(*(t.split()[i:] for i in range(3)))) for k, t in rows}
    want = {k: sum(j != k and 5 * len(s & x) >= 3 * len(s | x) for j, x in sets.items()) for k, s in sets.items()}
    got = near_duplicates.near_duplicate_groups(spark.createDataFrame(rows, "key string, text string"), "key", tokenize(F.col("text")), n=3, threshold=0.6)
    got = {r.key: r.links for r in got.collect()}
    assert got and all(got[k] <= want[k] for k in got) and sum(got.values()) >= 0.99 * sum(want.values()), (sum(got.values()), sum(want.values()))


def test_near_duplicates_recall_at_depth(spark, monkeypatch):
    """Pairs at the threshold itself that meet in nodes of the last level alone."""
    monkeypatch.setattr(near_duplicates, "LEAF", 1)
    rnd = random.Random(12)
    rows = []
    for i in range(400):
        h = [rnd.getrandbits(62) for _ in range(100)]
        rows += [(2 * i, h[:80]), (2 * i + 1, h[20:])]
    links = near_duplicates.chosen_path_links(spark.createDataFrame(rows, "cls bigint, sh array<bigint>"), 0.6).collect()
    assert {(r.a, r.b) for r in links} <= {(2 * i, 2 * i + 1) for i in range(400)} and len(links) >= 0.95 * 400, len(links)


PERSONAL = [
    ("Merci d'écrire à jean.dupont@example.org avant lundi.", [("EMAIL", "jean.dupont@example.org")]),
    ("écrivez à odile95[at]letterbox.test, merci", [("EMAIL", "odile95[at]letterbox.test")]),
    ("écrivez à max arobase postfach point example.", [("EMAIL", "max arobase postfach point example")]),
    ("Le colis a quitté le dépôt @ quai 12.", []),
    ("joindre le gardien au +33 (0)1 99 00 58 71.", [("PHONE", "+33 (0)1 99 00 58 71")]),
    ("llamar a Mr Coldbrook ((01632) 960-492)", [("NAME", "Coldbrook"), ("PHONE", "(01632) 960-492")]),
    ("Votre numéro de sécurité sociale 2 32 31 99 013 957 46 figure au dossier.", [("ID_NUMBER", "2 32 31 99 013 957 46")]),
    ("SIRET 999 004 144 00012, code article 399931041790. Le numéro de commande 390044271 figure.", []),
    ("The property at 177 Larkspur Rd, Vieux-Tarnel QX7 6ZZ was visited twice.", [("ADDRESS", "177 Larkspur Rd, Vieux-Tarnel QX7 6ZZ")]),
    ("Die Wohnung Mühlweg 85a, 99110 Aubrelay wurde besichtigt.", [("ADDRESS", "Mühlweg 85a, 99110 Aubrelay")]),
    ("Bien à vous, Mlle Mordignac.\nLa Banque Mirelle a été avertie.", [("NAME", "Mordignac")]),
    ("Dossier suivi par DROUZAY,\nRégis, ligne directe 05 36 49\n30 48.", [("NAME", "DROUZAY,\nRégis"), ("PHONE", "05 36 49\n30 48")]),
]


@pytest.mark.parametrize(("text", "want"), PERSONAL)
def test_personal(text, want):
    assert [(k, text[a:b]) for a, b, k in personal.find_personal(text)] == want


def test_personal_offsets_and_redaction(spark):
    t = "x​ écrivez à оdile [at] boite.test ou au zéro un 99 00 85 48 !"
    got = [(k, t[a:b]) for a, b, k in personal.find_personal(t)]
    assert ("EMAIL", "оdile [at] boite.test") in got
    rows = [("content", "a", PERSONAL[0][0]), ("notes", "b", None), ("notes", "c", ""), ("content", "d", "mot " * 100_000), ("content", None, PERSONAL[4][0]), ("content", "a", PERSONAL[0][0])]
    df = spark.createDataFrame(rows, "src string, rec_id string, t string").withColumn("pii_type", F.lit(1)).withColumn("start_pos", F.lit(1))
    spans = personal.personal_spans(df).collect()
    assert sorted((r.rec_id or "", r.start_pos) for r in spans) == [("", 23), ("a", 18), ("a", 18)]
    red = {r.rec_id: r.t for r in personal.redacted(df.where("rec_id <> 'd'"), "t").collect()}
    assert red["a"] == "Merci d'écrire à [EMAIL] avant lundi." and red["b"] is None
    assert personal.personal_spans(df.limit(0)).count() == 0 and personal.learn_names(df.limit(0)) == frozenset()


def test_names_are_learned_from_all_texts(spark):
    parts = [f"{a}{b}" for a in ("Bar", "Mor", "Tel", "Gin") for b in ("nard", "ello", "vik")]
    known = [f"Vu avec {x} {x}son, tout va bien." for x in parts for _ in range(3)]
    rows = [(f"k{i}", t) for i, t in enumerate(known)] + [(f"x{i}", f"zzz {x} {x}son passera") for i, x in enumerate(parts)] + [(f"f{i}", "mot") for i in range(20_000)]
    df = spark.createDataFrame(rows, "rec_id string, t string").withColumn("src", F.lit("notes"))
    assert personal.learn_names(df) == {w.lower() for x in parts for w in (x, f"{x}son")}
    got = {r.rec_id: (r.start_pos, r.end_pos) for r in personal.spans_with_learned_names(df).where("pii_type = 'NAME'").collect()}
    want = {r.rec_id: (r.start_pos, r.end_pos) for r in personal.personal_spans(df, personal.learn_names(df)).collect()}
    assert got == want and all(got[f"x{i}"] == (5, 5 + 2 * len(x) + 3) for i, x in enumerate(parts))
    red = {r.rec_id: r.t for r in personal.redacted_with_learned_names(df).collect()}
    assert red["x0"] == "zzz [NAME] passera" and red["f0"] == "mot" and len(red) == len(rows)
    assert personal.spans_with_learned_names(df.limit(0)).count() == 0


SAMPLES = {
    "fra": "la société de maintenance a facturé la pose des câbles dans les locaux avec l'accord écrit du propriétaire et vous en remercie {}",
    "eng": "the maintenance contractor has billed the fitting of the cables at the premises with the written consent of the owner {}",
    "deu": "die Wartungsfirma hat den Einbau der Kabel in den Räumen berechnet mit schriftlicher Zustimmung des Eigentümers {}",
    "spa": "la empresa de mantenimiento ha cobrado la instalación de los cables en los locales con el permiso escrito del dueño {}",
    "ita": "la ditta di manutenzione ha fatturato la posa dei cavi nei locali con il consenso scritto del proprietario {}",
}


def test_languages(spark):
    rnd = random.Random(4)
    page = lambda lang: " ".join(rnd.sample(SAMPLES[lang].split(), 12))
    rows = [(f"p{i}", page(lang), "fra" if i % 19 == 0 else lang) for i, lang in enumerate(list(SAMPLES) * 40)]
    model = languages.train(spark.createDataFrame(rows, "page_id string, text string, language string"))
    assert model is not None and model[1] == sorted(SAMPLES)
    held = [(lang, page(lang)) for lang in SAMPLES for _ in range(30)]
    got, sure = languages.predict([t for _, t in held], *model)
    assert sum(a == b for (a, _), b in zip(held, got)) >= 0.95 * len(held) and (sure <= 1).all()
    odd = [("ok", page("eng"), "EN"), ("none", page("deu"), None), ("mixed", page("fra") + "\n\n" + page("ita") + "\n\nzu kurz", "fra+it"), ("und", page("spa"), "und"), ("blank", "", "fra"), ("null", None, "fra"), ("short", "un deux", None), ("long", page("ita") + " casa" * 50_000, "ita")]
    df = spark.createDataFrame(odd, "page_id string, text string, language string").withColumn("lang", F.lit("x"))
    out = {(r.page_id, r.block_no): (r.lang, r.label_differs) for r in languages.block_languages(df, model).collect()}
    assert out[("ok", 1)] == ("eng", False) and out[("none", 1)] == ("deu", True) and out[("mixed", 1)] == ("fra", True) and out[("mixed", 2)] == ("ita", True) and out[("und", 1)] == ("spa", True)
    assert {k[0] for k in out} == {"ok", "none", "mixed", "und", "long"} and languages.block_languages(df.limit(0), model).count() == 0
    assert languages.train(df.limit(0)) is None
    pages = {r.page_id: r.lang for r in languages.page_languages(languages.block_languages(df, model)).collect()}
    assert pages["mixed"] == "fra+ita"


def test_pigeonhole_finds_all_within_the_edits():
    rnd = random.Random(5)
    for _ in range(300):
        core = "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(4, 12)))
        k = name_links._edits(len(core))
        w = list(core)
        for _ in range(rnd.randint(0, k)):
            i = rnd.randrange(len(w))
            w[i : i + 1] = rnd.choice([[], [w[i], rnd.choice("abcdefgh")], [rnd.choice("abcdefgh")]])
        word = "".join(w)
        if not word or name_links.damerau(word, core, k) > k:
            continue
        keys = {f"{len(core)}:{i}:{s}" for i, _, s in name_links.segments(core, name_links._cuts(len(core)))}
        assert keys & name_links.probes(word), (core, word)


def test_names(spark):
    reg = spark.createDataFrame(
        [(1, "Boulangerie Ostvert SAS", "Weidental"), (2, "Me Elisabeth Morfereda", "Aubrelay"), (3, "Me Benjamin Morfereda", None), (4, "Imprimerie Dundunford Ltd", "Mirelles"), (5, "Imprimerie Dundunfoad Ltd", "Mirelles"), (6, "Services Belferuera du Val SA", ""), (7, "Électricité Belferuera du Val SARL", ""), (8, None, None), (4, "Imprimerie Dundunford Ltd", "Mirelles")],
        "id bigint, name string, town string",
    )
    want = {
        "Ostvert": 1, "BOUL. OSTVERT": 1, "Ostvret (Boulangerie) S.A.S.": 1, "OstvertBoulangerie": 1, "Boulangerie Ostvert SAS, Weidental": 1, "MORFEREDA Ben": 3, "Maître Lisa Morfereda": 2, "Me. Morfereda, Elisabeth": 2, "Imprimerie Dundunford": 4, "IMPR. DUNDUNFOAD LTD.": 5, "Élec. Belferuera": 7,
        "Imprimerie Dundunford Ltd": 4, "Boulangerie Corbergix SAS": None, "": None, "  ": None, "Garage Ostvert GmbH": None, "x" * 20_000: None,
    }
    names = spark.createDataFrame([(k,) for k in want] * 2 + [(None,)], "typed string").withColumn("id", F.lit("clash")).withColumn("name", F.lit(1))
    got = {r.typed: r.id for r in name_links.link_names(names, reg).collect()}
    assert got == {k: v for k, v in want.items() if v is not None}
    assert name_links.link_names(names.limit(0), reg).count() == 0 and name_links.link_names(names, reg.limit(0)).count() == 0


def _pages(spark):
    rnd = random.Random(6)
    vocab = "technicien entretien chauffage immeuble locataire facture montant paiement trimestre dossier courrier contrat garantie remplacement compteur logement adresse travaux signature livraison accord conseiller agence echeance".split()
    rows, words = [], []
    for d in range(60):
        for p in range(3):
            lines = [" ".join(rnd.choice(vocab) for _ in range(7)) for _ in range(8)]
            rows.append((f"d{d}p{p}", f"d{d}", lines))
    truth = set()
    for n, (page, doc, lines) in enumerate(rows):
        if n % 3 == 0:
            a = lines[2].rsplit(" ", 1)
            k = len(a[1]) // 2
            lines[2], lines[3] = f"{a[0]} {a[1][:k]}-", f"{a[1][k:]} {lines[3]}"
            truth.add((page, 2 + 1, "hyphen"))
        if n % 12 == 0:
            lines[6] = lines[6].replace("technicien", "tecbnicien").replace("montant", "montanf").replace("dossier", "d0ssier")
            if any(x in lines[6] for x in ("tecbnicien", "montanf", "d0ssier")):
                truth.add((page, 6 + 1, "char"))
        lines.insert(0, f"AGENCE DU PARC {doc.upper()}")
        truth.add((page, 0, "header"))
        lines.append(f"- {n} -")
        truth.add((page, 9, "page_number"))
        for w in (w for t in lines for w in t.split()):
            words.append((w, 55.0 if w in ("tecbnicien", "montanf", "d0ssier") else 93.0))
    frame = [(p, d, "\n".join([t[0], ""] + t[1:])) for p, d, t in rows]
    return spark.createDataFrame(frame, "page_id string, doc_id string, text string"), spark.createDataFrame(words, "text string, confidence double"), truth


def test_scan_noise(spark):
    pages, words, truth = _pages(spark)
    more = spark.createDataFrame([("blank", "d0", ""), ("null", None, None), ("one", None, "x")], pages.schema)
    got = {(r.page_id, r.line, r.noise) for r in scan_noise.line_noise(pages.union(more).withColumn("line", F.lit(9)), words.union(words.limit(1)).union(spark.createDataFrame([(None, None)], words.schema))).collect()}
    assert len(got & truth) >= 0.95 * len(truth) and len(got & truth) >= 0.95 * len(got), (sorted(truth - got)[:9], sorted(got - truth)[:9])
    text = {r.page_id: r.text for r in scan_noise.repaired_pages(pages.union(more), words).collect()}
    assert text["blank"] == "" and "AGENCE" not in text["d0p0"] and "-" not in text["d0p0"] and "tecbnicien" not in text["d1p1"]
    assert scan_noise.line_noise(pages.limit(0), words.limit(0)).count() == 0


def test_scan_noise_rare_words_in_large_collections(spark, monkeypatch):
    """What the share bound keeps from the tasks is still a candidate and a shape."""
    monkeypatch.setattr(scan_noise, "LEAST_SHARE", 0.02)
    pages, words, _ = _pages(spark)
    rare = ["chaudiere"] * 12 + ["chaudlere"] + ["12.05.2026"] * 900 + ["A-12"] * 20 + ["4-12"] * 600 + ["1O.05.2026"]
    words = words.union(spark.createDataFrame([(w, 93.0) for w in rare], words.schema))
    v = scan_noise.Vocabulary(words)
    assert v.least > 100 and "chaudiere" not in v.words
    assert {r.form: r.cand for r in scan_noise.corrections(v.forms, v).collect()}.get("chaudlere") == "chaudiere"
    more = spark.createDataFrame([("r", "r", "facture chaudlere montant\nfacture A-12 montant\nfacture 1O.05.2026 montant\nfacture montant")], pages.schema)
    got = {(r.line, r.noise) for r in scan_noise.line_noise(pages.union(more), words).where("page_id = 'r'").collect()}
    assert (0, "char") in got and (1, "char") not in got and (2, "char") in got, got


def test_scan_noise_frequent_forms_without_confidence(spark):
    pages, words, _ = _pages(spark)
    more = [("m0ntre", 55.0)] + [("chauffage", 93.0)] * 2000 + [("chauffaqe", 0.0)] * 15 + [("chauffaqe", None)] * 15
    v = scan_noise.Vocabulary(words.union(spark.createDataFrame(more, words.schema)))
    assert v.sure_split > 0
    assert {r.form: r.cand for r in scan_noise.corrections(v.forms, v).collect()}.get("chauffaqe") == "chauffage"


def test_boosting():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = Boosted().fit(x[:1500], y[:1500])
    assert ((m.predict(x[1500:]) > 0.5) == y[1500:]).mean() > 0.9


FILLED = """lorem ipsum|dolor sit amet|consectetur adipiscing|sed do eiusmod|ut labore et dolore|bla bla bla|blah blah blah|inserer le texte|insérer le contenu|saisissez le paragraphe|saisir un texte|entrez le texte|tapez le texte
placez le contenu|texte à remplacer|texte de remplissage|texte factice|texte d'exemple|texte bidon|your text here|your content goes here|insert text here|enter the copy here|type your content here|put text here|add content here
sample paragraph|sample text|placeholder copy|dummy text|filler text|hier steht text|hier kommt text|hier folgt text|blindtext|mustertext|beispieltext|platzhaltertext|text einfugen|text hier einfügen|text eingeben|ihr text hier
texto de ejemplo|texto de relleno|texto de muestra|texto de prueba|inserte el texto|escriba el contenido|introduzca el texto|ponga el contenido|su texto aquí|testo di prova|testo di esempio|testo di riempimento|testo segnaposto
inserire il contenuto|inserisci il contenuto|inserire il testo.|scrivi il contenuto|scrivere il testo.|digitare il contenuto|il tuo testo, qui|il vostro testo qui|il suo testo qui|asdf asdf|qwertz qwertz|qwerty qwerty|foo bar|xxx xxx"""
FAILED = """page introuvable|document not found|fichier no longer|file could not be found|resource cannot be found|url does not exist|page doesn't exist|page n'existe plus|page n'existe pas|page moved|n'existe plus ou a été déplacé|seite nicht gefunden|dokument nicht vorhanden
datei nicht verfügbar|seite existiert nicht|pagina non trovata|documento non trovato|pagina non esiste|documento non disponibile|página no encontrada|documento no existe|página no disponible|documento no se ha encontrado|access denied|permission was forbidden|forbidden
accès refusé|acces interdit|accès non autorisé|zugriff verweigert|zugriff nicht|accesso negato|accesso vietato|acceso denegado|acceso prohibido|not authorised|not authorized|unauthorised|unauthorized|session expired|session timed out|session ended|sitzung abgelaufen|sessione scaduta|sesión caducada|sesión expirada
service unavailable|server indisponible|site overloaded|site surchargé|server down for|gateway not responding|dienst nicht erreichbar|dienst nicht verfügbar|server überlastet|servizio non disponibile|servicio no disponible|internal error|server error|unexpected error|unknown server error|erreur interne|erreur inattendue
interner fehler|interner serverfehler|errore interno|errore imprevisto|error interno|error inesperado|something went wrong|an error occurred|something occurred|bad gateway|bad request|too many requests|gateway timeout|gateway time-out|request time out|request timed out|request time -out|request timeout|time out|timed out|timeout
delai d'attente dépassé|délai d’attente dépassé|zeitüberschreitung|tempo scaduto|tempo di attesa scaduto|tiempo de espera agotado|trop de requêtes|zu viele anfragen|troppe richieste|demasiadas peticiones|demasiadas solicitudes|passerelle incorrecte"""


@pytest.mark.parametrize(("texts", "grammar", "bit"), [(FILLED, residue._FILLED, 2), (FAILED, residue._ERROR, 4)])
def test_residue_gate_passes_every_alternative(texts, grammar, bit):
    for t in texts.replace("\n", "|").split("|"):
        assert grammar.search(t), t
        assert residue._needs(t) & bit, t


def test_residue_gate_passes_whole_texts():
    assert residue.residue_of("Inserire qui il contenuto.") == "filler" and residue.residue_of("La pagina richiesta non esiste.") == "error"


def test_packing(spark):
    rnd = random.Random(7)
    sizes = [(i, rnd.choice([1, 7, 30, 64, 100, 101, 250, 0])) for i in range(3000)] + [(1, 7), (5, 100_000)]
    df = spark.createDataFrame(sizes, "item bigint, size bigint").withColumn("bin_id", F.lit(1))
    out = packing.pack(df.select("item", "size"), 3, 100, 8).collect()
    assert sum(r.n_tokens for r in out) == sum(s for _, s in sizes)
    bins = {}
    for r in out:
        bins.setdefault(r.bin_id, []).append((r.bin_offset, r.n_tokens))
    for parts in bins.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 100
    whole = [r for r in out if dict(sizes).get(r.item, 0) <= 100]
    assert all(r.part == 0 and r.start_token == 0 for r in whole)
    assert len(bins) <= 1.03 * -(-sum(s for _, s in sizes) // 100) + 3 * 8
    assert sorted(map(tuple, out)) == sorted(map(tuple, packing.pack(df.select("item", "size"), 3, 100, 8).collect()))
    docs = spark.createDataFrame([(1, "Bonjour à tous"), (2, None), (3, ""), (4, "mot " * 5000), (4, "mot " * 5000)], "doc_id bigint, text string").withColumn("size", F.lit(0)).withColumn("item", F.lit(0))
    got = packing.pack_texts(docs, "doc_id", "text", 512).collect()
    e = packing.encoding(packing.TOKENIZER)
    assert {r.item for r in got} == {1, 4} and sum(r.n_tokens for r in got if r.item == 4) == 2 * len(e.encode_ordinary("mot " * 5000))
    assert packing.pack_texts(docs.limit(0), "doc_id", "text").count() == 0


def test_leaks_brute_force(spark):
    rnd = random.Random(8)
    items = [(i, " ".join(rnd.choice(WORDS[:60]) for _ in range(rnd.randint(5, 40)))) for i in range(40)] + [(900, None), (901, "")]
    docs = []
    for i in range(200):
        w = [rnd.choice(WORDS[:60]) for _ in range(80)]
        if i % 3 == 0:
            src = rnd.choice(items[:40])[1].split()
            k, n = rnd.randrange(len(src)), rnd.randint(6, 14)
            at = rnd.randrange(70)
            w[at:at] = [x.upper() + "," for x in src[k : k + n]]
        docs.append((i, " ".join(w)))
    docs += [(500, None), (501, ""), (502, "mot1 " * 60_000), (3, docs[3][1])]
    grams = lambda t: {tuple(w[i : i + 10]) for w in [normalize_py(t or "").split()] for i in range(len(w) - 9)}
    ig = {i: grams(t) for i, t in items}
    want = sorted((d, i) for d, t in docs for i, g in ig.items() if grams(t) & g)
    c = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item", F.lit(1)).withColumn("doc", F.lit(1))
    it = spark.createDataFrame(items, "item_id bigint, text string")
    assert sorted(map(tuple, leaks.leaked_items(c, "doc_id", "text", it, "item_id", "text").collect())) == want and want
    assert leaks.leaked_items(c, "doc_id", "text", it.limit(0), "item_id", "text").count() == 0
    assert leaks.leaked_items(c.limit(0), "doc_id", "text", it, "item_id", "text").count() == 0


RESIDUE = [
    ("Cher {{nom_client}}, votre règlement est attendu.", "placeholder"), ("Référence : ${importe}", "placeholder"), ("Fait à %DATE_ECHEANCE%, le 3 mai.", "placeholder"), ("Signed in [INSERT DATE HERE].", "placeholder"), ("Aktenzeichen: TT.MM.JJJJ", "placeholder"),
    ("Fait à «Civilité».", "placeholder"), ("Reference: <customer name>", "placeholder"), ("Facture\nLorem ipsum dolor sit amet.", "filler"), ("bla bla bla bla", "filler"), ("Rent receipt\nYour text goes here.", "filler"),
    ("Erreur 404\nPage introuvable.\nRetour à l'accueil", "error"), ("Facture\nVeuillez activer JavaScript pour afficher ce document.", "script"), ("503 Service momentanément indisponible", "error"),
    ("Le guide rappelle que le champ {{nom_client}} du modèle est remplacé lors du publipostage.", None), ("Le technicien note que l'écran affichait « Page introuvable » avant le remplacement du routeur.", None),
    ("Voir la note [0] et l'annexe {A} du plan, taille XXL, remise de 0 %.", None), ("La formation explique pourquoi un site demande parfois d'activer JavaScript.", None), ("```\nprint(f\"{name}\")\n```\nUn exemple de programme.", None), ("« Bonjour », dit-il @ midi #1 50 %.", None), ("", None), ("x " * 200_000, None),
]


@pytest.mark.parametrize(("text", "want"), RESIDUE)
def test_residue(text, want):
    assert residue.residue_of(text) == want


def test_residue_frames(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(RESIDUE)] + [(99, None), (0, RESIDUE[0][0])], "doc_id bigint, text string").withColumn("residue", F.lit(1)).withColumn("_t", F.lit(1))
    found = residue.find_residue(df, "doc_id", "text").collect()
    assert {r.doc_id: r.residue for r in found} == {i: k for i, (_, k) in enumerate(RESIDUE) if k} and len([r for r in found if r.doc_id == 0]) == 2
    assert residue.without_residue(df, "doc_id", "text").count() == sum(k is None for _, k in RESIDUE) + 1
    assert residue.find_residue(df.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize("name", ["p1_found", "p7_found", "p7_items"])
def test_against_sql(spark, name):
    from pathlib import Path

    from parchmint.llm import queries

    duckdb = pytest.importorskip("duckdb")
    data = Path("/root/testdata/sf0.001")
    if not data.exists():
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in ("search_docs", "documents", "eval_items"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got = queries.queries()[name](spark, str(data))
    assert sorted(map(tuple, got.collect())) == sorted(c.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()[name]})").fetchall())


def test_residue_told_from_ordinary_marks():
    plain = [
        "Il a répondu «oui» avant de partir.", "El director dijo «gracias» y salió.", "La parola «casa» è femminile.", "Il a lu «Germinal» hier soir.", "Set the variable ${HOME} to the folder.", "Open %APPDATA% and look.",
        "Press <enter> to continue.", "See [[Paris]] for more.", "The format is DD/MM/YYYY as the law demands.", "He sang bla bla bla.",
    ]
    assert [residue.residue_of(t) for t in plain] == [None] * len(plain)
    left = {"La pagina richiesta non esiste.": "error", "JavaScript is required. Please enable it.": "script", "Fait à «Civilité», le [NOM DU CLIENT].": "placeholder", "Cher «nom_client», merci.": "placeholder", "Cher [[objet]], votre lettre": "placeholder", "bla bla bla": "filler"}
    assert {t: residue.residue_of(t) for t in left} == left


@pytest.mark.parametrize("text", ["zéro six un deux trois quatre cinq six sept huit", "zero seven nine one two three four five six seven eight", "null eins sieben sechs eins zwei drei vier fünf sechs sieben", "cero cero tres cuatro seis uno dos tres cuatro cinco seis siete", "zero zero tre nove tre quattro cinque uno due tre quattro cinque sei"])
def test_spelled_phones(text):
    t = f"Call {text}, thank you"
    assert personal.find_personal(t) == [(5, 5 + len(text), "PHONE")]


@pytest.mark.parametrize(("text", "found", "kind"), [("john dot doe at example dot com", "john dot doe at example dot com", "EMAIL"), ("x jean (point) marc (point) dupont (at) example.com y", "jean (point) marc (point) dupont (at) example.com", "EMAIL"), ("Please contact John Smith.", "John Smith", "NAME"), ("Dr. Peter Jones came", "Peter Jones", "NAME"), ("at some point we met at noon", None, None)])
def test_disguised_and_uncued(text, found, kind):
    assert [(text[a:b], k) for a, b, k in personal.find_personal(text)] == ([(found, kind)] if found else [])


def test_name_cues_pass_every_phrase():
    """A text that a phrase finds has one of the phrase's cues."""
    samples = ["l'interessée, Ana Bell, a signé", "Bien à vous, Ana Bell.", "Kind regards, Ana Bell.", "mit freundlichen Grüßen Ana Bell.", "dossier suivi par Ana Bell, ligne", "à l'attention de Ana Bell.", "zu Händen von Ana Bell.", "contactez Ana Bell au", "locataire : Ana Bell.", "Eigentümer: Ana Bell.", "ayants droit : Ana Bell.", "ayants droit : Ana Bell et Bob Cox.", "au nom de Ana Bell.", "a nombre de Ana Bell.", "vu avec Ana Bell.", "clé chez Ana Bell.", "rückruf Ana Bell, 01", "call Ana Bell back", "signe par Ana Bell.", "votre interlocutrice est Ana Bell.", "per domande chiamare Ana Bell al", "llame a Ana Bell en", "Ana Bell (gérante) vous appelle"]
    for t in samples:
        hits = [k for k, p in enumerate(personal.NAMES) if p.search(t)]
        assert hits, t
        assert all(personal._name_bits(t) >> k & 1 for k in hits), t


def test_leaks_in_several_passes(spark):
    """More words of items than one pass takes, and items longer than a part, give the same."""
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdef") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(rnd.choice([12, 40, 300])))) for i in range(30)]
    docs = [(d, " ".join([word() for _ in range(20)] + (t := items[d % 30][1].split())[(k := rnd.randrange(len(t) - 11)) : k + 11] + [word()])) for d in range(60)]
    c, i = spark.createDataFrame(docs, "d bigint, text string"), spark.createDataFrame(items, "i bigint, text string")
    once = sorted(map(tuple, leaks.leaked_items(c, "d", "text", i, "i", "text").collect()))
    assert len(once) >= 60 and once == sorted(map(tuple, leaks.leaked_items(c, "d", "text", i, "i", "text", most_words=700).collect()))


def test_leaks_with_long_items(spark, monkeypatch):
    monkeypatch.setattr(leaks, "PART_WORDS", 25)
    text = " ".join(f"w{k}" for k in range(200))
    docs = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(k, k + 10))) for k in range(191)], "d bigint, text string")
    got = leaks.leaked_items(docs, "d", "text", spark.createDataFrame([(1, text)], "i bigint, text string"), "i", "text")
    assert got.distinct().count() == 191


def test_names_beyond_what_is_sent(spark, monkeypatch):
    """Towns and known words that are too many to send meet the names by key, with the same links."""
    reg = spark.createDataFrame([(1, "Boulangerie Ostvert SAS", "Weidental"), (2, "Boulangerie Corbergix SAS", "Aubrelay"), (3, "Garage Ostvert", "Mirelles")], "id bigint, name string, town string")
    names = spark.createDataFrame([("OstvertBoulangerie",), ("Boulangerie Ostvert SAS, Weidental",), ("Boul. Corbergix",), ("Garage Ostvret Mirelles",), ("Autre",)], "typed string")
    before = {r.typed: r.id for r in name_links.link_names(names, reg).collect()}
    monkeypatch.setattr(name_links, "MOST_KNOWN", 0)
    assert before and {r.typed: r.id for r in name_links.link_names(names, reg).collect()} == before


def test_names_beyond_what_is_sent_with_glued_towns(spark, monkeypatch):
    """A town that runs into the word before it is found by key as well."""
    reg = spark.createDataFrame([(1, "Garage Ostvert", "Weidental"), (2, "Garage Weidental", "Mirelles"), (3, "Papeterie Weidental Corbergix", "Aubrelay")], "id bigint, name string, town string")
    names = spark.createDataFrame([("Ostvert garageweidental",), ("x" * 3_000,)], "typed string")
    for most in (name_links.MOST_KNOWN, 0):
        monkeypatch.setattr(name_links, "MOST_KNOWN", most)
        assert [(r.typed, r.id) for r in name_links.link_names(names, reg).collect()] == [("Ostvert garageweidental", 1)]


def test_names_through_frequent_words(spark):
    """Words of more than ``FEW`` entries lead to all entries that have them, and a name that shows nothing else goes to none of them."""
    firms = ["Plomberie Dupontelli", "Plomberie Garnavere", "Plomberie Mercadaloux", "Plomberie Vassertin", "Plomberie Lombrecht SA", "Jean Martin", "Jean Ruszannac", "Jean Corbergix", "Jean Belferuera", "Paul Martin", "Hugues Martin", "Luc Martin", "Yvonne Martin"]
    reg = spark.createDataFrame([(k, n, None) for k, n in enumerate(firms)] + [(20, "Yvonne Martin", None)], "id bigint, name string, town string")
    want = {
        "Plomberie Dup.": 0, "PLOMB. Garnaverre": 1, "Plomberie, Merc.": 2, "plomberie vsstn": 3, "Jean Martin SA": 5, "martin, hug.": 10, "Yvonne Martin": 12,
        "J. Martyn": 5, "Jean Martyn": 5, "Jean": None, "Plomberie": None, "Plomberie SA": None, "J. Ru": None, "Plomberie Zorglub": None, "Plomberie Dupund": None, "Y. Martin": None,
    }
    got = {r.typed: r.id for r in name_links.link_names(spark.createDataFrame([(k,) for k in want], "typed string"), reg).collect()}
    assert got == {k: v for k, v in want.items() if v is not None}


def test_near_duplicates_with_equal_hashes(spark, monkeypatch):
    """Different sets whose names collide stay apart: with names of two values only, groups are the same."""
    rnd = random.Random(4)
    base = [" ".join(f"w{rnd.randrange(10_000)}" for _ in range(60)) for _ in range(6)]
    rows = [(f"r{k}", t) for k, t in enumerate(base + base[:2] + [base[2] + " mot"])]
    df = spark.createDataFrame(rows, "id string, t string")
    run = lambda: sorted(map(tuple, near_duplicates.near_duplicate_groups(df, "id", F.split("t", " "), n=3, threshold=0.8).collect()))
    before = run()
    monkeypatch.setattr(near_duplicates, "class_id", lambda c: F.pmod(F.xxhash64(c), F.lit(2)))
    assert len(before) == 6 and run() == before


def test_furniture_learned_from_pairs():
    """Titles and numbers of unseen documents, other firms and styles, told from body lines and lone figures by form and place."""
    rnd = random.Random(9)
    words = "le technicien propose un rendez-vous pour la chaudière de notre immeuble avant la fin du trimestre avec votre accord écrit".split()
    line = lambda: " ".join(rnd.choice(words) for _ in range(7)) + rnd.choice([".", ",", "", f" {rnd.randrange(99)}."])
    body = lambda: [*(line() for _ in range(4)), rnd.choice([line(), str(rnd.randrange(99))]), *(line() for _ in range(3))]

    def document(k: int) -> list[list[str]]:
        title = rnd.choice([f"AGENCE DU PARC {k}", f"Cabinet Lormont | {k % 28 + 1:02}/05/2024", f"Relevé R-2024-{k:04}"])
        style = rnd.choice(["- {} -", "Page {}", "{}/9", "[{}]", "p. {}"])
        return [[title, *body(), style.format(p + 1)] if k % 2 else [style.format(p + 1), title, *body()] for p in range(3)]

    learned = scan_noise.Furniture([document(k) for k in range(120)])
    assert learned.titles is not None and learned.numbers is not None
    right = total = 0
    for k in range(500, 560):
        for lines in document(k):
            top = k % 2 == 0
            number, title = (0, 1) if top else (len(lines) - 1, 0)
            said = learned.title([scan_noise.title_features(lines, i) for i in range(len(lines))])
            right += bool(said[title]) + sum(not said[i] for i in range(3, 7))
            right += bool(learned.number([scan_noise.number_features(lines, number)])[0]) + (not learned.number([scan_noise.number_features([*lines[:4], "12", *lines[4:]], 4)])[0])
            total += 7
    assert right >= 0.95 * total, (right, total)
