"""Dates, amounts, invoices, kinds, titles and tags found in text. Columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parchmint.functions.text import normalize

# Kinds, their labels, and the words that speak for them; the first word is the kind's own name.
KINDS = {
    "facture": ("Facture", ["facture", "invoice", "factura", "rechnung", "fattura", "montant ttc", "total ttc", "net a payer", "date d echeance", "tva intracommunautaire"]),
    "recu": ("Reçu", ["recu", "ticket", "receipt", "caisse", "carte bancaire", "cb", "merci de votre visite", "rendu", "quittung", "scontrino", "ticket de caisse"]),
    "devis": ("Devis", ["devis", "quotation", "quote", "presupuesto", "angebot", "preventivo", "bon pour accord", "validite de l offre"]),
    "contrat": ("Contrat", ["contrat", "contract", "contrato", "vertrag", "contratto", "entre les soussignes", "article 1", "il a ete convenu", "fait en deux exemplaires", "signature"]),
    "releve": ("Relevé", ["releve de compte", "releve", "statement", "solde", "extracto", "kontoauszug", "estratto conto", "iban", "bic", "operations"]),
    "fiche-de-paie": ("Fiche de paie", ["bulletin de paie", "bulletin de salaire", "fiche de paie", "salaire brut", "net a payer avant impot", "cotisations", "payslip"]),
    "ordonnance": ("Ordonnance", ["ordonnance", "prescription", "posologie", "docteur", "dr", "medecin", "pharmacie", "comprime", "receta"]),
    "identite": ("Pièce d'identité", ["carte nationale d identite", "passeport", "passport", "permis de conduire", "date de naissance", "nationalite", "identity card"]),
    "courrier": ("Courrier", ["madame", "monsieur", "objet", "veuillez agreer", "cordialement", "salutations distinguees", "dear", "sincerely"]),
    "impots": ("Impôts", ["avis d imposition", "impots", "impot sur le revenu", "direction generale des finances publiques", "numero fiscal", "taxe fonciere", "taxe d habitation"]),
}
KIND_THRESHOLD, OWN_NAME, MOST_COUNTED = 4, 3, 3
# Month names and short forms in five languages, unaccented, by month.
MONTHS = {
    1: ["janvier", "janv", "jan", "january", "enero", "januar", "gennaio"],
    2: ["fevrier", "fev", "feb", "february", "febrero", "februar", "febbraio"],
    3: ["mars", "mar", "march", "marzo", "marz"],
    4: ["avril", "avr", "apr", "april", "abril", "aprile"],
    5: ["mai", "may", "mayo", "maggio"],
    6: ["juin", "jun", "june", "junio", "juni", "giugno"],
    7: ["juillet", "juil", "jul", "july", "julio", "juli", "luglio"],
    8: ["aout", "aug", "august", "agosto"],
    9: ["septembre", "sept", "sep", "september", "septiembre", "settembre"],
    10: ["octobre", "oct", "october", "octubre", "oktober", "ottobre"],
    11: ["novembre", "nov", "november", "noviembre"],
    12: ["decembre", "dec", "december", "diciembre", "dezember", "dicembre"],
}
_MONTH = {w: k for k, names in MONTHS.items() for w in names}
# Patterns of dates by signs, of ISO dates, of dates with a month's name (on unaccented lower case), of amounts, of the number
# of an invoice, of legal forms, of a name behind the document's word, and of lines in capitals that are no name.
DATE_BY_SIGNS = r"(?<![A-Za-z0-9_])(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})(?![A-Za-z0-9_])"
DATE_ISO = r"(?<![A-Za-z0-9_])(20\d{2}|19\d{2})-(\d{1,2})-(\d{1,2})(?![A-Za-z0-9_])"
DATE_BY_NAME = r"(?<![a-z0-9_])(\d{1,2})(?:er)?\.?\s+([a-z]{3,9})\.?\s+(\d{4})(?![a-z0-9_])"
_AMOUNT = r"(-?\d{1,3}(?:[\s  .,']\d{3})*(?:[.,]\d{1,2})?|-?\d+(?:[.,]\d{1,2})?)"
INVOICE_NUMBER = r"(?i)(?:facture|invoice|factura|rechnung|fattura|re[cç]u|ticket)\s*(?:n[°o.º]*|no\.?|num(?:ero|éro)?\.?|#|nr\.?)\s*:?\s*([A-Z0-9][A-Z0-9\-/_.]{2,24})"
LEGAL_FORMS = r"(?i)(?<![a-z0-9_])(sas|sasu|sarl|eurl|sa|sci|snc|gmbh|ag|ltd|limited|inc|llc|s\.?p\.?a|s\.?r\.?l|s\.?l|bv|nv)(?![a-z0-9_])\.?"
_HEAD = r"(?i)^(?:facture|invoice|factura|rechnung|fattura|re[cç]u|ticket)\s+(?!n[°o.º]|no\b|num|du\b|de\b|d['’])([A-Z][A-Za-z0-9&.'’ -]{1,30})$"
_NOISE = r"(?i)^(facture|invoice|re[cç]u|ticket|devis|date|page|client|tel|t[ée]l[ée]phone|adresse|www\.|http)"
_PLAIN = r"[̀-ͯ]"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def parse_amount(s: Column) -> Column:
    """The number that an amount is written for: the last of comma and point is the decimal mark; cents; null where none."""
    t = F.regexp_replace(s, r"[\s  ']", "")
    comma, dot = F.length(t) - F.locate(",", F.reverse(t)), F.length(t) - F.locate(".", F.reverse(t))
    has_comma, has_dot = F.contains(t, F.lit(",")), F.contains(t, F.lit("."))
    decimal_comma = has_comma & (~has_dot | (comma > dot))
    plain = F.when(decimal_comma, F.regexp_replace(F.replace(t, F.lit("."), F.lit("")), ",", ".")).otherwise(F.replace(t, F.lit(","), F.lit("")))
    ok = plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return F.when(ok, F.floor(plain.cast("double") * 100 + 0.5) / 100)


def unaccented(text: Column) -> Column:
    """Without accents but with case and punctuation, one character for each (ligatures stay)."""
    from parchmint.functions.text import _FROM
    import unicodedata

    base = "".join(next(x for x in unicodedata.normalize("NFD", c) if not "̀" <= x <= "ͯ") for c in _FROM)
    return F.regexp_replace(F.translate(text, _FROM, base), _PLAIN, "")


def _iso(y: Column, m: Column, d: Column) -> Column:
    return F.concat_ws("-", y.cast("string"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))


def find_date(text: Column) -> Column:
    """The first plausible date as ISO text: year-month-day (the first one only), day/month/year, or with a month's name.

    Plausible is month 1 to 12, day 1 to 31, year 1990 to 2100; the day isn't checked against the month. Null where none.
    """
    low = F.lower(unaccented(text))
    hit, iso, named = DATE_BY_SIGNS, DATE_ISO, DATE_BY_NAME
    months = F.create_map(*[F.lit(x) for kv in _MONTH.items() for x in kv])

    def first(source: Column, found: Column, read) -> Column:
        """The first plausible of the found dates, as struct of its place, year, month and day."""
        dates = F.transform(found, lambda x: let(read(x), lambda v: F.struct(x.alias("t"), v["y"].alias("y"), v["m"].alias("m"), v["d"].alias("d"))))
        good = F.get(F.filter(dates, lambda c: c["m"].between(1, 12) & c["d"].between(1, 31) & c["y"].between(1990, 2100)), F.lit(0))
        return let(good, lambda c: F.when(c.isNotNull(), F.struct(F.instr(source, c["t"]).alias("idx"), c["y"].alias("y"), c["m"].alias("m"), c["d"].alias("d"))))

    def ymd(y: Column, m: Column, d: Column) -> Column:
        return F.struct(y.alias("y"), m.alias("m"), d.alias("d"))

    def by_signs(order: tuple[int, int, int]):
        def read(x: Column) -> Column:
            return let(F.transform(F.split(x, "[/.-]"), lambda p: p.cast("int")), lambda p: ymd(F.when((p[order[0]] < 100), p[order[0]] + 2000).otherwise(p[order[0]]), p[order[1]], p[order[2]]))

        return read

    def by_name(x: Column) -> Column:
        return ymd(F.regexp_extract(x, named, 3).cast("int"), months[F.regexp_extract(x, named, 2)], F.regexp_extract(x, named, 1).cast("int"))

    every = lambda source, p: F.regexp_extract_all(source, F.lit(p), F.lit(0))
    firsts = F.array(
        first(text, F.filter(F.array(F.regexp_extract(text, iso, 0)), lambda x: x != ""), by_signs((0, 1, 2))),
        first(text, every(text, hit), by_signs((2, 1, 0))),
        let(low, lambda t: first(t, every(t, named), by_name)),
    )
    return let(F.array_min(firsts), lambda best: F.when(best.isNotNull(), _iso(best["y"], best["m"], best["d"])))


def amount_after(text: Column, labels: str) -> Column:
    """The last readable amount that follows one of the labels within 40 characters of its line."""
    pattern = rf"(?i)(?:{labels})[^\d\n-]{{0,40}}?{_AMOUNT}"
    return F.try_element_at(F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), parse_amount)), F.lit(-1))


# Labels of totals, net amounts and taxes, on unaccented text.
_S = r"[\s ]*"
TTC = rf"total{_S}ttc|montant{_S}ttc|net{_S}a{_S}payer|total{_S}a{_S}payer|total{_S}du|montant{_S}du|amount{_S}due|grand{_S}total|total{_S}eur|gesamtbetrag|totale"
HT = rf"total{_S}ht|montant{_S}ht|sous[-\s]?total|subtotal|net{_S}amount|total{_S}hors{_S}taxes?|zwischensumme|imponibile"
VAT = rf"(?:montant{_S})?t\.?v\.?a\.?(?:{_S}\(?\d{{1,2}}(?:[.,]\d+)?{_S}%\)?)?|\bvat\b|mwst|\biva\b"


def currency(text: Column) -> Column:
    """EUR, USD, GBP or CHF by the first of their signs in this order; null where none."""
    w = lambda p: rf"(?i)(?<![a-z0-9_])(?:{p})(?![a-z0-9_])"
    return F.when(text.rlike("€|" + w("eur(?:os?)?")), "EUR").when(text.rlike(r"\$|" + w("usd")), "USD").when(text.rlike("£|" + w("gbp")), "GBP").when(text.rlike(w("chf")), "CHF")


def invoice_number(text: Column) -> Column:
    """3 to 25 characters after the document's word, without a full stop at their end; null where none."""
    n = F.regexp_extract(text, INVOICE_NUMBER, 1)
    return F.when(n != "", F.regexp_replace(n, r"\.$", ""))


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: F.trim(x))


def find_company(text: Column) -> Column:
    """A name after the document's word in the head, else a line with a legal form, else a line in capitals near the top."""
    lines = F.filter(_lines(text), lambda x: F.length(x).between(2, 60))
    named = F.get(F.filter(F.transform(F.slice(lines, 1, 6), lambda x: F.regexp_extract(x, _HEAD, 1)), lambda x: x.rlike("[A-Z]{2,}")), F.lit(0))
    legal = F.get(F.filter(lines, lambda x: x.rlike(LEGAL_FORMS) & x.rlike("(?i)[a-z]")), F.lit(0))
    upper = F.get(F.filter(F.slice(lines, 1, 8), lambda x: x.rlike(r"^[A-Z0-9&'’ .-]{2,40}$") & x.rlike("[A-Z]{2,}") & ~x.rlike(_NOISE)), F.lit(0))
    return F.coalesce(F.trim(named), F.regexp_replace(legal, r"\s{2,}", " "), upper)


def invoice_data(text: Column) -> Column:
    """Struct of company, number, date, total_ht, vat, total_ttc, currency; parts that aren't found are null.

    A tax equal to the total is dropped; one that is missing is the positive difference of the totals.
    """
    plain = unaccented(text)
    ttc = F.coalesce(amount_after(plain, TTC), amount_after(plain, r"\btotal\b"))
    ht = amount_after(plain, HT)
    vat = amount_after(plain, VAT)
    vat = F.when(vat.isNotNull() & (ttc.isNull() | (vat != ttc)), vat)
    rest = F.floor((ttc - ht) * 100 + 0.5) / 100
    vat = F.coalesce(vat, F.when(rest > 0, rest))
    return F.struct(find_company(text).alias("company"), invoice_number(text).alias("number"), find_date(text).alias("date"), ht.alias("total_ht"), vat.alias("vat"), ttc.alias("total_ttc"), currency(text).alias("currency"))


def kind_scores(text: Column) -> Column:
    """Scores in the order of ``KINDS``: every word counts up to three times, phrases double; 3 more where a head line begins with the kind's name.

    Words are counted between spaces; every space of the text is doubled, so neighbours don't share one. The words are one
    literal array, so the expression stays small.
    """
    words = [w for _, ws in KINDS.values() for w in ws]
    table = F.array(*[F.lit(f" {w.replace(' ', '  ')} ") for w in words])
    weight = F.array(*[F.lit(2 if " " in w else 1) for w in words])
    first = [0]
    for _, ws in KINDS.values():
        first.append(first[-1] + len(ws))
    own = F.array(*[F.lit(ws[0]) for _, ws in KINDS.values()])
    bounds = F.array(*[F.lit(i) for i in first])
    n = F.replace(F.concat(F.lit(" "), F.coalesce(normalize(text), F.lit("")), F.lit(" ")), F.lit(" "), F.lit("  "))
    head = F.transform(F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, 8), lambda x: normalize(x))
    counts = let(n, lambda t: F.transform(table, lambda w, i: F.least(F.lit(MOST_COUNTED), ((F.octet_length(t) - F.octet_length(F.replace(t, w, F.lit("")))) / F.length(w)).cast("int")) * F.get(weight, i)))

    def score(b: Column):
        def one(name: Column, k: Column) -> Column:
            part = F.slice(b["counts"], F.get(bounds, k) + 1, F.get(bounds, k + 1) - F.get(bounds, k))
            named = F.exists(b["head"], lambda x: (x == name) | F.startswith(x, F.concat(name, F.lit(" "))))
            return F.aggregate(part, F.lit(0), lambda s, v: s + v) + F.when(named, OWN_NAME).otherwise(0)

        return F.transform(own, one)

    return let(F.struct(counts.alias("counts"), head.alias("head")), score)


def classify(text: Column) -> Column:
    """The kind with the greatest score of at least 4, the first in the table's order on ties; null where none."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return let(kind_scores(text), lambda s: F.when(F.array_max(s) >= KIND_THRESHOLD, F.get(names, F.array_position(s, F.array_max(s)).cast("int") - 1)))


def kind_label(kind: Column) -> Column:
    k = F.when(kind.isNull(), F.lit(None).cast("string"))
    for name, (label, _) in KINDS.items():
        k = k.when(kind == name, label)
    return k


def title_case(s: Column) -> Column:
    """Words of more than four letters in title case, where all is in capitals; short ones are acronyms and stay."""
    cased = F.array_join(F.transform(F.regexp_extract_all(s, F.lit(r"[^\s-]+|[\s-]+"), F.lit(0)), lambda w: F.when(F.length(w) <= 4, w).otherwise(F.concat(F.substring(w, 1, 1), F.lower(F.substring(w, 2, 1000))))), "")
    return F.when(s != F.upper(s), s).otherwise(cased)


def suggest_title(text: Column, kind: Column, invoice: Column | None = None) -> Column:
    """Kind, company and date joined by dashes if there are two of them (80 characters), else the first line with a word (60)."""
    company = F.coalesce(invoice["company"], find_company(text)) if invoice is not None else find_company(text)
    date = F.coalesce(invoice["date"], find_date(text)) if invoice is not None else find_date(text)
    parts = F.array_compact(F.array(kind_label(kind), F.when(kind.isNotNull(), title_case(company)), F.when(kind.isNotNull(), date)))
    first = F.get(F.filter(_lines(text), lambda x: (F.length(x) >= 4) & x.rlike(r"\p{L}{3,}")), F.lit(0))
    return F.when(F.size(parts) >= 2, F.substring(F.array_join(parts, " — "), 1, 80)).otherwise(F.substring(first, 1, 60))


def suggest_tags(text: Column, kind: Column, invoice: Column | None = None) -> Column:
    """Kind, company without its legal form (two words, 2 to 24 characters) and year, lower case, each once."""
    company = F.coalesce(invoice["company"], F.when(kind.isNotNull(), find_company(text))) if invoice is not None else F.when(kind.isNotNull(), find_company(text))
    short = F.array_join(F.slice(F.split(F.trim(F.regexp_replace(company, LEGAL_FORMS, "")), r"\s+"), 1, 2), " ")
    date = F.coalesce(invoice["date"], find_date(text)) if invoice is not None else find_date(text)
    return F.array_distinct(F.array_compact(F.array(F.lower(kind_label(kind)), F.when(F.length(short).between(2, 24), F.lower(short)), F.substring(date, 1, 4))))


# -- names of files ---------------------------------------------------------------------------------------------------------
_DEVICES = r"(?i)^(con|prn|aux|nul|com\d|lpt\d)$"


def sanitize_file_name(name: Column, fallback: str = "document") -> Column:
    """The last part of a path without control and reserved characters, leading dots or device names, 120 characters at most."""
    s = F.try_element_at(F.split(name, r"[\\/]"), F.lit(-1))
    s = F.regexp_replace(s, r"[\u0000-\u001f\u007f<>:\"|?*]", " ")
    s = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(s, r"[\s ]+", " ")), r"^\.+", ""), r"[. ]+$", "")
    base = F.when(F.locate(".", s) > 1, F.regexp_replace(s, r"\.[^.]*$", "")).otherwise(s)
    s = F.substring(F.when(base.rlike(_DEVICES), F.concat(F.lit("_"), s)).otherwise(s), 1, 120)
    return F.when(F.length(s) > 0, s).otherwise(fallback)


def export_file_name(title: Column, extension: str) -> Column:
    return F.concat(F.regexp_replace(sanitize_file_name(title), r"(?i)\.(pdf|jpe?g|png|txt|docx|zip)$", ""), F.lit("." + extension))


def extension(name: Column) -> Column:
    """What follows the last point, lower case; empty where there is none."""
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def base_name(name: Column) -> Column:
    s = sanitize_file_name(name)
    return F.when(F.locate(".", s) > 1, F.regexp_replace(s, r"\.[^.]*$", "")).otherwise(s)


def is_safe_zip_path(name: Column) -> Column:
    """Neither empty nor absolute, no drive, no backslash, no part that leads upwards."""
    return (F.length(name) > 0) & ~name.rlike(r"^/|^[A-Za-z]:|\\|(^|/)\.\.(/|$)")


def format_bytes(n: Column) -> Column:
    """Size for people: o, Ko without decimals, Mo with one, Go with two, with a decimal comma."""
    v = n.cast("double")
    return (
        F.when(v < 1024, F.format_string("%d o", n.cast("bigint")))
        .when(v < 1024**2, F.concat(F.floor(v / 1024 + 0.5).cast("string"), F.lit(" Ko")))
        .when(v < 1024**3, F.replace(F.format_string("%.1f Mo", v / 1024**2), F.lit("."), F.lit(",")))
        .otherwise(F.replace(F.format_string("%.2f Go", v / 1024**3), F.lit("."), F.lit(",")))
    )


def word_count(text: Column) -> Column:
    t = F.trim(F.regexp_replace(text, r"[\s ]+", " "))
    return F.when(F.length(t) > 0, F.size(F.split(t, " "))).otherwise(0)



def is_default_title(title: Column) -> Column:
    """A generic word with figures or punctuation only, or a scan's date title: a title that may be replaced."""
    return F.trim(title).rlike(r"(?i)^(scan|document|import|numérisation|page)\b[\s\d:/.,h-]*$") | title.startswith("Scan du ")
