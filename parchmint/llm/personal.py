"""Personal information in free text: found by offset-preserving deobfuscation, replaced by typed placeholders.

Transducers rewrite what disguises an identifier (look-alike letters, invisible characters, written-out at and dot, spelled
digits, words cut at a line end, letters read for digits) and keep, for every character they emit, the place it came from. The
detectors run on the rewritten text; a find is mapped back through these places to the characters of the source.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.operators.current import current_rows
from parchmint.session import cut_lineage

# Cyrillic and Greek letters drawn like Latin ones.
_ALIKE = dict(zip("аеорсухіјѕԁɡһοανικΑΒΕΖΗΙΚΜΝΟΡΤΥΧАВЕКМНОРСТХІЈЅ", "aeopcyxijsdghoaviкABEZHIKMNOPTYXABEKMHOPCTXIJS".replace("к", "k")))
# Digits spelled out in five languages.
_SPELLED = {
    "zéro": "0", "zero": "0", "null": "0", "cero": "0", "un": "1", "one": "1", "eins": "1", "uno": "1", "deux": "2", "two": "2", "zwei": "2", "zwo": "2", "due": "2", "dos": "2", "trois": "3", "three": "3", "drei": "3", "tre": "3", "tres": "3",
    "quatre": "4", "four": "4", "vier": "4", "quattro": "4", "cuatro": "4", "cinq": "5", "five": "5", "fünf": "5", "cinque": "5", "cinco": "5", "six": "6", "sechs": "6", "sei": "6", "seis": "6", "sept": "7", "seven": "7", "sieben": "7", "sette": "7", "siete": "7",
    "huit": "8", "eight": "8", "acht": "8", "otto": "8", "ocho": "8", "neuf": "9", "nine": "9", "neun": "9", "nove": "9", "nueve": "9",
}
_AT = r"(?:at|arobase|arobas|chiocciola|arroba|klammeraffe|ät)"
_DOT = r"(?:dot|point|punto|punkt)"
_DIGIT = "|".join(sorted(_SPELLED, key=len, reverse=True))

_OPEN, _SHUT = r"\s*[(\[{<]?\s*", r"\s*[)\]}>]?\s*"


def _spelled_run(m: re.Match) -> list[tuple[int, int, str]]:
    """Spelled digits as figures; single figures close up, so that they read as one number. A run of figures alone stays."""
    units = list(re.finditer(r"[^\W\d_]+|\d+", m.group()))
    if not any(u.group()[0].isalpha() for u in units):
        return []
    edits, at = [], None
    for u in units:
        start, end = m.start() + u.start(), m.start() + u.end()
        if at is not None and len(u.group()) * (not u.group().isdigit() or len(u.group()) == 1) and at[1]:
            edits.append((at[0], start, ""))
        if u.group()[0].isalpha():
            edits.append((start, end, _SPELLED.get(u.group().lower(), u.group())))
        at = (end, not u.group().isdigit() or len(u.group()) == 1)
    return edits


# (what must be there, what to look for, what to put there): a function gets the match and may return several edits (start, end, text).
_RULES: list[tuple[re.Pattern, re.Pattern, object]] = [
    (re.compile(r"[-‐‑¬\u00ad]\n"), re.compile(r"(?<=[^\W_])[-‐‑¬\u00ad]\n(?=[^\W_])"), lambda m: "" if m.string[m.end()].islower() else "-"),
    (_INVISIBLE := re.compile("[\u200b-\u200f\u2060\ufeff\u00ad]"), _INVISIBLE, ""),
    (_LOOKS := re.compile("[" + "".join(_ALIKE) + "！-～]"), _LOOKS, lambda m: _ALIKE.get(m.group(), unicodedata.normalize("NFKC", m.group()))),
    (
        _ATS := re.compile(rf"\b(?:{_AT})\b|@\s|\s@|[(\[{{<]\s*@", re.I),
        re.compile(rf"(?<=\w)(?:\s+|{_OPEN}(?<![a-z])){_DOT}(?![a-z]){_SHUT}(?=[\w-]+(?:(?:\s+|{_OPEN}){_DOT}(?:\s+|{_SHUT})[\w-]+)*(?:\s*[(\[{{<]\s*(?:{_AT}|@)\s*[)\]}}>]\s*|\s+{_AT}\s+)[\w-]+\s*[(\[{{<]?\s*(?:\.|{_DOT}\b))", re.I),
        lambda m: ".",
    ),
    (_ATS, re.compile(rf"(?<=[\w.+-])\s*[(\[{{<]\s*(?:{_AT}|@)\s*[)\]}}>]\s*(?=[\w-]+(?:\.|\s*[(\[{{<]?\s*{_DOT}\b))", re.I), "@"),
    (_ATS, re.compile(rf"(?<=[\w.+-])\s+(?:{_AT})\s+(?=[\w-]+\s*[(\[{{<]?\s*(?:\.|{_DOT})\s*[)\]}}>]?\s*[a-z]{{2,}})", re.I), "@"),
    (_ATS, re.compile(r"(?<=[\w+-])(?:\s+@\s*|\s*@\s+)(?=[\w-]+(?:\.[\w-]+)*\.[a-z]{2,})", re.I), "@"),
    (re.compile("@"), re.compile(rf"(?<=@)((?:[\w-]+\.)*[\w-]+)\s*[(\[{{<]?\s*(?<![a-z]){_DOT}(?![a-z])\s*[)\]}}>]?\s*(?=[a-z])", re.I), lambda m: m.group(1) + "."),
    (re.compile(rf"(?:\b(?:{_DIGIT})\b[\s.,-]+){{3}}", re.I), re.compile(rf"(?<![^\W_])(?:(?:{_DIGIT}|\d+)[\s.,-]+){{6,}}(?:{_DIGIT}|\d+)(?![^\W_])", re.I), _spelled_run),
]


class Mapped:
    """A text and, for runs of its characters, where they stand in the source.

    A run is (first character, its place, None) where the characters are those of the source, or (first character,
    place, end) where all of them stand for the source between place and end.
    """

    __slots__ = ("text", "starts", "runs")

    def __init__(self, text: str):
        self.text, self.starts, self.runs = text, [0], [(0, 0, None)]

    def place(self, i: int) -> int:
        """Source position of character ``i``."""
        start, place, end = self.runs[bisect_right(self.starts, i) - 1]
        return place + i - start if end is None else place

    def end(self, i: int) -> int:
        """Source position behind character ``i``."""
        start, place, end = self.runs[bisect_right(self.starts, i) - 1]
        return place + i - start + 1 if end is None else end

    def apply(self, rule: re.Pattern, out: object) -> None:
        """Rewrite all matches; what a rule emits stands for what it replaced, and the rest keeps its own places."""
        edits: list[tuple[int, int, str]] = []
        for m in rule.finditer(self.text):
            new = out(m) if callable(out) else out
            edits += [(*m.span(), new)] if isinstance(new, str) else new
        edits = [e for e in edits if self.text[e[0] : e[1]] != e[2]]
        if not edits:
            return
        pieces, runs, at, n = [], [], 0, 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            while new and a < b and self.text[a] == new[0]:  # what stays as it is keeps its place
                a, new = a + 1, new[1:]
            if a > at:
                runs += self._between(at, a, n)
                pieces.append(self.text[at:a])
                n += a - at
            if new:
                runs.append((n, self.place(a), self.end(max(a, b - 1))))
                pieces.append(new)
                n += len(new)
            at = b
        self.text = "".join(pieces)
        self.runs = runs or [(0, 0, None)]
        self.starts = [r[0] for r in self.runs]

    def _between(self, a: int, b: int, n: int) -> list[tuple]:
        """The runs of characters ``a`` to ``b``, moved to begin at ``n``."""
        out = []
        for k in range(bisect_right(self.starts, a) - 1, len(self.runs)):
            start, place, end = self.runs[k]
            if start >= b:
                break
            s = max(a, start)
            out.append((n + s - a, place + s - start if end is None else place, end))
        return out


def deobfuscate(text: str) -> Mapped:
    m = Mapped(text)
    last, yes = None, False
    for needs, rule, out in _RULES:
        if needs is not last:
            last, yes = needs, needs.search(m.text)
        if yes:
            m.apply(rule, out)
    return m


def _loose(p: str) -> str:
    """A pattern that also takes its accented letters without accents (outside brackets) and any white space for a space."""
    p = re.sub(r"[à-ÿ](?![^\[]*\])", lambda m: f"(?:{m.group()}|{'ss' if m.group() == 'ß' else unicodedata.normalize('NFD', m.group())[0]})", p)
    return re.sub(r"(?<!\[) ", "[ \\\\n]+", p)


# -- detectors -----------------------------------------------------------------------------------------------------------
_S = r"[   \n]"
EMAIL = re.compile(r"(?<![\w.+-])[\w](?:[\w+-]|\.(?=[\w])){0,63}@(?:[\w-]+\.)+[a-z]{2,}(?![\w])", re.I)
_D = r"[\dOoIlSB]"
_G = rf"[   \n./-]?"
PHONE = re.compile(
    rf"(?<![\w/.-])(?<!\d[ ])(?:"
    rf"(?:(?:\+|00)33{_G}(?:\(0\){_S}?)?[1-9]|[0O][1-9])(?:{_G}{_D}{{2}}){{4}}"  # France
    rf"|(?:(?:\+|00)44{_G}(?:\(0\){_S}?)?|[0O])[71]{_D}{{3}}{_G}{_D}{{3}}{_G}{_D}{{3}}|\([0O][71]{_D}{{3}}\){_G}{_D}{{3}}{_G}{_D}{{3}}"  # Britain
    rf"|(?:(?:\+|00)44{_G}(?:\(0\){_S}?)?|[0O])2{_D}{_G}{_D}{{4}}{_G}{_D}{{4}}|\([0O]2{_D}\){_G}{_D}{{4}}{_G}{_D}{{4}}"
    rf"|(?:(?:\+|00)49{_G}(?:\(0\){_S}?)?|[0O])(?:1[5-7]\d|30|40|69|89|[2-9]\d{{2,3}})[  \n/-]?{_D}{{4,8}}(?:[  \n-]{_D}{{2,4}})?"  # Germany
    rf"|(?:\+?1[ .\n-])?(?:\({_D}{{3}}\){_S}?|(?<=1[ .\n-]){_D}{{3}}[ .\n-]){_D}{{3}}[ .\n-]{_D}{{4}}"  # North America
    rf"|(?:(?:\+|00)34{_G})[6-9]\d{{2}}(?:{_G}\d{{2,3}}){{2,3}}"
    rf"|(?:(?:\+|00)39{_G})\d{{2,3}}(?:{_G}\d{{2,4}}){{2,3}}"
    rf"|(?:\+|00)(?!33|44|49|39|34)[1-9]\d{{0,2}}(?:[ .\n/-]?\(?\d{{2,5}}\)?){{2,5}}"
    rf")(?![\w])",
)
_CUE_ID = r"(?:sécurité sociale|s[ée]cu\b|n°? ?ss\b|identit[ée]|identity|cni\b|ausweis\w*|identidad|d'identità|passe?po?r?t\w*|pasaporte|reisepass|dni\b|nie\b|national insurance|ni number|steuer\w*|codice fiscale|tax (?:number|id)|documento|document shown|proof of)"
ID_STRONG = re.compile(
    rf"(?<![\w/.-])(?:[12]{_S}?\d{{2}}{_S}?\d{{2}}{_S}?(?:\d{{2}}|2[AB]){_S}?\d{{3}}{_S}?\d{{3}}(?:{_S}?\d{{2}})?"  # social security, with its key or without
    rf"|[A-Z]{{2}}(?:\d{{6}}|-\d{{6}}-|(?:{_S}\d{{2}}){{3}}{_S})[A-D]"  # national insurance
    rf"|[A-Z]{{3}}{_S}?[A-Z]{{3}}{_S}?\d{{2}}[A-EHLMPRST]\d{{2}}{_S}?[A-Z]\d{{3}}[A-Z]"  # codice fiscale
    rf"|[XYZ][ -]?\d{{7}}[ -]?[A-Z]|\d{{2}}\.\d{{3}}\.\d{{3}}-?[A-Z]|\d{{8}}-?[A-Z]"  # NIE, DNI
    rf"|\d{{2}}[ ]?[A-Z]{{2}}[ ]?\d{{5}}"  # French passport
    rf"|[A-Z]\d[A-Z]\d{{2}}[A-Z]{{2}}\d{{2}})(?![\w-])",
    re.I,
)
ID_CUED = re.compile(rf"(?<!\w){_loose(_CUE_ID)}[^\d\n]{{0,22}}?\n?[^\d\n]{{0,12}}?(?<![\w/.-])(?P<n>[A-Z]{{0,3}}-?\d[\dA-Z]*(?:[ .-]?[A-Z]{{0,2}}\d[\dA-Z]*)*(?:[ -]?[A-Z]\b)?)(?![\w])", re.I)
_NOT_ID = re.compile(r"(?:siret|siren|rcs|article|artículo|articolo|artikel\w*|commande|order|pedido|ordine|bestellnummer|company|handelsregister|registro|parcel|colis|facture|invoice|compteur|meter|contador|contatore|zähler)[^\w;\n.]*(?:\w+[^\w;\n.]+){0,2}$", re.I)

_POST = r"\d{5}|[A-Z]{1,2}\d{1,2}[A-Z]?[ \n]?\d[A-Z]{2}"
ADDRESS = [
    re.compile(r"(?<![\w/-])\d{1,4}(?:[ \n]?(?:bis|ter|quater)\b|[a-d]\b)?,?[ \n](?:rue|avenue|av\.|av\b|ave\b|bd\.?|boulevard|boul\.|impasse|imp\.|all[ée]es?|all\.|chemin|ch\.|place|pl\.|quai|route|rte\.?|cours|square|passage|sentier|villa|ruelle|faubourg)[ \n](?=[^\W\d])[^,\n–\d]{2,32}(?:\n[^,\n–\d]{2,24})?", re.I),
    re.compile(r"(?<![\w/-])\d{1,4}[a-d]?,?[ \n](?:[^\W\d_][\w'’]+[ \n]){1,3}(?:road|rd|street|st|lane|ln|avenue|ave|close|way|drive|crescent|terrace|court|grove|gardens|place|square|row|mews|hill)\b\.?", re.I),
    re.compile(r"(?<![\w-])(?:(?:am|an|der|alte|alter|neue|neuer)[ \n])?[^\W\d_][\w]*(?:[ -](?=[A-ZÄÖÜ]))?(?:stra(?:ß|ss|s)e|str\.|weg|gasse|allee|ring|damm|ufer|platz|steig|zeile)[ \n]\d{1,4}[ ]?[a-h]?\b(?=,?[ \n–-]*\d{5})", re.I),
    re.compile(r"(?<![\w-])(?:via|viale|v\.le|piazza|p\.zza|corso|c\.so|vicolo|largo|strada|piazzale|lungarno)[ \n](?=[^\W\d])[^,\d]{2,32}?,?[ \n]\d{1,4}(?:[ ]?/[ ]?[a-z]|[a-z]\b)?(?=,?[ \n])", re.I),
    re.compile(r"(?<![\w-])(?:calle|c/|c\.|avda\.?|avenida|av\.|plaza|pza\.?|pl\.|paseo|p\.º|camino|cno\.|ronda|travesía|carretera|ctra\.)[ \n](?=[^\W\d])[^,\d]{2,32}?,?[ \n](?:n\.?º[ ]?)?\d{1,4}\b(?=,?[ \n])", re.I),
]
_AFTER = re.compile(rf"(?:,?[ \n](?:int\.?|interno|bajo|entlo\.?|ático|piso|apt\.?|flat|appt\.?|bât\.?)[ \n]?[\w.º]*|,?[ \n]\d{{1,2}}\.?º[ \n]?[a-z]\b)?(?:\s*[,–-]?\s*(?:{_POST})[ \n][^\W\d_][\w'’-]+(?:[ -](?-i:[A-ZÀ-Þ][\w'’-]+))?|,?[ \n](?-i:[A-ZÀ-Þ])[\w'’-]+(?:[ ](?-i:[A-ZÀ-Þ])[\w'’-]+)?,?[ \n](?:{_POST}))?", re.I)
_NOT_STREET = re.compile(r"\b(?:du|le|la|les|the|der|die|den|el|il|lo|un|une|mois|jours|months|days)\b", re.I)

_TITLE = r"(?:monsieur|madame|mademoiselle|mme\.?|mlle\.?|m\.|mr\.?|mrs\.?|ms\.?|miss|herrn?|frau|sra\.?|srta\.?|sr\.?|señora?|signora?|sig\.ra|sig\.na|sig\.)"
# Words that come after a name and a comma without belonging to it.
_PLACE = r"ligne|línea|linea|durchwahl|direct|directe|bâtiment|second|hinterhaus|vorderhaus|segundo|secondo|primer|primo|premier|scala|floor|living|residing|demeurant|domicilié\w*|résidant|wohnhaft|residente|con|ok|a|has|ha|hat|né|née|nato|nata|born|geboren|rue|avenue|av|bd|place|impasse|allée|chemin|calle|c|avda|plaza|via|viale|piazza|escalier|escalera|on|au|al|unter|for|für|y|et|and|und|e|tél|tel|poste"
_W = r"[^\W\d_][\w'’]*(?:-[^\W\d_][\w'’]*)*"
# surname, given name | up to three words, of which initials may have a full stop
_NAME = rf"(?:{_W},[ \n]+(?!(?:{_PLACE})\b){_W}|(?:[^\W\d_]\.[ \n]?(?:-?[^\W\d_]\.[ \n]?)?)?{_W}(?:[ \n]{_W}){{0,2}}?(?:[ \n][^\W\d_]\.)?)"


def _cue(left: str, right: str) -> re.Pattern:
    return re.compile(rf"(?<!\w){_loose(left)}(?:{_TITLE}[ \n]+)?(?P<n>{_NAME})(?={_loose(right)})", re.I)


# Phrases that stand before and after the name of a person.
_END = r"\s?(?:[.;:)]|\n\n|\Z|,(?!\s[^\W\d_]+[.]))"
NAMES = [
    _cue(r"l['’]intéressée?, ", r",? a signé"),
    _cue(r"(?:bien à vous|cordialement|sincères salutations|kind regards|best regards|yours sincerely|mit freundlichen grü(?:ß|ss)en|cordiali saluti|distinti saluti|atentamente|un saludo|saludos cordiales),? ", _END),
    _cue(r"(?:dossier suivi par|affaire suivie par) ", r",? (?:ligne|tél|poste)|" + _END),
    _cue(r"(?:à l['’]attention de|for the attention of|zu händen von|alla cortese attenzione di|all['’]attenzione di|a la atención de) ", r",|" + _END),
    _cue(r"(?:contactez|joindre|appelez) ", r" (?:au|par|à)\b"),
    _cue(r"(?:clienti?e?|locataire|customer|tenant|kunde|kundin|mieter|inquilino|conduttore)\s?: ", r",\s|\.|\n\n|\Z"),
    _cue(r"(?:ayants droit|begünstigte|berechtigte|erben|aventi diritto|beneficiarios|derechohabientes|beneficiaries|entitled|heirs|eigentümer|propriétaires?|owners?|propietari[oa]s?|proprietar[io]+)\s?: ", r" (?:et|and|und|e|y)\b|,|" + _END),
    _cue(r"(?:ayants droit|begünstigte|berechtigte|erben|aventi diritto|beneficiarios|derechohabientes|beneficiaries|entitled|heirs)\s?: " + rf"(?:{_TITLE}[ \n]+)?(?:{_NAME}) (?:et|and|und|e|y) ", r",|" + _END),
    _cue(r"(?:au nom de|in the name of|ausgestellt auf|intestat[oa] a|a nombre de) ", r"\s?(?:[.;)]|\n\n|\Z|,\s)"),
    _cue(r"(?:vu avec|clé chez|gesprochen mit|visto con|parlato con|spoke to|hablado con) ", r",|" + _END),
    _cue(r"(?:rappeler|appeler|rückruf(?: an)?|llamar a|chiamare|richiamare) ", r"(?:,|:)? [(+\d]"),
    _cue(r"call ", r" back\b"),
    _cue(r"(?:signed (?:today )?by|heute unterschrieben von|unterzeichnet von|firmato (?:oggi )?da|firmado (?:hoy )?por|signé (?:ce jour )?par) ", r" (?:for|für|per|por|pour)\b|,|" + _END),
    _cue(r"(?:your contact is|ihr ansprechpartner ist|ihre ansprechpartnerin ist|il suo referente è|su contacto es|votre interlocut\w+ est) ", r",? (?:direct line|durchwahl|linea|línea|ligne)|" + _END),
    _cue(r"(?:please ring|please call|erreichen sie|per domande chiamare|llame a|llamen a) ", r" (?:on|unter|al|en)\b"),
    re.compile(rf"(?:(?<=[.!?:;][ \n])|(?<=\n)|^)(?:{_TITLE}[ \n]+)?(?P<n>{_NAME})[ \n]+\([^()\d\n]{{3,24}}(?:\n[^()\d\n]{{1,20}})?\)[ \n]+(?=vous[ \n]|will[ \n]|ruft[ \n]|wird[ \n]|la[ \n]|le[ \n]|lo[ \n]|les[ \n])", re.I),
]
_CAP = r"[A-ZÀ-Þ](?:[\w'’]+(?:-[A-ZÀ-Þ][\w'’]+)*|\.)"
TITLED = re.compile(rf"(?<![\w.])(?:Mme|Mlle|Mrs|Mr|Ms|Miss|Herrn?|Frau|Sra\.|Srta\.|Sr\.|Sig\.ra|Sig\.|Signora?|Señora?|Monsieur|Madame|M\.(?=[ \n][A-ZÀ-Þ][a-zà-þ]))[ \n](?P<n>{_CAP}(?:,?[ \n]{_CAP}){{0,2}})")
SIMPLE = re.compile(rf"(?<!\w)(?:(?:Dr|Prof|Dott|Dra|Dott\.ssa|Docteur|Doctor|Doktor|Professor|Professeur|Ma[iî]tre)\.?[ \n]|(?i:(?:please|veuillez|bitte|por favor|per favore)[ \n](?:contact|contacter|kontaktieren sie|contacte a|contattare)[ \n]))(?P<n>{_CAP}(?:[ \n]{_CAP}){{1,2}})")
_NO_NAME = re.compile(r"^(?:le|la|les|the|der|die|das|el|il|lo|un|une|a|an|notre|votre|our|your|unser\w*|ihre?\w*|nostr\w+|vuestr\w+|nuestr\w+|sehr|damen|und|service|société|compagnie|banque|bank|banco|banca|résidence|residencia|residenza|verein|haus|gardien|caretaker|hausmeister|custode|conserje|bureau|agence|cabinet|mutuelle|régie|atelier|coopérative|consorzio|gestoría)\b", re.I)


# One word of every phrase of the same place in NAMES, in lower case, with and without accents.
NAME_CUES = [
    ["intéress", "interess"],
    ["bien", "cordial", "salut", "regards", "sincerely", "grüßen", "grüssen", "grussen", "grußen", "atentamente", "saludo"],
    ["suivi"],
    ["attention", "händen", "handen", "attenzione", "atención", "atencion"],
    ["contact", "joindre", "appelez"],
    ["client", "locataire", "customer", "tenant", "kund", "mieter", "inquilino", "conduttore"],
    ["ayants", "begünstigt", "begunstigt", "berechtigt", "erben", "aventi", "beneficiar", "derechohabientes", "entitled", "heirs", "eigentümer", "eigentumer", "propri", "owner", "propiet"],
    ["ayants", "begünstigt", "begunstigt", "berechtigt", "erben", "aventi", "beneficiar", "derechohabientes", "entitled", "heirs"],
    ["nom", "name", "ausgestellt", "intestat"],
    ["vu", "chez", "gesprochen", "visto", "parlato", "spoke", "hablado"],
    ["appeler", "rückruf", "ruckruf", "llamar", "chiamare"],
    ["call"],
    ["signed", "unterschrieben", "unterzeichnet", "firmato", "firmado", "signé", "signe"],
    ["contact", "ansprechpartner", "referente", "interlocut"],
    ["please", "erreichen", "chiamare", "llame"],
    [")"],
]
_STREET_END = re.compile(r"(?:stra(?:ß|ss|s)e|str\.|weg|gasse|allee|ring|damm|ufer|platz|steig|zeile)[ \n]\d", re.I)
_TOOL: list = []


def _name_bits(text: str) -> int:
    """Which of NAMES a text needs, one bit each, by one pass of an automaton over their cues."""
    if not _TOOL:
        bits: dict[str, int] = {}
        for k, cues in enumerate(NAME_CUES):
            for w in cues:
                bits[w] = bits.get(w, 0) | 1 << k
        tool = ahocorasick.Automaton()
        for w, b in bits.items():
            tool.add_word(w, b)
        tool.make_automaton()
        _TOOL.append(tool)
    seen = 0
    for _, b in _TOOL[0].iter(text.lower()):
        seen |= b
    return seen


LEARN_SUPPORT = 3
_WORDS = re.compile(rf"(?<![\w'’-])(?:[A-ZÀ-Þ]\.|[A-ZÀ-Þ][\w'’]+(?:-[A-ZÀ-Þ][\w'’]+)*)(?:,?[ \n](?:[A-ZÀ-Þ]\.|[A-ZÀ-Þ][\w'’]+(?:-[A-ZÀ-Þ][\w'’]+)*))+")


def _known_names(t: str, lexicon: frozenset):
    """(start, end) of runs of at least two capitalised words that are both known as parts of names."""
    for run in _WORDS.finditer(t):
        begin, last, known = None, 0, 0
        for w in re.finditer(r"[^\W\d_][\w'’]*(?:-[^\W\d_][\w'’]*)*\.?", run.group()):
            part = w.group().lower().rstrip(".").split("-")
            if all(x in lexicon for x in part) or len(w.group()) == 2 and w.group()[1] == ".":
                begin = w.start() if begin is None else begin
                last, known = w.end(), known + (len(part[0]) > 1)
            elif begin is not None and known < 2:
                begin, known = None, 0
            elif begin is not None:
                break
        if begin is not None and (known >= 2 or known == 1 and "." in run.group()[begin:last]):
            yield run.start() + begin, run.start() + last


def _candidate_parts(t: str) -> set[str]:
    """What a lexicon may hold of the capitalised runs of the text."""
    return {x for run in _WORDS.finditer(t) for x in re.findall(r"[^\W\d_]{4,}", run.group().lower())}


def _detect(t: str) -> list[tuple[int, int, str]]:
    """(start, end, type) in the plain text of what needs no lexicon."""
    spans = []

    def add(a: int, b: int, kind: str) -> None:
        if all(b <= x or a >= y for x, y, _ in spans):
            spans.append((a, b, kind))

    if "@" in t:
        for x in EMAIL.finditer(t):
            add(x.start(), x.end(), "EMAIL")
    for x in ID_STRONG.finditer(t):
        if not _NOT_ID.search(t[max(0, x.start() - 40) : x.start()]):
            add(x.start(), x.end(), "ID_NUMBER")
    for x in ID_CUED.finditer(t):
        if sum(c.isalnum() for c in x.group("n")) >= 8 and not _NOT_ID.search(t[max(0, x.start("n") - 40) : x.start("n")]):
            add(x.start("n"), x.end("n"), "ID_NUMBER")
    for x in PHONE.finditer(t):
        digits = sum(c.isdigit() for c in x.group())
        if digits >= 8 and not _NOT_ID.search(t[max(0, x.start() - 30) : x.start()]):
            add(x.start(), x.end(), "PHONE")
    for k, p in enumerate(ADDRESS):
        if k == 2 and not _STREET_END.search(t):
            continue
        for x in p.finditer(t):
            after = _AFTER.match(t, x.end())
            if after.group() or not _NOT_STREET.search(x.group()):
                add(x.start(), after.end() if after else x.end(), "ADDRESS")
    bits = _name_bits(t)
    for k, p in enumerate(NAMES):
        for x in p.finditer(t) if bits >> k & 1 else ():
            if not _NO_NAME.match(x.group("n")):
                add(x.start("n"), x.end("n"), "NAME")
    for p in (TITLED, SIMPLE):
        for x in p.finditer(t):
            if not _NO_NAME.match(x.group("n")):
                add(x.start("n"), x.end("n"), "NAME")
    return spans


def _placed(m: Mapped, spans: list, lexicon) -> list[tuple[int, int, str]]:
    """``spans`` of the plain text and the known names beside them, as places of the text itself."""
    spans = list(spans)
    if lexicon:
        for a, b in _known_names(m.text, lexicon):
            if all(b <= x or a >= y for x, y, _ in spans):
                spans.append((a, b, "NAME"))
    return sorted((m.place(a), m.end(b - 1), kind) for a, b, kind in spans)


def find_personal(text: str, lexicon: frozenset = frozenset()) -> list[tuple[int, int, str]]:
    """(start, end, type) of all personal information in the text, 0-based, in order and without overlaps."""
    m = deobfuscate(text)
    return _placed(m, _detect(m.text), lexicon)


def redact(text: str, lexicon: frozenset = frozenset()) -> str:
    """The text with each find replaced by its type in brackets, everything else as it is."""
    return _replaced(text, find_personal(text, lexicon))


def _replaced(text: str, spans: list) -> str:
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]])


def _finder(lexicon: frozenset):
    def run(batches):
        for pdf in batches:
            rows = [(s, i, kind, a + 1, b) for s, i, t in zip(pdf["src"], pdf["rec_id"], pdf["t"]) for a, b, kind in find_personal(t, lexicon)]
            yield pd.DataFrame(rows, columns=["src", "rec_id", "pii_type", "start_pos", "end_pos"])

    return run


def _name_parts(t: str, spans: list) -> list[str]:
    """Words of the names found, once for each name."""
    return [w for a, b, kind in spans if kind == "NAME" for w in set(re.findall(r"[^\W\d_]{4,}", t[a:b].lower()))]


def _detect_all(batches):
    for pdf in batches:
        rows = []
        for t in pdf["t"]:
            m = deobfuscate(t)
            spans = _detect(m.text)
            placed = _placed(m, spans, None)
            rows.append(([x[:2] for x in placed], [x[:2] for x in spans], [x[2] for x in placed], [x[2] for x in spans], _name_parts(t, placed), sorted(_candidate_parts(m.text))))
        if rows:
            yield pdf.assign(**dict(zip(("placed", "plain", "placed_kind", "plain_kind", "parts", "words"), map(list, zip(*rows)))))


def _detected(texts: DataFrame) -> DataFrame:
    """Row number, src, rec_id, t, finds without a lexicon (in the text and in its plain form), parts of the names among them and the words that a lexicon may know.

    Cut once: the costly patterns run a single time, though the lexicon comes from all texts and goes back to all.
    """
    some = texts.where(F.length("t") > 0).select(F.monotonically_increasing_id().alias("rid"), "src", "rec_id", "t")
    schema = "rid bigint, src string, rec_id string, t string, placed array<array<int>>, plain array<array<int>>, placed_kind array<string>, plain_kind array<string>, parts array<string>, words array<string>"
    return cut_lineage(some.mapInPandas(_detect_all, schema))


def _supported(parts: DataFrame) -> DataFrame:
    return parts.groupBy("w").count().where(f"count >= {LEARN_SUPPORT}").select("w")


def _with_known(found: DataFrame) -> DataFrame:
    """``found`` with ``known``: those words of each row that all texts together know as parts of names.

    The lexicon meets the rows by word, so it may be of any size; a row gets only what it holds itself.
    """
    lexicon = _supported(found.select(F.explode("parts").alias("w")))
    known = found.select("rid", F.explode("words").alias("w")).join(lexicon, "w").groupBy("rid").agg(F.collect_list("w").alias("known"))
    return found.drop("parts", "words").join(known, "rid", "left")


def _finished(row) -> list[tuple[int, int, str]]:
    if row.known is None:
        return [(a, b, kind) for (a, b), kind in zip(row.placed, row.placed_kind)]
    return _placed(deobfuscate(row.t), [(a, b, kind) for (a, b), kind in zip(row.plain, row.plain_kind)], frozenset(row.known))


def _finish_spans(batches):
    for pdf in batches:
        rows = [(r.src, r.rec_id, kind, a + 1, b) for r in pdf.itertuples(index=False) for a, b, kind in _finished(r)]
        if rows:
            yield pd.DataFrame(rows, columns=["src", "rec_id", "pii_type", "start_pos", "end_pos"])


def _finish_texts(batches):
    for pdf in batches:
        yield pdf[["src", "rec_id"]].assign(t=[_replaced(r.t, _finished(r)) for r in pdf.itertuples(index=False)])


def spans_with_learned_names(texts: DataFrame) -> DataFrame:
    """As ``personal_spans``, with the names learned from all of the texts; two shuffles, of words and of texts."""
    return _with_known(_detected(texts)).mapInPandas(_finish_spans, "src string, rec_id string, pii_type string, start_pos bigint, end_pos bigint")


def redacted_with_learned_names(texts: DataFrame) -> DataFrame:
    """(src, rec_id, t): the texts that aren't empty, with placeholders, with the names learned from all of them."""
    return _with_known(_detected(texts)).mapInPandas(_finish_texts, "src string, rec_id string, t string")


def _parts(batches):
    for pdf in batches:
        parts = [w for t in pdf["t"] for w in _name_parts(t, find_personal(t))]
        if parts:
            yield pd.DataFrame({"w": parts})


def learn_names(texts: DataFrame) -> frozenset:
    """Parts of names that the phrases find at least ``LEARN_SUPPORT`` times in all texts, to be handed to the functions here.

    The set lies in memory: for collections whose parts of names are not bounded, take ``spans_with_learned_names``.
    """
    return frozenset(r.w for r in _supported(texts.where(F.length("t") > 0).select("t").mapInPandas(_parts, "w string")).collect())


def personal_spans(texts: DataFrame, lexicon: frozenset = frozenset()) -> DataFrame:
    """(src, rec_id, pii_type, start_pos, end_pos), 1-based and inclusive, of a frame with src, rec_id and t (the text).

    Null and empty texts have none; repeated rows give their rows again. One map, no shuffle; whole texts are read.
    """
    some = texts.where(F.length("t") > 0).select("src", "rec_id", "t")
    return some.mapInPandas(_finder(lexicon), "src string, rec_id string, pii_type string, start_pos bigint, end_pos bigint")


def redacted(df: DataFrame, column: str, lexicon: frozenset = frozenset()) -> DataFrame:
    """``df`` with the personal information of one text column replaced by placeholders; nulls stay null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None else redact(t, lexicon))

    return df.withColumn(column, run(F.col(column)))


def library_texts(spark, sf_dir: str) -> DataFrame:
    """Current contents, notes and page texts as src, rec_id, t."""
    docs = current_rows(spark.read.parquet(f"{sf_dir}/search_docs.parquet"), "id", "updated_at", ["content", "notes"])
    pages = current_rows(spark.read.parquet(f"{sf_dir}/ocr_results.parquet"), "page_id", "created_at", ["text"])
    both = docs.select(F.explode(F.array(F.struct(F.lit("content").alias("src"), F.col("id").alias("rec_id"), F.col("content").alias("t")), F.struct(F.lit("notes").alias("src"), F.col("id").alias("rec_id"), F.col("notes").alias("t")))).alias("r"))
    return both.select("r.*").unionByName(pages.select(F.lit("ocr_text").alias("src"), F.col("page_id").alias("rec_id"), F.col("text").alias("t")))


def p2_found(spark, sf_dir: str) -> DataFrame:
    """(src, rec_id, pii_type, start_pos): every occurrence in the current rows."""
    return spans_with_learned_names(library_texts(spark, sf_dir)).select("src", "rec_id", "pii_type", "start_pos")


def p2_redacted(spark, sf_dir: str) -> DataFrame:
    """(src, rec_id, t): the current texts with placeholders."""
    return redacted_with_learned_names(library_texts(spark, sf_dir))
