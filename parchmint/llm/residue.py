"""Template residue, filler, error pages and script notices.

Each kind of placeholder has the grammar of its delimiter; a match counts unless its sentence explains or quotes it, or it
lies in a code block. Filler and error messages are known by families of words in five languages. A text is an error
page only as a whole: what is left beside messages, codes, retry lines and titles decides, by its share of the words.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.session import fresh_name, spread

# Words that mark a bracketed phrase as a note to the writer.
_FILL = r"(?:to be |à |a |da |por |zu )?(?:insert|fill|enter|replace|complete|compl[ée]t|compil|rellen|remplir|renseign|saisi|inserir|inserisc|einsetz|einf[üu]g|ausf[üu]ll|eintrag|your |votre |vostro|su |tu |ihr|name|nom|nome|nombre|date|datum|data|fecha|adresse|address|company|client|kunde|tbd|todo)"

# Variables of shells and systems, and keys of a keyboard, which stand for themselves.
_SHELL = r"HOME|PATH|USER|USERNAME|USERPROFILE|SHELL|PWD|TMP|TEMP|TMPDIR|APPDATA|LOCALAPPDATA|PROGRAMDATA|PROGRAMFILES|WINDIR|SYSTEMROOT|SYSTEMDRIVE|HOSTNAME|COMPUTERNAME|LANG|EDITOR|TERM|JAVA_HOME|PYTHONPATH|LD_LIBRARY_PATH|XDG_\w+"
_KEYS = r"enter|return|esc|escape|tab|space|shift|ctrl|control|alt|del|delete|backspace|insert|home|end|pgup|pgdn|up|down|left|right|entrée|échap|eingabe|umschalt|strg|entf|invio|canc|intro|supr"

# Grammars of unfilled placeholders, by delimiter.
PLACEHOLDERS = [
    r"\{\{[^{}\n]{1,60}\}\}",
    r"\$\{(?!(?:" + _SHELL + r")\})[^{}\n]{1,60}\}",
    r"(?<![\w$])\{(?:\d{1,3}|[a-z][\w.]{2,40})\}",
    r"<%=?[^%\n]{1,60}%>",
    r"\[\[(?![A-ZÀ-Þ][^\[\]\n]*[a-zà-ÿ][^\[\]\n_]*\]\])[^\[\]\n]{1,60}\]\]|\[\[(?i:" + _FILL + r")[^\[\]\n]{0,50}\]\]",
    r"<<[^<>\n]{1,60}>>",
    r"«(?:[^\W\d_]+[_.][\w.-]{1,40}|[A-ZÀ-Þ][\w.-]{1,40})»",
    r"<(?!/?(?:p|br|b|i|u|a|li|ul|ol|td|tr|th|h\d|em|strong|div|span|table|html|body|head|script|code|pre)\b)(?!(?:" + _KEYS + r")\b)[a-zà-ÿ][a-zà-ÿ]+(?:[ _-][a-zà-ÿ]+){0,5}>",
    r"\[(?:[A-ZÀ-Þ]{2,}(?:[ '’_-][A-ZÀ-Þ]{1,})+|(?i:" + _FILL + r")[^\[\]\n]{0,50})\]",
    r"(?<![\w%])%(?!(?:" + _SHELL + r")%)[A-Z][A-Z_]{2,40}%",
    r"@@[A-Za-z_]{2,40}@@",
    r"(?<![\w#])#[A-Z][A-Z_]{2,40}#",
    r"\$\$[A-Za-z_]{2,40}\$\$",
    r"(?<!\w)__[A-Z][A-Z_]{1,40}__(?!\w)",
    r"\b(?:JJ|DD|TT|GG)([/.-])MM\1(?:AAAA|YYYY|JJJJ|AA|YY|JJ)\b|\b(?:YYYY|AAAA|JJJJ)-MM-(?:DD|JJ|TT|GG)\b|\bMM/DD/YYYY\b",
    r"\bXX([/.-])XX\1(?:20)?XX(?:XX)?\b",
    r"\b(?:TBD|TODO|FIXME)[-_ ](?:FIELD|CHAMP|FELD|CAMPO)\b",
]

# Filler where a passage belongs.
FILLER = [
    r"lorem ipsum|dolor sit amet|consectetur adipiscing|sed do eiusmod|ut labore et dolore",
    r"\b(?:bla ){2,}bla\b|\b(?:blah ){2,}blah\b",
    r"\b(?:ins[ée]rer|saisissez|saisir|entrez|tapez|placez)\b[^.\n]{0,20}\b(?:texte|contenu|paragraphe)\b|\btexte (?:à remplacer|de remplissage|factice|d'exemple|bidon)",
    r"\byour (?:text|content)\b[^.\n]{0,10}\b(?:goes )?here\b|\b(?:insert|enter|type|put|add) (?:your |the )?(?:text|content|copy)\b[^.\n]{0,20}\bhere\b|\bsample (?:paragraph|text)\b|\b(?:placeholder|dummy|filler) (?:text|paragraph|copy)\b",
    r"\bhier (?:steht|kommt|folgt)[^.\n]{0,20}\btext\b|\bblindtext\b|\b(?:muster|beispiel|platzhalter)text\b|\btext (?:hier )?(?:einf[üu]gen|eingeben)\b|\bihr text\b[^.\n]{0,8}\bhier\b",
    r"\btexto de (?:ejemplo|relleno|muestra|prueba)\b|\b(?:inserte|escriba|introduzca|ponga)\b[^.\n]{0,20}\b(?:texto|contenido)\b|\bsu texto\b[^.\n]{0,8}\baqu[íi]\b",
    r"\btesto di (?:prova|esempio|riempimento)\b|\btesto segnaposto\b|\b(?:inserire|inserisci|scrivi|scrivere|digitare)\b[^.\n]{0,20}\b(?:testo|contenuto)\b|\bil (?:tuo|vostro|suo) testo\b[^.\n]{0,8}\bqui\b",
    r"\b(?:asdf ?){2,}|\b(?:qwertz?y? ?){2,}|\b(?:foo bar|xxx xxx)\b",
]

# Messages of error pages.
ERRORS = [
    r"\b(?:page|document|fichier|file|resource|url)\b[^.\n]{0,40}\b(?:introuvable|not found|no longer|could ?n[o']t be found|cannot be found|does ?n[o']t exist|n'existe (?:plus|pas)|moved)\b|\bn'existe plus ou a été déplacé",
    r"\b(?:seite|dokument|datei)\b[^.\n]{0,40}\b(?:nicht (?:gefunden|vorhanden|verfügbar)|existiert nicht)\b|\b(?:pagina|documento)\b[^.\n]{0,40}\b(?:non (?:trovat[ao]|esiste|disponibile))|\b(?:página|documento)\b[^.\n]{0,40}\bno (?:encontrad[ao]|existe|disponible|se ha encontrado)",
    r"\b(?:access|permission) (?:is |was )?(?:denied|forbidden)|\bforbidden\b|\bacc[èe]s (?:refusé|interdit|non autorisé)|\bzugriff (?:verweigert|nicht)|\baccesso (?:negato|vietato)|\bacceso (?:denegado|prohibido)|\bnot authori[sz]ed|\bunauthori[sz]ed",
    r"\bsession\b[^.\n]{0,20}\b(?:expir|timed out|ended)|\bsitzung\b[^.\n]{0,20}\babgelaufen|\bsessione\b[^.\n]{0,20}\bscadut|\bsesión\b[^.\n]{0,20}\b(?:caducad|expirad)",
    r"\b(?:service|server|site|gateway)\b[^.\n]{0,30}\b(?:unavailable|indisponible|overloaded|surchargé|down for|not responding)|\bdienst\b[^.\n]{0,30}\bnicht (?:erreichbar|verfügbar)|\bserver\b[^.\n]{0,20}überlastet|\bservizio\b[^.\n]{0,30}\bnon disponibile|\bservicio\b[^.\n]{0,30}\bno disponible",
    r"\b(?:internal|server|unexpected|unknown) (?:server )?error\b|\berreur (?:interne|inattendue|inconnue|serveur)|\binterner? (?:server)?fehler|\berrore (?:interno|imprevisto)|\berror (?:interno|inesperado)|\b(?:something|an error) (?:went wrong|occurred)",
    r"\bbad (?:gateway|request)\b|\btoo many requests\b|\bgateway time-?out\b|\brequest timed? ?-?out\b|\btimed? ?out\b|\bd[ée]lai (?:d'attente|d’attente)[^.\n]{0,12}dépassé|\bzeitüberschreitung|\btempo (?:di attesa )?scaduto|\btiempo de espera (?:agotado|superado)|\btrop de requêtes|\bzu viele anfragen|\btroppe richieste|\bdemasiadas (?:peticiones|solicitudes)|\bpasserelle incorrecte",
]

# Notices that scripts are needed.
SCRIPTS = r"(?:\b(?:java ?script|scripts?|skripte?n?)\b)"
NEEDS = r"(?:\b(?:activ|enable|allow|turn|need|requir|without|attiv|abilit|richied|habilit|active|permit|necesit|requier|aktivier|erlaub|zulass|benötig|ohne|bloque|besoin|nécessa|autoris|désactiv|disabled|does not run|must|musst|müss|serv)\w*)"

# Lines that come with such messages: codes, request ids, retry hints, ways back, stack frames.
_BESIDE = [
    r"^(?:erreur|error|fehler|errore|http)[ :]*\d{3}\b.{0,3}$|^\d{3}$",
    r"^(?:identifiant de requête|request id|vorgangsnummer|codice|código|code|id)\b[ :]*\S+$",
    r"\b(?:réessaye[zr]|try again|retry|erneut versuchen|später|riprovar\w*|riprov\w+|inténtelo|reintent\w*|reload|rechargez|aktualisieren)\b",
    r"\b(?:retour à|back to|return to|zur startseite|zurück|torna(?:re)? a|volver a)\w*\b.{0,30}$",
    r"^\s*at \S+\([^()]*\)\s*$|^\s*File \".*\", line \d+",
    r"\b(?:si le problème persiste|if (?:this|the problem) (?:goes on|persists)|wenn das problem|se il problema|si el problema)\b",
    r"^(?:please|veuillez|merci de|bitte|por favor|per favore|si prega di)\b.{0,60}$",
    r"\b(?:sign in again|reconnectez-vous|slow down|melden sie sich|acceda de nuevo|accedere di nuovo)\b",
]

# Words by which a sentence speaks about such things instead of being one.
_ABOUT = re.compile(
    r"\b(?:expliqu\w+|explain\w*|erklär\w*|spieg\w+|explica\w*|guide|guida|guía|leitfaden|handbuch|manual\w*|manuel|formation|course|training|schulung|corso|curso|tutori\w+|"
    r"rappelle que|says|note que|notes that|noted|notiert|annota|anota|affichait|affiche que|screen (?:read|showed)|zeigte|mostrava|mostraba|mail merge|publipostage|serienbrief|stampa unione|"
    r"combinación de correspondencia|example of|exemple de|format\w*|variable\w*|syntax|syntaxe|wird ersetzt|is replaced|est remplacé|viene sostituito|se sustituye|placeholder is|escaped)\b",
    re.I,
)
# Verbs and nouns by which a word in guillemets is a quotation or a title.
_SAYS = re.compile(r"\b(?:dit|dire|répond\w*|demand\w+|cri\w+|lu|lit|lire|intitul\w+|titre|roman|film|livre|mot|terme|appel\w*|nomm\w+|dijo|dice|decir|respond\w+|grit\w+|libro|título|novela|película|palabra|llama\w*|disse|detto|ha risposto|parola|romanzo|titolo|chiam\w+|sagte|wort|buch|film|titel|genannt)\b", re.I)
_QUOTED = re.compile(r"«\s[^»\n]*\s»|“[^”\n]*”|\"[^\"\n]*\"|„[^“”\n]*[“”]")
_CODE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|<(code|pre)\b.*?</\1>", re.S | re.I)
_FILLED = re.compile("|".join(FILLER), re.I)
_ERROR = re.compile("|".join(ERRORS), re.I)
_SCRIPT = re.compile(rf"{NEEDS}[^.\n]{{0,60}}{SCRIPTS}|{SCRIPTS}[^.\n]{{0,60}}{NEEDS}", re.I)
_SIDE = re.compile("|".join(_BESIDE), re.I | re.M)
_STATUS = re.compile(r"^\W*(?:(?:erreur|error|fehler|errore|http)\W*)?[45]\d\d\b|\([45]\d\d\)\W*$", re.I)

MOST_OTHER = 0.15
_CODE_LINE = re.compile(r"[;{}]\s*$|^\s*(?:def|class|import|from|return|var|let|const|function|if|for|while|echo|print)\b.*[(:;=]")

# What a text must hold, in lower case, to be looked at closely: delimiters, and stems of the families above.
_STEMS = {
    "hole": ["{{", "${", "{", "<%", "[[", "<<", "«", "<", "[", "%", "@@", "#", "$$", "__", "jj/mm", "jj.mm", "jj-mm", "dd/mm", "dd.mm", "dd-mm", "tt.mm", "tt/mm", "tt-mm", "gg/mm", "gg.mm", "gg-mm", "mm/dd", "yyyy-mm", "aaaa-mm", "jjjj-mm", "xx/xx", "xx.xx", "xx-xx", "tbd", "todo", "fixme"],
    "filler": ["lorem", "dolor sit", "consectetur", "sed do eiusmod", "ut labore", "bla bla", "blah blah", "insérer", "inserer", "saisi", "entrez", "tapez", "placez", "texte à", "texte de", "texte factice", "texte d'", "texte bidon", "your text", "your content", "insert", "enter ", "type ", "put ", "add ", "sample ", "placeholder", "dummy", "filler", "hier ", "blindtext", "mustertext", "beispieltext", "platzhaltertext", "text ", "ihr text", "texto de", "escriba", "introduzca", "ponga", "su texto", "testo", "inserir", "inserisc", "contenut", "scriv", "digitare", "asdf", "qwert", "foo bar", "xxx xxx"],
    "page": ["script", "skript", "introuvable", "not found", "no longer", "be found", "exist", "esiste", "nicht gefunden", "nicht vorhanden", "nicht verfügbar", "nicht erreichbar", "zugriff", "non trovat", "non disponibil", "no encontrad", "no disponible", "se ha encontrado", "moved", "déplacé", "denied", "forbidden", "authori", "autorisé", "refusé", "interdit", "accesso", "acceso", "session", "sesión", "sitzung", "unavailable", "indisponible", "overloaded", "surchargé", "down for", "not responding", "überlastet", "error", "erreur", "fehler", "errore", "went wrong", "occurred", "gateway", "bad request", "too many", "time-out", "timeout", "time out", "time -out", "timed", "délai d", "delai d", "zeitüber", "scadut", "scaduto", "tiempo de espera", "trop de requ", "zu viele", "troppe", "demasiad", "passerelle"],
}
_ANY_HOLE = re.compile("|".join(f"(?:{p})" for p in (q.replace("\\1", "[/.-]") for q in PLACEHOLDERS)))


def _automaton() -> ahocorasick.Automaton:
    """One pass that tells which families a text needs; a stem of several families carries all their bits."""
    bits: dict[str, int] = {}
    for i, stems in enumerate(_STEMS.values()):
        for w in stems:
            bits[w] = bits.get(w, 0) | 1 << i
    a = ahocorasick.Automaton()
    for w, b in bits.items():
        a.add_word(w, b)
    a.make_automaton()
    return a


_TOOL: list = []


def _needs(text: str) -> int:
    if not _TOOL:
        _TOOL.append(_automaton())
    seen = 0
    for _, b in _TOOL[0].iter(text.lower()):
        seen |= b
        if seen == 7:
            break
    return seen


def _sentence_at(text: str, start: int, end: int) -> str:
    """The sentence around a match; a line end or a full stop with a space ends a sentence."""
    a = max(text.rfind("\n", 0, start), *(text.rfind(m, 0, start) for m in (". ", "! ", "? "))) + 1
    ends = [i for i in (text.find(m, end) for m in ("\n", ". ", "! ", "? ")) if i >= 0]
    return text[a : min(ends, default=len(text))]


def residue_of(text: str | None) -> str | None:
    """``placeholder``, ``filler``, ``error`` or ``script`` for a text that has such residue, else None."""
    needs = _needs(text) if text else 0
    if not needs:
        return None
    body = _CODE.sub("\n", text) if "```" in text or "~~~" in text or "<" in text else text
    if needs & 1:
        for m in _ANY_HOLE.finditer(body):
            s = _sentence_at(body, *m.span())
            if not _ABOUT.search(s) and not _CODE_LINE.search(_ANY_HOLE.sub("x", s)) and not (m.group()[0] == "«" and _SAYS.search(s)):
                return "placeholder"
    if needs & 2:
        for m in _FILLED.finditer(body):
            s = _sentence_at(body, *m.span())
            spoken = m.group().lower() in ("bla bla bla", "blah blah blah") and len(s.split()) > 3  # part of a sentence
            if not spoken and not _ABOUT.search(s) and _FILLED.search(_QUOTED.sub(" ", s)):
                return "filler"
    return _as_page(body) if needs & 4 and (_ERROR.search(body) or _SCRIPT.search(body)) else None


def _as_page(body: str) -> str | None:
    """Whether messages are all there is, but for titles at the top."""
    found, kinds, other, words, titles = 0, set(), 0, 0, 0
    for line in (x for x in body.split("\n") if x.strip()):
        parts, hits, loose = re.split(r"(?<=[.!?])\s+", line.strip()), 0, 0
        for p in parts:
            n = len(p.split())
            hit = None if _ABOUT.search(p) or _QUOTED.search(p) else "script" if _SCRIPT.search(p) else "error" if _ERROR.search(p) else None
            if hit and n <= 25:
                kinds.add(hit)
                hits += 1
                words += n
            elif _SIDE.search(p) and n <= 14 or _STATUS.search(p) and n <= 4:
                hits += 1
                words += n
            else:
                loose += n
        if not hits and not found and titles < 2 and loose <= 12 and not re.search(r"[.!?]\W*$", line):
            titles += 1
            continue
        found += hits
        other += loose
        words += loose
    if not kinds or other > MOST_OTHER * words:
        return None
    return "error" if "error" in kinds else "script"


def _scan(column: str):
    def run(batches):
        for pdf in batches:
            kinds = [residue_of(t) for t in pdf["_t"]]
            yield pdf.drop(columns="_t").assign(**{column: kinds})[[k is not None for k in kinds]]

    return run


def find_residue(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, residue): the texts that have residue and its kind; nulls, empty and genuine texts are left out.

    One pass without a shuffle. An automaton over the delimiters and stems tells first which grammars a text needs, if any.
    """
    name = fresh_name([key], "residue")
    some = spread(df.where(F.length(text) > 0).select(F.col(key), F.col(text).alias("_t")))
    return some.mapInPandas(_scan(name), f"`{key}` {dict(df.dtypes)[key]}, `{name}` string")


def without_residue(df: DataFrame, key: str, text: str) -> DataFrame:
    """The rows whose texts have no residue (null texts stay)."""
    return df.join(find_residue(df, key, text).select(key).distinct(), key, "left_anti")


def p8_found(spark, sf_dir: str) -> DataFrame:
    """(doc_id): documents with template residue."""
    return find_residue(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text").select("doc_id").distinct()


def p8_kinds(spark, sf_dir: str) -> DataFrame:
    """(residue, documents): documents by kind of residue."""
    found = find_residue(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return found.groupBy("residue").agg(F.countDistinct("doc_id").alias("documents"))
