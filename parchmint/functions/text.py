"""Normal form of text, tokens, edit distance and date tokens."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accent_table() -> tuple[str, str]:
    """Every precomposed Latin, Greek and Cyrillic letter whose canonical decomposition is one letter and marks."""
    src, dst = [], []
    for block in (range(0x00C0, 0x0250), range(0x0386, 0x0460), range(0x1E00, 0x2000)):
        for cp in block:
            c = chr(cp)
            base = "".join(x for x in unicodedata.normalize("NFD", c) if not "̀" <= x <= "ͯ")
            low = base.lower()
            if base != c and len(low) == 1:
                src.append(c)
                dst.append(low)
    return "".join(src), "".join(dst)


_FROM, _TO = _accent_table()
_LIGATURES = (("œ", "oe"), ("æ", "ae"), ("ß", "ss"))


def normalize(text: Column) -> Column:
    """Accents removed, lower case, œ æ ß written out, everything but letters and digits one space, trimmed.

    Null gives null. A composition of built-in functions, so it stays inside the JVM.
    """
    t = F.lower(F.translate(text, _FROM, _TO))
    for a, b in _LIGATURES:
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(t, "[\\u0300-\\u036f]+", "")
    return F.trim(F.regexp_replace(t, "[^\\p{L}\\p{N}]+", " "))


def normalize_py(text: str) -> str:
    """The same normal form in Python, by full canonical decomposition (the measure for ``normalize``)."""
    t = "".join(c for c in unicodedata.normalize("NFD", text) if not "̀" <= c <= "ͯ").lower()
    for a, b in _LIGATURES:
        t = t.replace(a, b)
    return " ".join("".join(c if unicodedata.category(c)[0] in "LN" else " " for c in t).split())


def tokenize(text: Column) -> Column:
    """Words of the normal form; null and blank texts give an empty array."""
    n = F.coalesce(normalize(text), F.lit(""))
    return F.filter(F.split(n, " "), lambda x: x != "")


def edit_distance(a: Column, b: Column, most: int = 2) -> Column:
    """Levenshtein distance, ``most + 1`` when it is larger."""
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, most + 1).otherwise(d)


# Month names, unaccented, January first.
MONTHS_FR = ["janvier", "fevrier", "mars", "avril", "mai", "juin", "juillet", "aout", "septembre", "octobre", "novembre", "decembre"]
MONTHS_EN = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def date_tokens(ts: Column) -> Column:
    """Words by which a date can be searched: year, ISO, d/m/y, French and English month; null for null."""
    names = lambda ms: F.try_element_at(F.array(*[F.lit(m) for m in ms]), F.month(ts))
    return F.when(
        ts.isNotNull(),
        F.concat_ws(" ", F.date_format(ts, "yyyy"), F.date_format(ts, "yyyy-MM"), F.date_format(ts, "yyyy-MM-dd"), F.date_format(ts, "dd/MM/yyyy"), names(MONTHS_FR), names(MONTHS_EN)),
    )
