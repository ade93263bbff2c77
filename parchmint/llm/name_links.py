"""Links typed names to a register by a pigeonhole segment join.

A register entry is known by its rare words (a surname, an invented firm name): the rarest one, and all that ``FEW`` entries at
most have. A name that shows an entry's words of ``FEW`` entries within their edits (or all words of an entry that has none such) goes
to such an entry; any other name (``Plomberie Dup.``) is compared with every entry that has one of its words, however frequent.
The words compared, the cores, are cut into k + 1 segments; a typed word within k edits of a core holds one of them unchanged, shifted by no more than the edits beside it.
Typed words are looked up by such substrings in the inverted index of segments, and candidates are verified with a
banded edit distance. The remaining words (trade or given name, legal form, town) then decide between candidates.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parchmint.functions.text import normalize_py
from parchmint.session import cut_lineage

# Legal forms and their written-out variants.
LEGAL = {"sarl": "sarl", "sas": "sas", "sa": "sa", "eurl": "eurl", "gmbh": "gmbh", "ltd": "ltd", "limited": "ltd", "srl": "srl", "sl": "sl", "spa": "spa", "ag": "ag", "kg": "kg", "inc": "inc", "llc": "llc", "plc": "plc", "sasu": "sasu", "snc": "snc", "ug": "ug", "slu": "slu", "sci": "sci"}
# Titles and connecting words; the second part of an addition names its kind.
TITLES = {"me": "me", "maitre": "me", "dr": "dr", "docteur": "dr", "doctor": "dr", "mr": "mr", "m": "mr", "mme": "mme", "herr": "mr", "frau": "mme", "prof": "prof"}
LINKS = {"et", "and", "und", "y", "e", "du", "de", "des", "la", "le", "les"}
ADDITIONS = {"fils": "fils", "sons": "fils", "sohne": "fils", "hijos": "fils", "figli": "fils", "freres": "freres", "frs": "freres", "bros": "freres", "associes": "associes", "assoc": "associes", "associates": "associes", "partner": "associes", "val": "val"}
# Short forms and nicknames that are neither prefix nor skeleton of the full word.
NICKNAMES = {
    "sacha": "alexandre", "sandro": "alexandre", "cathy": "catherine", "kate": "catherine", "cecco": "francesco", "fifine": "josephine", "jose": "josephine", "josie": "josephine",
    "tina": "valentina", "vale": "valentina", "lisa": "elisabeth", "betty": "elisabeth", "lise": "elisabeth", "babette": "elisabeth", "babeth": "elisabeth", "beth": "elisabeth", "liz": "elisabeth", "fredo": "frederic", "chris": "christophe",
    "tof": "christophe", "domi": "dominique", "ben": "benjamin", "benji": "benjamin", "alex": "alexandre", "max": "maximilian", "guill": "guillaume", "willy": "guillaume", "will": "guillaume", "franz": "francesco", "paco": "francesco",
}

EDITS_LONG, EDITS_SHORT, SHORT = 3, 1, 5
_FOLD = str.maketrans({"0": "o", "1": "l", "5": "s", "8": "b", "|": "l"})


def _edits(length: int) -> int:
    """Edits allowed on a core of that length."""
    return 0 if length < 4 else EDITS_SHORT if length <= SHORT else 2 if length <= 7 else EDITS_LONG


@lru_cache(maxsize=100_000)
def words_of(name: str) -> tuple[str, ...]:
    """Words in normal form: dotted letters joined, missing spaces before capitals set, digits inside words read as letters."""
    t = unicodedata.normalize("NFC", name)
    t = re.sub(r"\b((?:\w{1,3}\.){1,4}\w{0,2})(?!\w)", lambda m: m.group(0).replace(".", "") + " " if _letters(m.group(0)) in LEGAL else m.group(0).replace(".", ". "), t)
    t = re.sub(r"(?<=[a-zà-öø-ÿ0-9])(?=[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ])", " ", t)
    t = re.sub(r"(?<=[A-Z]{2})(?=[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]{2})", " ", t)
    out = []
    for w in normalize_py(t).split():
        if any(c.isalpha() for c in w):
            w = w.translate(_FOLD)
        out.append(w)
    return tuple(out)


def _cuts(length: int) -> int:
    """Segments of a core, less one: a swap of neighbours changes two segments, so one more than the edits."""
    k = _edits(length)
    return k + 1 if length > SHORT and k else k


def _letters(s: str) -> str:
    return normalize_py(s).replace(" ", "")


def segments(core: str, k: int) -> list[tuple[int, int, str]]:
    """(number, start, text) of k + 1 segments whose lengths differ by one at most, the longer ones last."""
    n, parts = len(core), k + 1
    short, longer = n // parts, n % parts
    out, at = [], 0
    for i in range(parts):
        size = short + (i >= parts - longer)
        out.append((i, at, core[at : at + size]))
        at += size
    return out


def probes(word: str) -> set[str]:
    """Keys of the index that a core within the allowed edits must hold one of."""
    n, keys = len(word), set()
    for length in range(max(1, n - EDITS_LONG), n + EDITS_LONG + 1):
        k = _cuts(length)
        if abs(length - n) > _edits(length):
            continue
        delta, shape = n - length, segments("x" * length, k)
        for i, at, seg in shape:
            size = len(seg)
            # positions by the shift that the edits left of the segment and right of it can cause
            low = max(0, at - i, at + delta - (k - i))
            high = min(n - size, at + i, at + delta + (k - i))
            for p in range(low, high + 1):
                keys.add(f"{length}:{i}:{word[p : p + size]}")
    return keys


def damerau(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours as one edit, in a band of ``most``; ``most + 1`` when larger."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    far = most + 1
    before, last = None, [j if j <= most else far for j in range(m + 1)]
    for i in range(1, n + 1):
        now = [far] * (m + 1)
        if i <= most:
            now[0] = i
        for j in range(max(1, i - most), min(m, i + most) + 1):
            d = min(last[j] + 1, now[j - 1] + 1, last[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, before[j - 2] + 1)
            now[j] = min(d, far)
        if min(now) > most:
            return far
        before, last = last, now
    return min(last[m], far)


def _skeleton_of(short: str, full: str) -> bool:
    """The letters of ``short`` come in ``full`` in order, from its first letter on."""
    if not short or short[0] != full[0]:
        return False
    it = iter(full)
    return all(c in it for c in short)


def agrees(word: str, full: str) -> float:
    """How far a typed word stands for a word of the register: 0 the same, 1 not at all."""
    if word == full:
        return 0.0
    if NICKNAMES.get(word) == full:
        return 0.1
    if full.startswith(word):
        return 0.1 if len(word) >= 3 else 0.15
    if len(word) >= 4 and damerau(word, full, 2) <= (1 if len(word) < 7 else 2):
        return 0.2
    if len(word) >= 5 and any(f == full and len(n) >= 4 and damerau(word, n, 1) <= 1 for n, f in NICKNAMES.items()):
        return 0.25
    if 2 <= len(word) <= 6 and _skeleton_of(word, full):
        return 0.2
    if len(word) >= 4 and full.endswith(word):
        return 0.25
    if len(word) >= 4 and damerau(word, full[: len(word)], 1) <= 1:
        return 0.3
    return 1.0


def unglued(words: tuple[str, ...], known: frozenset) -> list[tuple[str, ...]]:
    """The words, then the same with a known word split off one that it runs into."""
    out = [words]
    for at, w in enumerate(words):
        if w in known:
            continue
        for n in range(2, len(w) - 3):
            if w[:n] in known and n > 2:
                out.append((*words[:at], w[:n], w[n:], *words[at + 1 :]))
            if w[-n:] in known:
                out.append((*words[:at], w[:-n], w[-n:], *words[at + 1 :]))
    return out


def parse(words: tuple[str, ...], towns: frozenset = frozenset()) -> dict:
    """The roles of a name's words: legal form, titles, additions, town, and the other words in order."""
    words, legal, titles, adds, town, rest = list(words), set(), set(), set(), "", []
    for t in sorted(towns, key=len, reverse=True):
        p = t.split()
        if len(words) > len(p) and words[-len(p) :] == p:
            town, words = t, words[: -len(p)]
            break
    for w in words:
        if w in LEGAL:
            legal.add(LEGAL[w])
        elif w in ADDITIONS:
            adds.add(ADDITIONS[w])
        elif w in TITLES:
            titles.add(TITLES[w])
        elif w not in LINKS:
            rest.append(w)
    return {"legal": legal, "titles": titles, "adds": adds, "town": town, "rest": rest}


@lru_cache(maxsize=100_000)
def _alone(w: str) -> float:
    """Cost of a word that stands for none of the entry: a misread addition, legal form or title, or a letter; 9 for any other."""
    if any(damerau(w, a, 2) <= (2 if len(w) > 5 else 1) for a in ADDITIONS if len(a) > 3) or len(w) == 1 or any(damerau(w, a, 1) <= 1 for a in LEGAL if len(a) > 3):
        return 0.3
    return 0.2 if any(damerau(w, a, 1) <= 1 for a in TITLES if len(a) > 4) else 9.0


def _too_far(word: str, core: str, distance: int, split: bool) -> bool:
    """Three edits must leave the first letter, and a word that only a guessed split has set free may have one edit."""
    return distance > 1 and split or distance > 2 and word[0] != core[0]


def _stands(word: str, full: str, rarest: str, split: bool) -> float:
    """Cost of a word that stands for another word of the entry, 9 when it can't; the rarest one costs its edits, as it does as a core."""
    if full == rarest and word != full:
        d = damerau(word, full, _edits(len(full)))
        if d <= _edits(len(full)):
            return 9.0 if _too_far(word, full, d, split) else d
    cost = agrees(word, full)
    return cost if cost < 1 else 9.0


def identified(name: dict, entry: dict, core_word: str, split: bool = False) -> bool:
    """Whether a name met through a frequent word also shows a rare word of the entry: whole, or shortened unless a guessed split has set it free."""
    left = list(name["rest"])
    left.remove(core_word)
    whole = any(w == r for w in left for r in entry["rare"])
    return whole or not split and any(agrees(w, r) <= 0.15 or 2 <= len(w) <= 6 and _skeleton_of(w, r) for w in left for r in entry["rare"])


def shows_all(name: dict, entry: dict, core_word: str) -> bool:
    """Whether a name shows all other words of an entry within their edits."""
    left = list(name["rest"])
    left.remove(core_word)
    return all(any(damerau(w, c, _edits(len(c))) <= _edits(len(c)) for w in left) for c in entry["rest"] if c != entry["core"])


def score(name: dict, entry: dict, core_word: str, distance: int, split: bool = False) -> float:
    """Cost of linking a parsed name to a register entry through one of its words; 9 when something contradicts it."""
    if _too_far(core_word, entry["core"], distance, split):
        return 9.0
    rarest = entry["rare"][0]
    left = list(name["rest"])
    left.remove(core_word)
    cost = distance + 0.5 * split
    context = [w for w in entry["rest"] if w != entry["core"]]
    for full in context:
        best = min(((_stands(w, full, rarest, split), w) for w in left), default=(9.0, ""))
        if best[0] < 9:
            cost += best[0]
            left.remove(best[1])
        elif "".join(left) and (_stands("".join(left), full, rarest, split) < 9 or full != rarest and full.endswith(left[-1])):
            cost += 0.3
            left = []
        else:
            cost += 0.6
    for w in left:
        alone = _alone(w)
        if alone == 9:
            return 9.0
        cost += alone
    if name["legal"] and name["legal"] != entry["legal"]:
        cost += 1.6 if entry["legal"] else 3.0
    if name["adds"] - entry["adds"]:
        cost += 1.5
    cost += 0.1 * len(entry["adds"] - name["adds"])
    if name["titles"] - entry["titles"]:
        cost += 1.0
    if name["town"] and entry["town"] and name["town"] != entry["town"]:
        cost += 0.5
    return cost


MOST_COST = 4.0
LEAST_LEAD = 0.05
MOST_KNOWN = 50_000  # towns and repeated words of the register that are sent to the tasks; beyond, names meet them by key
FEW = 3  # a word of so many entries at most stands for each of them before any more frequent one does
_OWN = frozenset(LEGAL) | frozenset(TITLES) | frozenset(NICKNAMES) | frozenset(w for w in LINKS if len(w) > 1)


def _register_words(batches):
    for pdf in batches:
        words = [words_of(n) for n in pdf["name"]]
        yield pdf[["id"]].assign(words=[" ".join(w) for w in words], rest=[parse(w)["rest"] for w in words], town=[" ".join(words_of(t or "")) for t in pdf["town"]])


def _index(batches):
    for pdf in batches:
        rows = [(f"{len(c)}:{i}:{seg}", c) for c in pdf["core"] for i, _, seg in segments(c, _cuts(len(c)))]
        yield pd.DataFrame(rows, columns=["key", "core"])


def _pieces(longest: int):
    """What of each name may be a known word (w) or a town (t), up to the length of the longest: words, their beginnings and ends; the last words, from the end of a word on."""

    def run(batches):
        for pdf in batches:
            rows = []
            for name in pdf["typed"]:
                words = words_of(name)
                got = {("w", x) for w in words for n in range(3, min(len(w), longest) + 1) for x in (w[:n], w[-n:])}
                after = ""
                for w in reversed(words):
                    got |= {("t", w[-n:] + after) for n in range(1, min(len(w), longest - len(after)) + 1)}
                    after = f" {w}{after}"
                    if len(after) > longest:
                        break
                rows += [(name, k, x) for k, x in got]
            yield pd.DataFrame(rows, columns=["typed", "kind", "piece"])

    return run


def _typed(towns: frozenset, known: frozenset):
    """The words of each name, in every way to part them; ``met`` has what is known of a name where ``towns`` and ``known`` are too many to send."""

    def run(batches):
        for pdf in batches:
            rows = []
            for name, met in zip(pdf["typed"], pdf["met"]):
                met = [] if met is None else met
                here = known | {m["piece"] for m in met if m["kind"] == "w"}
                there = towns | {m["piece"] for m in met if m["kind"] == "t"} if len(met) else towns
                for n, v in enumerate(unglued(words_of(name), here)):
                    p = parse(v, there)
                    rows += [(name, " ".join(v), w, n > 0, p["town"]) for w in dict.fromkeys(p["rest"])]
            yield pd.DataFrame(rows, columns=["typed", "words", "word", "split", "own_town"])

    return run


def _probe(batches):
    for pdf in batches:
        rows = [(k, w) for w in pdf["word"] for k in probes(w)]
        yield pd.DataFrame(rows, columns=["key", "word"])


def _verify(batches):
    for pdf in batches:
        most = [_edits(len(c)) for c in pdf["core"]]
        d = [damerau(w, c, k) for w, c, k in zip(pdf["word"], pdf["core"], most)]
        out = pdf.assign(distance=d)
        yield out[[x <= k for x, k in zip(d, most)]]


def _judge(batches):
    parsed = lru_cache(maxsize=50_000)(lambda w, t: parse(tuple(w.split()), frozenset((t,)) if t else frozenset()))
    entry = lru_cache(maxsize=50_000)(lambda w, t, c, r: parse(tuple(w.split())) | {"town": t, "core": c, "rare": r.split()})
    for pdf in batches:
        pairs = [(parsed(n, o), entry(w, t, c, r), x, d, g) for n, o, w, t, c, r, x, d, g in zip(pdf["words"], pdf["own_town"], pdf["entry"], pdf["town"], pdf["core"], pdf["rare"], pdf["word"], pdf["distance"], pdf["split"])]
        out = pdf[["typed", "first", "last"]].assign(cost=[score(*p) for p in pairs])
        near = out["cost"] <= MOST_COST
        pairs = [p for p, k in zip(pairs, near) if k]
        weak = [n > FEW and (least <= FEW or not shows_all(*p[:3])) for p, n, least in zip(pairs, pdf["n"][near], pdf["least"][near])]
        unsure = [e["core"] not in e["rare"] and not identified(n, e, x, g) for n, e, x, _, g in pairs]
        yield out[near].assign(weak=weak, unsure=unsure)


def _typed_words(names: DataFrame, towns: DataFrame, known: DataFrame) -> DataFrame:
    """``_typed`` of all names: the register's towns and repeated words travel to the tasks if they are ``MOST_KNOWN`` at most, else names meet them by key."""
    schema = "typed string, words string, word string, split boolean, own_town string"
    table = towns.select(F.lit("t").alias("kind"), F.col("town").alias("piece")).union(known.select(F.lit("w"), "word")).where("length(piece) > 0").distinct()
    rows = table.limit(MOST_KNOWN + 1).collect()
    if len(rows) <= MOST_KNOWN:
        few = {k: frozenset(r.piece for r in rows if r.kind == k) for k in "tw"}
        return names.withColumn("met", F.lit(None).cast("array<struct<kind:string,piece:string>>")).mapInPandas(_typed(few["t"], _OWN | few["w"]), schema)
    longest = table.agg(F.max(F.length("piece"))).first()[0]
    met = names.mapInPandas(_pieces(longest), "typed string, kind string, piece string").join(table, ["kind", "piece"]).groupBy("typed").agg(F.collect_list(F.struct("kind", "piece")).alias("met"))
    return names.join(met, "typed", "left").mapInPandas(_typed(frozenset(), _OWN), schema)


def _linked(typed: DataFrame, entries: DataFrame) -> DataFrame:
    """(typed, first, last, weak, cost, unsure): every entry that has a word within the allowed edits of a word of the name and that nothing in the name contradicts."""
    index = entries.select("core").distinct().mapInPandas(_index, "key string, core string")
    met = typed.select("word").distinct().mapInPandas(_probe, "key string, word string").join(index, "key").select("word", "core").distinct()
    near = met.mapInPandas(_verify, "word string, core string, distance int")
    cand = typed.join(near, "word").join(entries, "core").select("typed", "words", "word", "split", "own_town", "distance", "first", "last", "entry", "town", "core", "rare", "n", "least")
    judged = cand.mapInPandas(_judge, "typed string, first bigint, last bigint, cost double, weak boolean, unsure boolean")
    return judged.groupBy("typed", "first", "last").agg(F.min(F.struct("weak", "cost", "unsure")).alias("b")).select("typed", "first", "last", "b.*")


def link_names(names: DataFrame, register: DataFrame) -> DataFrame:
    """(typed, id, cost): the register entry that each distinct name of ``names`` (column ``typed``) refers to.

    ``register`` has id bigint, name, town. A name equal to an entry's name goes to that entry (the smallest id of equal
    entries). Names whose two best entries cost the same are linked to none, as are null, blank and unknown names, and names
    that show only frequent words of their best entry. Repeated names are linked once, so a company with many invoices costs
    no more than one with few; entries of the same words and town are judged once.
    """
    names = names.where(F.length(F.trim("typed")) > 0).select("typed").distinct()
    register = register.where(F.col("name").isNotNull()).select("id", "name", "town")
    same = names.join(register.groupBy("name").agg(F.min("id").alias("id")), names["typed"] == F.col("name")).select("typed", "id", F.lit(0.0).alias("cost"))
    entries = register.select("id", "name", F.coalesce("town", F.lit("")).alias("town")).mapInPandas(_register_words, "id bigint, words string, rest array<string>, town string")
    entries = entries.groupBy("words", "rest", "town").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    exploded = entries.select("words", "town", "first", "last", F.posexplode("rest").alias("at", "word"))
    count = exploded.groupBy("word").agg(F.countDistinct("words", "town").alias("n"))
    ranked = exploded.join(count, "word").groupBy("words", "town", "first", "last").agg(F.sort_array(F.collect_list(F.struct("n", (-F.col("at")).alias("at"), "word"))).alias("w"))
    rare = F.array_distinct(F.filter("w", lambda x, at: (at == 0) | (x["n"] <= FEW))["word"])
    cores = F.array_distinct(F.transform("w", lambda x: F.struct(x["word"].alias("core"), x["n"].alias("n"))))
    entries = ranked.select(F.col("words").alias("entry"), "town", "first", "last", rare.alias("rares"), F.col("w")[0]["n"].alias("least"), F.explode(cores).alias("c"))
    entries = entries.select("entry", "town", "first", "last", "least", "c.*", F.array_join("rares", " ").alias("rare"), F.array_contains("rares", F.col("c.core")).alias("own"))
    todo = names.join(same, "typed", "left_anti")
    typed = cut_lineage(_typed_words(todo, entries, count.where("n > 1 and length(word) > 2")))
    strong = cut_lineage(_linked(typed, entries.where("own")).where("not weak"))
    others = typed.join(strong.select("typed").distinct(), "typed", "left_anti")
    # Through words of FEW entries the others have met nothing, so only the more frequent words are left to try.
    judged = strong.union(_linked(others, entries.where(F.col("n") > FEW))).select("typed", F.explode(F.array("first", "last")).alias("id"), "cost", "unsure")
    judged = judged.groupBy("typed", "id").agg(F.min(F.struct("cost", "unsure")).alias("b")).select("typed", "id", "b.*")
    # The two best tell whether the best one stands alone; no other takes part in that.
    two = judged.withColumn("rank", F.row_number().over(Window.partitionBy("typed").orderBy("cost", "id"))).where("rank <= 2")
    best = two.groupBy("typed").agg(F.min(F.struct("cost", "id", "unsure")).alias("b"), F.max("cost").alias("second"), F.count("*").alias("n"))
    clear = best.where(~F.col("b.unsure") & ((F.col("n") == 1) | (F.col("second") - F.col("b.cost") >= LEAST_LEAD))).select("typed", "b.id", "b.cost")
    return same.union(clear)


def p4_found(spark, sf_dir: str) -> DataFrame:
    """(doc_id, issuer_id): invoices whose company is a variant spelling of a registered issuer."""
    inv = spark.read.parquet(f"{sf_dir}/invoices.parquet").select("doc_id", "company").distinct()
    reg = spark.read.parquet(f"{sf_dir}/issuers.parquet").select(F.col("issuer_id").alias("id"), "name", "town")
    links = link_names(inv.select(F.col("company").alias("typed")), reg).join(reg.select("id", "name"), "id").where("typed <> name")
    return inv.join(links, inv["company"] == links["typed"]).select("doc_id", F.col("id").alias("issuer_id")).distinct()
