"""Noise in text from scanned pages: cut words, misread words, running headers, page numbers; and the repaired text.

Words are judged once per distinct form, with the counts of the whole collection: forms meet the more frequent words that
share rare positional q-grams with them in an inverted join, and boosted trees, trained on words spoilt on purpose and on
forms the recogniser itself doubted, rank these candidates against leaving the form as it is. Boosted trees on pairs of
neighbouring lines, trained on words cut on purpose, decide where a word goes on in the next line; others, on lines in the
same place of a document's pages, tell titles and page numbers by form and place; a title must then be repeated.

A dictionary of the most frequent words travels to the tasks. It only saves work: every word and pair it does not settle
is joined with the counts of all forms by key.
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parchmint.llm.boosting import Boosted
from parchmint.operators.current import current_rows
from parchmint.session import cut_lineage

# What a recogniser reads for what, both ways.
CONFUSED = [
    ("n", "ri"), ("m", "rn"), ("d", "cl"), ("h", "li"), ("w", "vv"), ("ü", "ii"), ("e", "c"), ("u", "v"), ("v", "y"), ("a", "o"), ("t", "f"), ("i", "l"), ("g", "q"), ("b", "h"), ("o", "0"), ("l", "1"), ("i", "1"), ("s", "5"), ("b", "6"), ("é", "6"),
    ("b", "8"), ("z", "2"), ("l", "|"), ("i", "|"), ("g", "9"), ("f", "t"), ("r", "n"), ("c", "o"), ("k", "h"), ("x", "z"), ("s", "8"), ("u", "n"), ("e", "o"), ("i", "j"), ("é", "e"), ("è", "e"), ("à", "a"), ("e", "f"), ("ü", "u"), ("ö", "o"), ("ä", "a"), ("ó", "o"), ("í", "i"), ("ñ", "n"),
]
_SWAPS = sorted({(a, b) for a, b in CONFUSED} | {(b, a) for a, b in CONFUSED})
_PAIRS = {(a, b) for a, b in _SWAPS if len(a) == len(b) == 1}
_LONG = [(a, b) for a, b in _SWAPS if len(a) != len(b)]
_DIGITS = {"o": "0", "O": "0", "Q": "0", "D": "0", "l": "1", "I": "1", "|": "1", "i": "1", "Z": "2", "z": "2", "S": "5", "s": "5", "B": "8", "b": "6", "G": "6", "g": "9", "q": "9", "A": "4", "T": "7", "é": "6", "E": "6"}
_LETTER_OF = {"0": "O", "1": "I", "2": "Z", "5": "S", "8": "B", "6": "G", "9": "g", "4": "A", "7": "T"}

LEAST_COUNT = 8  # of a shape, to be one others are misread from
LEAST_WORD = 3  # of a word, to be one others are misread from
LEAST_SHARE = 2e-6  # of the words in the dictionary that travels: half a million at most
RATIO, RATIO_RARE = 10.0, 3.0  # how much more frequent the true word is: at two edits, at one
OFTEN = 20
TRAIN_WORDS = 1500
EDITS = 2
LEAST_TRAINING = 60
MARKS = "-‐‑¬­"
_EDGE = ".,;:!?()[]{}«»\"“”„'’ …"


def core(word: str) -> str:
    """A word without the punctuation around it, lower case."""
    return word.strip(_EDGE).lower()


def core_column(c):
    return F.lower(F.regexp_replace(c, r"^[.,;:!?()\[\]{}«»\"“”„'’ …]+|[.,;:!?()\[\]{}«»\"“”„'’ …]+$", ""))


def grams(word: str) -> set[str]:
    """Padded pairs and, of words of five letters and more, triples of letters."""
    w = f"^{word}$"
    return {w[i : i + q] for q in ((2, 3) if len(word) >= 5 else (2,)) for i in range(len(w) - q + 1)}


def rarest_grams(word: str, order: dict[str, int]) -> list[tuple[str, int]]:
    """The padded pairs of letters with their places, rarest first, as many as ``EDITS`` edits can't all destroy (an edit destroys two)."""
    w = f"^{word}$"
    return [(g, i) for _, g, i in sorted((order.get(w[i : i + 2], 0), w[i : i + 2], i) for i in range(len(w) - 1))[: 2 * EDITS + 1]]


def edit_costs(a: str, b: str, most: float = 2.2) -> tuple[float, int]:
    """Weighted edits from the true word ``b`` to the form ``a`` (confusions cost 0.5, other edits 1), and how many of them are no confusions."""
    n, m = len(a), len(b)
    if abs(n - m) > 3:
        return 9.0, 9
    d = np.full((n + 1, m + 1), 9.0)
    d[0, : m + 1], d[: n + 1, 0] = np.arange(m + 1) * 1.01, np.arange(n + 1) * 1.01
    d = d.tolist()
    for i in range(1, n + 1):
        low = 9.0
        for j in range(1, m + 1):
            x, y = a[i - 1], b[j - 1]
            v = min(d[i - 1][j - 1] + (0 if x == y else 0.5 if (x, y) in _PAIRS else 1.01), d[i - 1][j] + 1.01, d[i][j - 1] + 1.01)
            for p, q in _LONG:
                if len(p) <= i and len(q) <= j and a[i - len(p) : i] == p and b[j - len(q) : j] == q:
                    v = min(v, d[i - len(p)][j - len(q)] + 0.5)
            d[i][j] = v
            low = min(low, v)
        if low > most:
            return 9.0, 9
    plain = round((d[n][m] - int(2 * d[n][m] + 1e-6) / 2) * 100)
    return round(d[n][m] - plain * 0.01, 2), plain


def edit_cost(a: str, b: str) -> float:
    return edit_costs(a, b)[0]


def folded(c):
    """Letters read as two written as the one, so that several such misreadings stay within a small edit distance."""
    for one, two in CONFUSED:
        if len(two) == 2:
            c = F.replace(c, F.lit(two), F.lit(one))
    return c


def fold(word: str) -> str:
    """As ``folded``, of a Python string."""
    for one, two in CONFUSED:
        if len(two) == 2:
            word = word.replace(two, one)
    return word


def features(form: str, n: float, sure: float, cand: str, m: float) -> list[float]:
    same = len(grams(form) & grams(cand)) / max(1, len(grams(cand)))
    cost, plain = edit_costs(form, cand)
    return [
        math.log1p(m), math.log((m + 1) / (n + 1)), cost, plain, len(form), len(form) - len(cand), form[:1] == cand[:1], form[-1:] == cand[-1:],
        any(c.isdigit() or c == "|" for c in form), sure, same, min(n, 30.0),
    ]


def spoil(word: str, rnd: random.Random) -> str:
    """The word with one confusion at a random place, or as it is where none applies."""
    places = [(i, a, b) for i in range(len(word)) for a, b in _SWAPS if word.startswith(a, i)]
    if not places:
        return word
    i, a, b = rnd.choice(places)
    return word[:i] + b + word[i + len(a) :]


class Ranker:
    """Scores (form, candidate) pairs; above one half the candidate replaces the form.

    ``words`` holds counts and mean confidences (0 where none is known). Words whose confidence is above ``split`` are
    taken for true, those below for misread. Without confidence a word is taken for true unless it is one confusion away
    from a far more frequent one, for in a large collection misread forms are frequent too.
    """

    def __init__(self, words: dict[str, tuple[float, float]], rare_sure: list[float], split: float = 0.0, seed: int = 3):
        rnd = random.Random(seed)
        pool = sorted(w for w, (n, s) in words.items() if w.isalpha() and len(w) > 1 and not 0 < s < split)
        doubted = sorted(w for w, (n, s) in words.items() if 0 < s < split and len(w) > 1)
        some = rnd.sample(pool, min(TRAIN_WORDS, len(pool)))
        often = rnd.choices(pool, [words[w][0] for w in pool], k=TRAIN_WORDS) if pool else []  # as misread words come
        trusted = set(pool)
        index: dict[str, set] = {}
        for w in pool:
            for g in grams(w):
                index.setdefault(g, set()).add(w)

        def near(form: str) -> list[str]:
            hits: dict[str, int] = {}
            for g in grams(form):
                for w in index.get(g, ()):
                    hits[w] = hits.get(w, 0) + 1
            need = max(1, len(form) - 4)
            return sorted((w for w, k in hits.items() if k >= need and abs(len(w) - len(form)) <= 2 and w != form), key=lambda w: (-hits[w], w))[:12]

        def enough(n: float, m: float, cost: float) -> bool:
            return m >= (RATIO_RARE if cost <= 1 else RATIO) * n

        x, y = [], []

        def learn(form: str, n: float, sure: float, cand: str, label: float) -> None:
            x.append(features(form, n, 0.0 if rnd.random() < 0.1 else sure, cand, words[cand][0]))  # some without confidence
            y.append(label)

        for at, w in enumerate(some + often):
            n, sure = words[w]
            form = spoil(w, rnd)
            if rnd.random() < 0.2:
                form = spoil(form, rnd)
            elif rnd.random() < 0.1 and len(w) > 3:
                i = rnd.randrange(len(w))
                form = w[:i] + rnd.choice("abcdefghilmnoprstuv1") + w[i + 1 :]
            own = edit_cost(form, w)
            if form != w and form not in trusted:
                k = max(1.0, n * 10 ** rnd.uniform(-4, -1.6)) if n > 60 else 1.0
                # a recogniser that was sure of one misreading was often sure of the next
                some_sure = rare_sure[-max(1, len(rare_sure) // 5) :] if k <= 8 and rnd.random() < 0.2 else rare_sure
                s = float(np.mean(rnd.choices(some_sure, k=int(min(k, 30))))) if rare_sure else 60.0
                for c in sorted({w, *near(form)}):
                    cost = edit_cost(form, c)
                    if cost <= 2 and enough(k, words[c][0], cost):
                        learn(form, k, s, c, float(cost <= own))  # any word that explains the form as well
            for c in near(w) if at < len(some) else ():  # a true word beside more frequent ones
                cost = edit_cost(w, c)
                if cost <= 2 and enough(n, words[c][0], cost) and (sure > 0 or cost > 0.5 or words[c][0] < 100 * n):
                    learn(w, n, sure, c, 0.0)
        for w in rnd.sample(doubted, min(TRAIN_WORDS, len(doubted))):
            n, sure = words[w]
            costs = {c: edit_cost(w, c) for c in near(w)}
            costs = {c: k for c, k in costs.items() if k <= 2 and enough(n, words[c][0], k)}
            for c, k in costs.items():
                if k > min(costs.values()) or k <= 1:
                    learn(w, n, sure, c, float(k == min(costs.values())))
        self.model = Boosted().fit(np.array(x, dtype=float), np.array(y)) if len(set(y)) == 2 else None

    def score(self, rows: list[list[float]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        x = np.array(rows, dtype=float)
        if self.model is None:  # too few words to learn from: a single confusion of a far more frequent word
            return ((x[:, 2] <= 0.5) & (x[:, 1] > np.log(4 * RATIO))).astype(float)
        return self.model.predict(x)


@lru_cache(maxsize=200_000)
def shape(word: str) -> str:
    return "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in word)


def look_alike(word: str, cand: str) -> int | None:
    """At how many places the shape ``cand`` has the other kind of a look-alike character of ``word``; None where they differ otherwise."""
    own = shape(word)
    if len(own) != len(cand):
        return None
    places = [i for i in range(len(own)) if own[i] != cand[i]]
    return len(places) if all(word[i] in _DIGITS if cand[i] == "9" else word[i] in _LETTER_OF and cand[i] in "Aa" for i in places) else None


def shape_features(word: str, n: float, sure: float, shape_sure: float, cand: str, m: float) -> list[float]:
    """Of a word, the count and mean confidence of its shape, and a far more frequent shape."""
    digits = sum(c.isdigit() for c in word)
    return [math.log1p(m), math.log((m + 1) / (n + 1)), look_alike(word, cand) or 0, cand.count("9") - digits, digits / max(1, len(word)), len(word), sure, shape_sure, min(n, 30.0), word[:1].isdigit(), word[-1:].isdigit()]


class ShapeRanker:
    """Scores words with digits against far more frequent shapes; above one half the word is misread.

    Learned from numbers spoilt on purpose and from shapes near a more frequent one: true where the recogniser was sure
    of their words on the whole (``high``), misread where it was not (``split``). ``rows`` are (word, count of its shape), ``near`` (example
    word, count and mean confidence of its shape, the other shape and its count), both bounded samples.
    """

    def __init__(self, rows: list[tuple[str, float]], near: list[tuple], rare_sure: list[float], split: float, high: float, seed: int = 7):
        rnd = random.Random(seed)
        spoilt_as: dict[str, list[str]] = {}
        for letter, d in _DIGITS.items():
            spoilt_as.setdefault(d, []).append(letter)
        x, y = [], []
        for word, n, sure, cand, m in near:
            if look_alike(word, cand) and (n >= LEAST_COUNT and sure >= high or n >= LEAST_WORD and 0 < sure < split):
                own = [sure, 0.0, rnd.choice(rare_sure) if rare_sure and sure < split else sure]
                x += [shape_features(word, n, s, k, cand, m) for s, k in zip(own, (sure, 0.0, sure))]
                y += [float(sure < split)] * 3
        for word, n in rows:
            places = [i for i, c in enumerate(word) if c in spoilt_as]
            if n >= 10 * LEAST_COUNT and places:
                form = word
                for i in rnd.sample(places, min(len(places), 1 + (rnd.random() < 0.15))):
                    form = form[:i] + rnd.choice(spoilt_as[word[i]]) + form[i + 1 :]
                k = min(max(1.0, n * 10 ** rnd.uniform(-4, -1.3)), n / RATIO)
                some_sure = rare_sure[-max(1, len(rare_sure) // 3) :] if k <= 15 and rnd.random() < 0.25 else rare_sure
                draws = rnd.choices(some_sure, k=int(min(k, 30))) if rare_sure and rnd.random() > 0.1 else [0.0]
                x.append(shape_features(form, k, draws[0], float(np.mean(draws)), shape(word), n))
                y.append(1.0)
        if len(y) < LEAST_TRAINING:
            x, y = [], []
        for label in (0.0, 1.0):  # neither kind may be outnumbered more than four times
            own = [f for f, k in zip(x, y) if k == label]
            more = own * (-(-(len(y) - len(own)) // (4 * len(own))) - 1) if own else []
            x, y = x + more, y + [label] * len(more)
        self.model = Boosted(rounds=40).fit(np.array(x, dtype=float), np.array(y)) if len(set(y)) == 2 else None

    def score(self, rows: list[list[float]]) -> np.ndarray:
        x = np.array(rows, dtype=float)
        return (x[:, 1] > np.log(4 * RATIO)).astype(float) if self.model is None else self.model.predict(x)


def near_shapes(counts: DataFrame) -> DataFrame:
    """(k, n, shape_sure, example, cand, m): shapes (k, n, shape_sure, example) with the shapes ``RATIO`` times as frequent, as long and two characters apart at most, through shared q-grams."""
    left = counts.select("k", F.col("n").cast("double"), "shape_sure", "example").mapInPandas(_gram_keys({}, range(1)), "gram string, place int, k string, n double, shape_sure double, example string")
    right = counts.where(F.col("n") >= LEAST_COUNT).select(F.col("k").alias("cand"), F.col("n").cast("double").alias("m"))
    right = right.mapInPandas(_gram_keys({}, range(1)), "gram string, place int, cand string, m double")
    met = left.join(right, ["gram", "place"]).where((F.col("m") >= RATIO * F.col("n")) & (F.length("k") == F.length("cand"))).select("k", "n", "shape_sure", "example", "cand", "m").distinct()
    return met.where(F.levenshtein("k", "cand", EDITS) >= 0)


def _shapes_of(batches):
    for pdf in batches:
        yield pdf.assign(k=[shape(w) for w in pdf["form"]])


def _misread(ranker: ShapeRanker):
    def run(batches):
        for pdf in batches:
            met = [(f, shape_features(f, n, s if s > 0 else 0.0, k if k > 0 else 0.0, c, m)) for f, n, s, k, c, m in zip(pdf["form"], pdf["n"], pdf["sure"], pdf["shape_sure"], pdf["cand"], pdf["m"]) if look_alike(f, c)]
            yield pd.DataFrame({"form": [f for (f, _), p in zip(met, ranker.score([x for _, x in met])) if p > 0.5] if met else []}, dtype=object)

    return run


def misread_numbers(words: DataFrame, near: DataFrame, sure: DataFrame, ranker: ShapeRanker) -> DataFrame:
    """(form): those of the distinct ``words`` (form) with digits that are misread; ``near`` shapes and ``sure`` (form, sure) are met by key."""
    met = words.mapInPandas(_shapes_of, "form string, k string").join(near, "k").join(sure.withColumnRenamed("form", "low"), F.lower("form") == F.col("low"), "left")
    return met.select("form", "n", F.col("sure").cast("double"), "shape_sure", "cand", "m").mapInPandas(_misread(ranker), "form string").distinct()


# -- cut words -----------------------------------------------------------------------------------------------------------
def pair_keys(last: str, first: str) -> list[str]:
    """What the counts of a pair are asked for: joined and hyphened (with and without an elided article), both parts, the first as a suspended one."""
    mark = last[-1:] in MARKS and len(last) > 1
    a = last[:-1] if mark else last
    a, b = a.strip("([{«\"“„'’").lower(), first.rstrip(_EDGE).lower()
    tail = a.rsplit("'", 1)[-1].rsplit("’", 1)[-1]
    return [f"f{a}{b}", f"f{tail}{b}", f"f{a}-{b}", f"f{tail}-{b}", f"f{a}", f"f{tail}", f"f{b}", f"m{a}"]


def pair_features(last: str, first: str, counts: dict[str, float]) -> list[float]:
    mark = last[-1:] in MARKS and len(last) > 1
    keys = pair_keys(last, first)
    n = [np.log1p(counts.get(k, 0.0)) for k in keys]
    a, b, raw = keys[4][1:], keys[6][1:], first.rstrip(_EDGE)
    joined, left = max(n[0], n[1]), max(n[4], n[5])
    return [mark, mark and last[-1] != "-", joined, max(n[2], n[3]), left, n[6], n[7], len(a), len(b), raw[:1].islower(), a.isalpha(), b.isalpha(), joined - min(left, n[6])]


def maybe_cut(last: str, first: str, known: dict) -> bool:
    """Whether a pair needs the model: not if nothing can go on, or if both words are frequent and joined they are not."""
    if last[-1:] in MARKS and len(last) > 1:
        return True
    if not (last[-1:].isalpha() and first[:1].isalpha() and first[:1].islower()):
        return False
    a, b = last.lower(), core(first)
    return a not in known or b not in known or a + b in known


class Joiner:
    """Decides whether the last word of a line goes on in the next line, learned from frequent words cut on purpose and from neighbours inside lines."""

    def __init__(self, words: dict[str, tuple[float, float]], pairs: list[tuple[str, str]], seed: int = 5):
        rnd = random.Random(seed)
        weight = sorted((w for w in words if len(w) >= 4 and w.replace("-", "").isalpha()), key=lambda w: (-words[w][0], w))[:20_000]
        self.examples: list[tuple[str, str, float]] = [(a, b, 0.0) for a, b in pairs]
        for _ in range(min(3000, 4 * len(weight))):
            w = rnd.choice(weight)
            i = rnd.randint(2, len(w) - 2)
            a, b = w[:i].rstrip("-"), w[i:].lstrip("-")
            if len(a) < 2 or len(b) < 2:
                continue
            if rnd.random() < 0.12:
                a = spoil(a, rnd)
            if rnd.random() < 0.3:
                a = a.capitalize()
            self.examples.append((a + rnd.choice(["-", "-", "-", "‐", "¬", ""]), b, 1.0))
        for w in weight:  # compounds broken at their own hyphen
            if "-" in w.strip("-"):
                i = w.index("-", 1)
                self.examples.append((w[: i + 1], w[i + 1 :], 1.0))
        self.model: Boosted | None = None

    def keys(self) -> set[str]:
        """What ``fit`` wants the counts of."""
        return {k for a, b, _ in self.examples for k in pair_keys(a, b)}

    def fit(self, counts: dict[str, float]) -> "Joiner":
        y = np.array([label for *_, label in self.examples])
        if len(set(y)) == 2:
            self.model = Boosted(rounds=50).fit(np.array([pair_features(a, b, counts) for a, b, _ in self.examples], dtype=float), y)
        return self

    def sure(self, rows: list[list[float]]) -> np.ndarray:
        x = np.array(rows, dtype=float)
        return x[:, 0] * x[:, 9] if self.model is None else self.model.predict(x)


def _unsettled_keys(known):
    """Each pair with what its features need: counts the dictionary has, and keys it has not (or null)."""

    def run(batches):
        words = known.value
        for pdf in batches:
            rows = []
            for last, first in zip(pdf["last"], pdf["first"]):
                rows.append((last, first, None))
                rows += [(last, first, k) for k in set(pair_keys(last, first)) if k[1:] and (k[0] == "m" or k[1:] not in words)]
            yield pd.DataFrame(rows, columns=["last", "first", "k"])

    return run


def _decide(known, joiner: Joiner):
    def run(batches):
        words = known.value
        for pdf in batches:
            rows = []
            for last, first, met in zip(pdf["last"], pdf["first"], pdf["met"]):
                counts = {f"f{w}": words[w][0] for w in {k[1:] for k in pair_keys(last, first)} if w in words}
                rows.append(pair_features(last, first, counts | {m["k"]: m["n"] for m in met}))
            yield pdf.loc[joiner.sure(rows) > 0.5, ["last", "first"]] if rows else pdf[["last", "first"]]

    return run


def cut_pairs(pairs: DataFrame, counts: DataFrame, known, joiner: Joiner) -> DataFrame:
    """(last, first): the distinct ``pairs`` that are one word; ``counts`` (k, n) are met by key for all that the dictionary doesn't hold."""
    asked = pairs.mapInPandas(_unsettled_keys(known), "last string, first string, k string").join(counts, "k", "left")
    met = asked.groupBy("last", "first").agg(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("k", F.col("n").cast("double").alias("n")))).alias("met"))
    return met.mapInPandas(_decide(known, joiner), "last string, first string")


# -- furniture -----------------------------------------------------------------------------------------------------------
_N = r"[\dOoIl|SBZzb]{1,4}"
# Words for page and for of.
_NUMBER = re.compile(rf"^[\s\-–—\[\](){{}}·|.*_~]*(?:(?:p[aoáà]g[ecio]n?[ao]?|s[ec]i[tf][ec]|p|s|f[ao]l|n|no|nr)\b\.?\s*)?(?=[^\n]*\d|[Il|]){_N}(?:\s*(?:/|sur|svr|of|o[ft]|von|di|de|d[ec])\s*{_N})?[\s\-–—\[\](){{}}·|*_~]*$", re.I)
_WITH_NUMBER = re.compile(rf"[\s·|—–-]*\b(?:p[aoáà]g[ecio]n?[ao]?|s[ec]i[tf][ec]|p\.)\s*{_N}(?:\s*(?:/|sur|svr|of|von|di|de)\s*{_N})?\s*$|[\s·|]+[-–—(\[]?\s*\d{{1,4}}(?:\s*/\s*\d{{1,4}})?\s*[-–—)\]]?$", re.I)
_FOLDS = [("rn", "n"), ("ri", "n"), ("m", "n"), ("cl", "d"), ("li", "h"), ("vv", "w")]
_FOLD = str.maketrans({"c": "e", "é": "e", "è": "e", "6": "e", "b": "e", "o": "a", "0": "a", "à": "a", "ó": "a", "v": "u", "y": "u", "ü": "u", "f": "t", "l": "i", "1": "i", "|": "i", "í": "i", "j": "i", "q": "g", "9": "g", "h": "e", "8": "e", "5": "s", "2": "z"})


def skeleton(line: str) -> str:
    """A line without its page number, with look-alike characters folded, so that misread copies meet."""
    t = _WITH_NUMBER.sub("", line).lower()
    for a, b in _FOLDS:
        t = t.replace(a, b)
    return re.sub(r"\W+", " ", t.translate(_FOLD)).strip()


@lru_cache(maxsize=10_000)
def like_title(line: str) -> bool:
    """Short, without the marks of running text: capitals, capital words up to the last one, parts set off by bars or dashes, or a reference at the end."""
    t = _WITH_NUMBER.sub("", line).strip()
    words = t.split()
    if not words or len(words) > 9 or t[-1] in ".,;:!?-‐¬" or "," in t or not t[0].isupper() and not t[0].isdigit():
        return False
    content = [w for w in words if len(w) > 3 and w[0].isalpha()]
    if not content or any(c in t for c in "€£") or "EUR" in t:
        return False
    if all(w[0].isupper() for w in content) and (t.isupper() or any(c in t for c in "|—·–") or len(words) <= 5 and words[-1][0].isupper()):
        return True
    return len(words) <= 5 and any(c.isdigit() for c in words[-1])


def outer_lines(lines: list[str]) -> list[int]:
    """Places of the first two and last two lines."""
    n = len(lines)
    return sorted({i for i in (0, 1, n - 2, n - 1) if 0 <= i < n})


def page_lines(text: str | None) -> list[str]:
    return [t for t in (text or "").split("\n") if t.strip()]


def title_features(lines: list[str], i: int) -> list[float]:
    """Of a line as a title at the head or foot: its form, its place, and the neighbour inside the page."""
    t = _WITH_NUMBER.sub("", lines[i]).strip()
    words = t.split()
    content = [w for w in words if len(w) > 3 and w[0].isalpha()]
    near = lines[i + 1] if i + 1 < len(lines) and i < 2 else lines[i - 1] if i else ""
    title, digits = like_title(lines[i]), any(c.isdigit() for c in t)
    sender = i == 0 and title and not digits and not lines[i].isupper() and like_title(near) and any(c.isdigit() for c in near)
    below = i == 1 and like_title(lines[0]) and not any(c.isdigit() for c in lines[0]) and not _NUMBER.match(lines[0])
    return [
        title, sender, below, len(words), len(t), sum(w[0].isupper() for w in content) / max(1, len(content)), t.isupper(), t[-1:] in ".,;:!?-‐¬", "," in t, digits, any(c in t for c in "|—·–"), t[:1].isupper() or t[:1].isdigit(),
        any(c in t for c in "€£") or "EUR" in t, i, len(lines) - 1 - i, t != lines[i].strip(), bool(_NUMBER.match(lines[i])), like_title(near),
    ]


def number_features(lines: list[str], i: int) -> list[float]:
    """Of a line as a page's number: its form and place."""
    t = lines[i].strip()
    digits, letters = sum(c.isdigit() for c in t), sum(c.isalpha() for c in t)
    return [
        bool(_NUMBER.match(t)), len(t.split()), len(t), digits, digits / max(1, len(t)), letters, "/" in t, t[:1] in "-–—[(", t[-1:] in "-–—])", t[-1:] in ".,;:", any(c in t for c in "€£,"), bool(re.search(r"\d{5}|\d[.,]\d", t)), i == 0, i == len(lines) - 1, t[:1].isupper(),
    ]


class Furniture:
    """Tells titles and page numbers at the head and foot of pages by form and place, as pairs of lines teach it.

    A line is a title for training if another page of its document has the same one on the same side, a page number if
    another page has it there with another figure. Lines inside pages are neither. ``documents`` are the lines of the
    pages of some documents; with too few of them the grammars decide alone.
    """

    def __init__(self, documents: list[list[list[str]]]):
        titles: tuple[list, list] = ([], [])
        numbers: tuple[list, list] = ([], [])
        figures = lambda t: re.sub(r"(?<![^\W_])[\dOoIlSBZ|]{1,4}(?![^\W_])", "#", t.strip())
        alone = lambda t: sum(c.isalpha() for c in t) <= 2 or not re.search(r"[^\W_]", _WITH_NUMBER.sub("", t)) or bool(_NUMBER.match(t))
        for pages in documents:
            seen: dict[tuple, set] = {}
            for k, lines in enumerate(pages):
                for i in outer_lines(lines):
                    for kind, key in (("t", skeleton(lines[i])), ("n", figures(lines[i]))):
                        seen.setdefault((kind, i < 2, key), set()).add((k, lines[i].strip().lower()))
            for k, lines in enumerate(pages):
                outer = set(outer_lines(lines))
                for i in range(len(lines)):
                    number = _figure_line(lines[i])
                    if i in outer:
                        alike = seen[("t", i < 2, skeleton(lines[i]))]
                        titles[0].append(title_features(lines, i))
                        titles[1].append(float(bool(skeleton(lines[i])) and not _NUMBER.match(lines[i]) and len({p for p, _ in alike}) > 1))
                    if number:
                        others = seen.get(("n", i < 2, figures(lines[i])), set()) if i in outer else set()
                        numbers[0].append(number_features(lines, i))
                        numbers[1].append(float(alone(lines[i]) and any(p != k and t != lines[i].strip().lower() for p, t in others)))
        self.titles, self.numbers = (Boosted(rounds=40).fit(np.array(x, dtype=float), np.array(y)) if len(y) >= LEAST_TRAINING and sum(y) >= 10 and sum(y) < len(y) else None for x, y in (titles, numbers))

    def title(self, rows: list[list[float]]) -> np.ndarray:
        """Whether lines may be running titles; that they are repeated is to be seen yet, so a small chance is enough."""
        x = np.array(rows, dtype=float)
        return ((x[:, 0] > 0) & (x[:, 1] + x[:, 2] + x[:, 16] == 0)) if self.titles is None else (self.titles.predict(x) > MAYBE_TITLE) & (x[:, 16] == 0)

    def number(self, rows: list[list[float]]) -> np.ndarray:
        x = np.array(rows, dtype=float)
        return x[:, 0] > 0 if self.numbers is None else self.numbers.predict(x) > 0.5


MAYBE_TITLE = 0.1


def _figure_line(line: str) -> bool:
    """A short line with a figure, or what may be a misread one."""
    return len(line.split()) <= 6 and len(line) <= 40 and bool(re.search(r"\d|(?<![^\W\d_])[OoIlSBZ|]{1,3}(?![^\W\d_])", line))


def learn_furniture(pages: DataFrame, n: int = 1500) -> Furniture:
    """From about ``n`` pages of documents with several, by a hash of the document; of a longer one ten pages at most."""
    some = pages.where((F.length("text") > 0) & F.col("doc_id").isNotNull())
    many = some.groupBy("doc_id").agg(F.count("*").alias("pages")).where("pages > 1")
    total = many.agg(F.sum(F.least("pages", F.lit(10)))).first()[0] or 0
    picked = many.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, int(total) // n))) == 0).select("doc_id").limit(n)
    few = some.join(picked, "doc_id").withColumn("at", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_id"))).where("at <= 10")
    documents: dict[str, list] = {}
    for r in few.select("doc_id", "page_id", "text").limit(10 * n).collect():
        documents.setdefault(r.doc_id, []).append((r.page_id, page_lines(r.text)))
    return Furniture([[lines for _, lines in sorted(documents[d])] for d in sorted(documents)])


def _heads(furniture: Furniture):
    def run(batches):
        for pdf in batches:
            rows, x = [], []
            for doc, page, text in zip(pdf["doc_id"], pdf["page_id"], pdf["text"]):
                lines = page_lines(text)
                for i in outer_lines(lines):
                    rows.append((doc, page, i, lines[i]))
                    x.append(title_features(lines, i))
            keep = furniture.title(x) if x else []
            yield pd.DataFrame([(*r[:3], skeleton(r[3])) for r, ok in zip(rows, keep) if ok], columns=["doc_id", "page_id", "line", "skeleton"])

    return run


def running_headers(pages: DataFrame, furniture: Furniture) -> DataFrame:
    """(page_id, line): title lines that stand at the head or foot of at least two pages of their document."""
    heads = pages.where(F.length("text") > 0).select("doc_id", "page_id", "text").mapInPandas(_heads(furniture), "doc_id string, page_id string, line bigint, skeleton string").where("skeleton <> ''")
    often = heads.groupBy("doc_id", "skeleton").agg(F.countDistinct("page_id").alias("pages")).where("pages > 1").select("doc_id", "skeleton")
    return heads.join(often, ["doc_id", "skeleton"]).select("page_id", "line").distinct()


def _scan(known, usual, furniture: Furniture):
    """Per page: page numbers, headers, pairs of words that may be one cut word, and the words still to be judged.

    A word beside such a pair bears its line in ``before`` (the pair of the line above) or ``after`` (that of its own).
    ``usual`` shapes of words with digits are near no more frequent ones, so their words need no judgement.
    """

    def run(batches):
        good, plain = known.value, usual.value
        for pdf in batches:
            rows = []
            texts = [page_lines(t) for t in pdf["text"]]
            figures = [(k, i) for k, lines in enumerate(texts) for i in outer_lines(lines) if _figure_line(lines[i])]
            numbers = {at for at, yes in zip(figures, furniture.number([number_features(texts[k], i) for k, i in figures])) if yes} if figures else set()
            for at, (page, lines, heads) in enumerate(zip(pdf["page_id"], texts, pdf["heads"])):
                if not lines:
                    continue
                words = [t.split() for t in lines]
                heads = set() if heads is None else {int(h) for h in heads}
                n = len(lines)
                rows += [(page, i, "header", None, None, None, None) for i in heads]
                for i in outer_lines(lines):
                    inner = i == 1 and 0 not in heads or i == n - 2 and i > 1 and n - 1 not in heads
                    if i not in heads and not (inner and i not in (0, n - 1)) and (at, i) in numbers:
                        rows.append((page, i, "page_number", None, None, None, None))
                maybe = {i for i in range(n - 1) if maybe_cut(words[i][-1], words[i + 1][0], good)}
                rows += [(page, i, "pair", words[i][-1], words[i + 1][0], None, None) for i in maybe]
                for i, ws in enumerate(words):
                    seen = set()
                    for j, w in enumerate(ws):
                        k = core(w)
                        if k in good or not k:
                            continue
                        before = i - 1 if j == 0 and i - 1 in maybe else None
                        after = i if j == len(ws) - 1 and i in maybe else None
                        if (k, before, after) in seen:
                            continue
                        seen.add((k, before, after))
                        bare = w.strip(_EDGE)
                        if "@" in k or len(k) < 2 and not k.isdigit():
                            continue
                        digits = sum(c.isdigit() for c in bare)
                        size = sum(c.isalnum() for c in bare)
                        number = digits and (2 * digits >= size or digits + sum(c in _DIGITS for c in bare) == size)
                        if number and digits < len(bare) and shape(bare) not in plain:
                            rows.append((page, i, "shape", bare, None, before, after))
                        if digits < size and (not number or 2 * digits < size):
                            rows.append((page, i, "word", k, None, before, after))
            out = pd.DataFrame(rows, columns=["page_id", "line", "noise", "form", "next", "before", "after"])
            yield out.astype({"before": "Int64", "after": "Int64"})

    return run


_PADDED = r"^[.,;:!?()\[\]{}«»\"“”„'’ …]+|[.,;:!?()\[\]{}«»\"“”„'’ …]+$"


class Vocabulary:
    """What the collection's counts say about its words: all forms, and a dictionary of the most frequent ones.

    Counts come from the texts of ``pages``, so words delivered twice do not count twice; where ``words`` has a word more
    than four times as often, or alone, it speaks of pages that are not at hand and its count holds. Confidences come from it. ``inside`` counts a form where it neither begins a line with a small letter nor stands
    before such a line: parts of cut words stand nowhere else, so a form never seen inside is no word that others could
    be misread from.
    """

    def __init__(self, words: DataFrame, pages: DataFrame | None = None):
        sure = [F.sum(F.when(F.col("confidence") > 0, F.col("confidence"))).alias("s"), F.count(F.when(F.col("confidence") > 0, 1)).alias("c")]
        raw = words.where("text is not null").groupBy("text").agg(F.count("*").alias("n"), F.count("*").alias("inside"), *sure)
        if pages is not None:
            joint = "\u0001"  # marks the words on both sides of a line end that a cut word may span
            marked = F.regexp_replace("text", r"[^\S\n]*\n[^\S\n]*(?=\p{Ll})", f"{joint}\n{joint}")
            seen = pages.where(F.length("text") > 0).select(F.explode(F.split(marked, r"(?U)\s+")).alias("w")).select(F.replace("w", F.lit(joint), F.lit("")).alias("text"), F.contains("w", F.lit(joint)).alias("edge"))
            seen = seen.where("text <> ''").groupBy("text").agg(F.count("*").alias("n"), F.count(F.when(~F.col("edge"), 1)).alias("inside"))
            seen = seen.withColumnsRenamed({"n": "seen", "inside": "seen_inside"})
            elsewhere = F.col("seen").isNull() | (F.coalesce("n", F.lit(0)) > 4 * F.col("seen"))
            raw = seen.join(raw, "text", "full").select("text", F.when(elsewhere, F.col("n")).otherwise(F.col("seen")).alias("n"), F.when(elsewhere, F.col("inside")).otherwise(F.col("seen_inside")).alias("inside"), "s", F.coalesce("c", F.lit(0)).alias("c"))
        raw = cut_lineage(raw)
        forms = raw.withColumn("form", core_column(F.col("text"))).where("length(form) > 0")
        self.forms = cut_lineage(forms.groupBy("form").agg(F.sum("n").alias("n"), F.sum("inside").alias("inside"), (F.sum("s") / F.greatest(F.sum("c"), F.lit(1))).alias("sure")))
        totals = raw.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("c").alias("c")).first()
        self.total = totals.n or 0
        # at most 1 / LEAST_SHARE forms can reach the share, whatever the collection
        self.least = max(LEAST_WORD, self.total * LEAST_SHARE)
        frequent = self.forms.where((F.col("n") >= self.least) & ~F.col("form").rlike(r"\d|@"))
        frequent = frequent.select("form", "n", "sure", (F.col("inside") >= LEAST_WORD).alias("whole")).collect()
        self.words = {r.form: (float(r.n), float(r.sure or 0.0)) for r in frequent}
        self.whole = {r.form: self.words[r.form] for r in frequent if r.whole}
        by_shape = raw.where(F.col("text").rlike(r"\d")).withColumn("k", F.regexp_replace(F.col("text"), _PADDED, ""))
        by_shape = by_shape.withColumn("k", F.regexp_replace(F.regexp_replace(F.regexp_replace("k", r"\p{Lu}", "A"), r"\p{Ll}", "a"), r"\p{Nd}", "9"))
        known = F.sum(F.when(F.col("c") > 0, F.col("s"))) / F.sum(F.when(F.col("c") > 0, F.col("c")))
        bare = F.regexp_replace("text", _PADDED, "")
        self.shape_counts = cut_lineage(by_shape.groupBy("k").agg(F.sum("n").alias("n"), known.alias("shape_sure"), F.max(bare).alias("example")))
        self.near_shapes = cut_lineage(near_shapes(self.shape_counts))
        frequent = self.shape_counts.where((F.col("n") >= self.least) & (F.col("n") >= LEAST_COUNT))
        self.usual = {r.k for r in frequent.join(self.near_shapes, "k", "left_anti").select("k").collect()}
        some = lambda df, *key: df.orderBy(F.xxhash64(*key)).limit(2 * TRAIN_WORDS).collect()
        apart = self.shape_counts.join(self.near_shapes, "k", "left_anti").where(F.col("n") >= 10 * LEAST_COUNT).select("k", F.col("n").alias("shape_n"))
        self.numbers = [(r.bare, float(r.shape_n)) for r in some(by_shape.select("k", bare.alias("bare")).join(apart, "k"), "bare")]
        self.near_sample = [(r.example, r.n, r.shape_sure or 0.0, r.cand, r.m) for r in some(self.near_shapes, "k", "cand")]
        # letters around a digit or a bar are misread for certain: their confidence stands for that of misread words
        spoilt = self.forms.where(F.col("form").rlike(r"^\p{L}+[0156|]\p{L}+$") & (F.col("sure") > 0))
        low = spoilt.agg(F.percentile_approx("sure", 0.5, 1000)).first()[0]
        # a form seen often has a mean confidence near that of true words or near that of misread ones
        self.sure_split = (totals.s / totals.c + low) / 2 if totals.c and low else 0.0
        self.sure_high = (totals.s / totals.c * 3 + self.sure_split) / 4 if totals.c else 0.0
        self.rare_sure = sorted(r.sure for r in spoilt.where("n <= 3").orderBy(F.xxhash64("form")).select("sure").limit(2000).collect())
        # any order of the q-grams finds the same pairs; this one, rare ones first, finds them soonest
        seen_grams: dict[str, int] = {}
        for w in self.words:
            for g in {f"^{w}$"[i : i + 2] for i in range(len(w) + 1)}:
                seen_grams[g] = seen_grams.get(g, 0) + 1
        self.order = dict(sorted(seen_grams.items(), key=lambda t: (-t[1], t[0]))[:5000])


def _gram_keys(order: dict[str, int], lengths: range):
    """Rarest q-grams of each form, as it is and folded, under the lengths of the words it may meet."""

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                keys = {(g, len(w), i) for w in {r[0], fold(r[0])} for g, i in rarest_grams(w, order)}
                rows += [(f"{g}{n + d}", i, *r) for g, n, i in keys for d in lengths]
            yield pd.DataFrame(rows, columns=["gram", "place", *pdf.columns])

    return run


def _judge(ranker: Ranker):
    def run(batches):
        for pdf in batches:
            rows = [features(f, n, s if s > 0 else 0.0, c, m) for f, n, s, c, m in zip(pdf["form"], pdf["n"], pdf["sure"], pdf["cand"], pdf["m"])]
            yield pdf[["form", "cand"]].assign(score=ranker.score(rows))

    return run


def corrections(forms: DataFrame, v: Vocabulary, ranker: Ranker | None = None) -> DataFrame:
    """(form, cand, score): the forms that are misread, each with the word that replaces it.

    Forms and words seen ``LEAST_WORD`` times inside lines meet on the q-grams that two edits can't all destroy, at places and of
    lengths two apart at most. Pairs within two edits (letters read as two count as one), whose word is ``RATIO`` times
    as frequent (``RATIO_RARE`` within one edit), are ranked. Both sides are distinct forms, not occurrences. Forms seen
    ``OFTEN`` times, of which the recogniser was sure, are left alone; likewise those seen thrice and never inside a line,
    which are parts of cut words.
    """
    ranker = ranker or Ranker(v.whole, v.rare_sure, v.sure_split)
    # numbers with a letter or two are judged by their shape
    some = forms.where(r"not form rlike '@' and 2 * length(regexp_replace(form, '\\P{Nd}', '')) < length(regexp_replace(form, '[^\\p{L}\\p{Nd}]', ''))")
    if v.sure_split:
        apart = (F.col("n") < 3) | (F.col("inside") > 0) if "inside" in forms.columns else F.lit(True)
        some = some.where(((F.col("n") < OFTEN) & apart) | F.col("sure").isNull() | (F.col("sure") < v.sure_split))
    some = some.select("form", F.col("n").cast("double"), F.col("sure").cast("double"))
    left = some.mapInPandas(_gram_keys(v.order, range(-EDITS, EDITS + 1)), "gram string, place int, form string, n double, sure double")
    known = v.forms.where((F.col("inside") >= LEAST_WORD) & F.col("form").rlike(r"^\p{L}[\p{L}'’-]+$")).select(F.col("form").alias("cand"), F.col("n").cast("double").alias("m"))
    right = known.mapInPandas(_gram_keys(v.order, range(1)), "gram string, place int, cand string, m double").withColumnRenamed("place", "at")
    met = left.join(right, "gram").where((F.abs(F.col("place") - F.col("at")) <= EDITS) & (F.col("m") >= RATIO_RARE * F.col("n")) & (F.col("form") != F.col("cand")))
    met = met.groupBy("form", "cand").agg(F.first("n").alias("n"), F.first("sure").alias("sure"), F.first("m").alias("m"))
    near = lambda k: (F.levenshtein("form", "cand", k) >= 0) | (F.levenshtein(folded(F.col("form")), folded(F.col("cand")), k) >= 0)
    met = met.where(F.when(F.length("form") <= 3, near(1)).otherwise(near(EDITS)) & ((F.col("m") >= RATIO * F.col("n")) | near(1)))
    ranked = met.mapInPandas(_judge(ranker), "form string, cand string, score double").where("score > 0.5")
    return ranked.groupBy("form").agg(F.max(F.struct("score", "cand")).alias("b")).select("form", "b.cand", "b.score")


def _neighbours(pages: DataFrame, n: int = 1500) -> list[tuple[str, str]]:
    """Training pairs: words side by side inside lines, which are not one cut word, of about ``n`` pages by a hash of their id."""
    some = pages.where(F.length("text") > 0)
    every = max(1, some.count() // n)
    rows = some.where(F.pmod(F.xxhash64("page_id"), F.lit(every)) == 0).orderBy("page_id").select("text").limit(2 * n).collect()
    rnd = random.Random(11)
    out: list[tuple[str, str]] = []
    for r in rows:
        for line in page_lines(r.text):
            w = line.split()
            if len(w) > 2:
                k = rnd.randrange(len(w) - 2)
                if w[k][-1:].isalpha() and w[k + 1][:1].islower() and rnd.random() < 0.3:
                    out.append((w[k], w[k + 1]))
                out += [(a, b) for a, b in zip(w[:-2], w[1:-1]) if a[-1] in MARKS and len(a) > 1]
    return out


def _suspended(pages: DataFrame) -> DataFrame:
    """(form, n): how often words end in a hyphen inside lines, over all pages."""
    some = pages.where(F.length("text") > 0).select(F.explode(F.regexp_extract_all("text", F.lit(rf"(\S+)[{MARKS}](?=[^\S\n]+\S)"), F.lit(1))).alias("text"))
    return some.select(core_column(F.col("text")).alias("form")).groupBy("form").agg(F.count("*").alias("n"))


def _whole(batches):
    for pdf in batches:
        ends = [last.rstrip(MARKS) for last in pdf["last"]]
        yield pdf.assign(whole=[core(a + b) for a, b in zip(ends, pdf["first"])], compound=[core(f"{a}-{b}") for a, b in zip(ends, pdf["first"])])


def _findings(pages: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what is found on each line, words to be judged included; the replaced forms with their words)."""
    v = Vocabulary(words, pages)
    furniture = learn_furniture(pages)
    heads = running_headers(pages, furniture).groupBy("page_id").agg(F.collect_set("line").alias("heads"))
    lines = pages.where(F.length("text") > 0).select("page_id", "text").join(heads, "page_id", "left")
    ranker = Ranker(v.whole, v.rare_sure, v.sure_split)
    fixes = cut_lineage(corrections(v.forms, v, ranker))
    wrong = {r.form for r in fixes.join(v.forms.where(F.col("n") >= v.least), "form", "left_semi").select("form").collect()}
    good = {w: s for w, s in v.words.items() if w not in wrong}
    known = pages.sparkSession.sparkContext.broadcast(good)
    found = cut_lineage(lines.mapInPandas(_scan(known, pages.sparkSession.sparkContext.broadcast(v.usual), furniture), "page_id string, line bigint, noise string, form string, next string, before bigint, after bigint"))

    clean = v.forms.join(fixes, "form", "left_anti").select("form", "n")
    counts = cut_lineage(clean.select(F.concat(F.lit("f"), "form").alias("k"), "n").union(_suspended(pages).select(F.concat(F.lit("m"), "form"), "n")))
    joiner = Joiner(good, _neighbours(pages))
    keys = pages.sparkSession.createDataFrame([(k,) for k in sorted(joiner.keys())], "k string")
    joiner.fit({r.k: float(r.n) for r in counts.join(keys, "k", "left_semi").collect()})
    pairs = found.where("noise = 'pair'").select("page_id", "line", F.col("form").alias("last"), F.col("next").alias("first"))
    cut = cut_lineage(cut_pairs(pairs.select("last", "first").distinct(), counts, known, joiner).mapInPandas(_whole, "last string, first string, whole string, compound string"))
    cuts = cut_lineage(pairs.join(cut, ["last", "first"]).select("page_id", "line", "whole", "compound"))

    # a cut word is known if it is a word as one or as a compound
    whole = cut.where(~F.col("whole").rlike(r"\d")).select("whole", "compound").distinct()
    n = counts.where(F.col("n") >= LEAST_WORD).withColumn("k", F.expr("substr(k, 2)")).where("k <> ''")
    whole = whole.join(n.select(F.col("k").alias("whole")), "whole", "left_anti").join(n.select(F.col("k").alias("compound")), "compound", "left_anti")
    whole = whole.select(F.col("whole").alias("form"), F.lit(1.0).alias("n"), F.lit(60.0).alias("sure")).distinct()
    all_fixes = cut_lineage(fixes.select("form", "cand").union(corrections(whole, v, ranker).select("form", "cand")).dropDuplicates(["form"]))

    place = found.select("page_id", "line", "noise", "form", "before", "after")
    rare = place.where("noise = 'shape'")
    misread = misread_numbers(rare.select("form").distinct(), v.near_shapes, v.forms.select("form", "sure"), ShapeRanker(v.numbers, v.near_sample, v.rare_sure, v.sure_split, v.sure_high))
    rare = rare.join(misread, "form", "left_semi").withColumn("noise", F.lit("char")).withColumn("form", F.lit(None).cast("string"))
    wrongly = place.where("noise = 'word'").join(fixes.select("form"), "form", "left_semi").select(place.columns)
    words_at = rare.select(place.columns).union(wrongly)
    edge = words_at.where("before is not null or after is not null")
    for side in ("before", "after"):  # parts of cut words are judged as whole words
        edge = edge.join(cuts.select("page_id", F.col("line").alias(side)), ["page_id", side], "left_anti")
    parts = [
        place.where("noise in ('header', 'page_number')"), words_at.where("before is null and after is null"), edge.select(place.columns),
        cuts.select("page_id", "line", F.lit("hyphen"), F.lit(None).cast("string"), F.lit(None), F.lit(None)),
        cuts.join(all_fixes.select(F.col("form").alias("whole")), "whole", "left_semi").select("page_id", "line", F.lit("cut"), "whole", F.lit(None), F.lit(None)),
    ]
    judged = parts[0]
    for p in parts[1:]:
        judged = judged.union(p)
    return judged.select("page_id", "line", "noise", "form"), all_fixes


def line_noise(pages: DataFrame, words: DataFrame) -> DataFrame:
    """(page_id, line, noise): one row per line (non-blank lines from 0) and kind of noise.

    ``pages`` are current rows with page_id, doc_id, text; ``words`` have text and confidence, for mean confidences only,
    so words delivered twice do no harm. Null and blank pages give no rows. Misread words are joined back by their form:
    only words outside the frequent vocabulary take part, so no word of every page becomes a hot key.
    """
    found, _ = _findings(pages, words)
    return found.select("page_id", "line", F.when(F.col("noise").isin("word", "cut"), "char").otherwise(F.col("noise")).alias("noise")).distinct()


def _rebuild(batches):
    for pdf in batches:
        out = []
        for text, notes in zip(pdf["text"], pdf["notes"]):
            notes = [] if notes is None else list(notes)
            drop = {n["line"] for n in notes if n["noise"] in ("header", "page_number")}
            cut = {n["line"] for n in notes if n["noise"] == "hyphen"}
            fix: dict = {}
            for n in notes:
                if n["form"] is not None:
                    fix.setdefault(n["line"], {})[n["form"]] = n["cand"]
            out.append(_paragraphs(text or "", drop, cut, fix))
        yield pdf[["page_id"]].assign(text=out)


def _like(word: str, cand: str) -> str:
    """The candidate in the case of the word it replaces, with the punctuation around it."""
    bare = word.strip(_EDGE)
    new = cand.upper() if bare.isupper() and len(bare) > 1 else cand.capitalize() if bare[:1].isupper() else cand
    return word.replace(bare, new, 1)


def _paragraphs(text: str, drop: set, cut: set, fix: dict) -> str:
    """Lines joined to paragraphs: furniture left out, cut words closed, misread words replaced; blank lines part paragraphs."""
    paragraphs, now, i, glue = [], "", -1, None
    for raw in text.split("\n"):
        if not raw.strip():
            if now and glue is None:
                paragraphs.append(now)
                now = ""
            continue
        i += 1
        if i in drop:
            continue
        words = raw.split()
        for j, w in enumerate(words):
            k = core(w)
            if k in fix.get(i, {}) and not (i in cut and j == len(words) - 1):
                words[j] = _like(w, fix[i][k])
        line = " ".join(words)
        if glue is not None:
            a, b = glue, words[0]
            whole = core(a.rstrip(MARKS) + b)
            joined = fix.get(i - 1, {}).get(whole)
            first = _like(a.rstrip(MARKS) + b, joined) if joined else a.rstrip(MARKS) + b
            now = f"{now} {first}".strip()
            line = " ".join(words[1:])
            glue = None
        if i in cut and line:
            *before, last = line.split(" ")
            line, glue = " ".join(before), last
        now = f"{now} {line}".strip() if now else line
    if glue:
        now = f"{now} {glue}".strip()
    return "\n\n".join([*paragraphs, now] if now else paragraphs)


def repaired_pages(pages: DataFrame, words: DataFrame) -> DataFrame:
    """(page_id, text): the pages as continuous paragraphs without furniture, cut or misread words; blank pages as empty text."""
    found, fixes = _findings(pages, words)
    notes = found.join(fixes, "form", "left").where("form is null or cand is not null")
    notes = notes.groupBy("page_id").agg(F.collect_list(F.struct("line", "noise", "form", "cand")).alias("notes"))
    some = pages.select("page_id", F.coalesce("text", F.lit("")).alias("text")).join(notes, "page_id", "left")
    return some.mapInPandas(_rebuild, "page_id string, text string")


def _tables(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages = cut_lineage(current_rows(spark.read.parquet(f"{sf_dir}/ocr_results.parquet"), "page_id", "created_at", ["doc_id", "text"]))
    return pages, spark.read.parquet(f"{sf_dir}/ocr_words.parquet").select("text", "confidence")


def p5_found(spark, sf_dir: str) -> DataFrame:
    """(page_id, line, noise): noise of all current pages."""
    return line_noise(*_tables(spark, sf_dir))


def p5_paragraphs(spark, sf_dir: str) -> DataFrame:
    """(page_id, text): all current pages repaired."""
    return repaired_pages(*_tables(spark, sf_dir))
