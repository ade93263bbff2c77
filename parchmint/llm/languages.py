"""Language of documents and of their blocks by a string kernel.

Two blocks are compared by the n-grams (1 to ``GRAMS`` characters) that both hold, present or absent: the blended-spectrum
presence kernel, normalised to 1 for equal blocks. Kernel ridge regression, one language against the rest, is solved on
Nystroem features of ``LANDMARKS`` blocks. The presence kernel is linear in the presence vector, so landmarks and ridge
weights fold into one matrix, and scoring is one product of a batch's presence matrix with it.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.operators.current import current_rows
from parchmint.session import cut_lineage

GRAMS = 4
WIDTH = 1 << 14
LANDMARKS = 256
RIDGE = 1e-2
SAMPLE = 1500
SAMPLE_BLOCKS = 2500
LEAST_WORDS = 8
BATCH = 256

# Usual codes of the five languages.
CODES = {"fr": "fra", "fra": "fra", "fre": "fra", "en": "eng", "eng": "eng", "de": "deu", "deu": "deu", "ger": "deu", "es": "spa", "spa": "spa", "it": "ita", "ita": "ita"}
NO_LABEL = {"", "und"}

_BLANK = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
_HYPHEN = re.compile(r"(?<=\w)[-‐‑¬]\n(?=\w)")
_REST = re.compile(r"[\W\d_]+")


def label_of(text: str | None) -> frozenset:
    """The languages that a label names; none for null, empty and ``und``. Unknown codes stay as they are."""
    t = (text or "").strip().lower()
    return frozenset() if t in NO_LABEL else frozenset(CODES.get(c.strip(), c.strip()) for c in t.split("+") if c.strip())


def blocks_of(text: str | None) -> list[str]:
    """The pieces between blank lines, without empty ones."""
    return [b for b in _BLANK.split((text or "").strip("\n")) if b.strip()]


def counts(block: str) -> bool:
    """Whether a block has enough words with a letter to have a language."""
    return sum(any(c.isalpha() for c in w) for w in block.split()) >= LEAST_WORDS


def presence(blocks: list[str]) -> np.ndarray:
    """Rows of n-gram presence, each of length 1."""
    out = np.zeros((len(blocks), WIDTH), dtype=np.float32)
    with np.errstate(over="ignore"):
        for i, b in enumerate(blocks):
            t = " " + _REST.sub(" ", _HYPHEN.sub("", b).lower()).strip() + " "
            c = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
            h = np.zeros(len(c), dtype=np.uint64)
            for n in range(1, GRAMS + 1):
                if len(c) < n:
                    break
                h = h[: len(c) - n + 1] * np.uint64(0x100000001B3) + c[n - 1 :] + np.uint64(n)
                m = h * np.uint64(0x9E3779B97F4A7C15)
                out[i, (m >> np.uint64(64 - 14)).astype(np.int64)] = 1
    out /= np.maximum(np.sqrt(out.sum(axis=1, keepdims=True)), 1)
    return out


def fit(blocks: list[str], labels: list[str], seed: int = 7) -> tuple[np.ndarray, list[str]]:
    """(matrix of WIDTH rows and a column per language, languages), with wrongly labelled blocks left out of a second fit."""
    langs = sorted(set(labels))
    x, y = presence(blocks), np.array([langs.index(v) for v in labels])

    def solve(rows: np.ndarray) -> np.ndarray:
        pick = np.random.default_rng(seed).permutation(rows)[:LANDMARKS]
        z = x[pick]
        value, vector = np.linalg.eigh(z @ z.T)
        keep = value > 1e-6 * value.max()
        root = vector[:, keep] / np.sqrt(value[keep])
        phi = (x[rows] @ z.T) @ root
        goal = np.where(y[rows, None] == np.arange(len(langs)), 1.0, -1.0)
        weight = 1.0 / np.bincount(y[rows], minlength=len(langs))[y[rows]]
        weight *= len(rows) / weight.sum()
        left = (phi * weight[:, None]).T @ phi + RIDGE * len(rows) / LANDMARKS * np.eye(phi.shape[1])
        return (z.T @ (root @ np.linalg.solve(left, (phi * weight[:, None]).T @ goal))).astype(np.float32)

    rows = np.arange(len(blocks))
    g = solve(rows)
    right = (x @ g).argmax(axis=1) == y
    return (solve(rows[right]) if right.sum() >= len(langs) else g), langs


def predict(blocks: list[str], g: np.ndarray, langs: list[str]) -> tuple[list[str], np.ndarray]:
    """(language, confidence) of each block; the confidence is a softmax over the one-versus-rest scores."""
    best, sure = [], []
    for i in range(0, len(blocks), BATCH):
        s = presence(blocks[i : i + BATCH]) @ g
        e = np.exp(4 * (s - s.max(axis=1, keepdims=True)))
        best += [langs[k] for k in s.argmax(axis=1)]
        sure.append((e / e.sum(axis=1, keepdims=True)).max(axis=1))
    return best, np.concatenate(sure) if sure else np.zeros(0)


def train(pages: DataFrame) -> tuple[np.ndarray, list[str]] | None:
    """A model of the blocks of about ``SAMPLE`` pages whose label names one language (of all pages, where none is so labelled: None).

    ``pages`` has page_id, text, language. The pages are chosen by a hash of their id, about as many of each language; the fit takes
    ``SAMPLE_BLOCKS`` of their blocks, which bounds the driver's memory (160 MB).
    """
    code = F.lower(F.trim("language"))
    table = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])
    known = pages.where(F.length("text") > 0).select("page_id", "text", table[code].alias("lang")).where("lang is not null")
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if len(sizes) < 2:
        return None
    share = max(1, SAMPLE // len(sizes))
    every = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, max(1, n // share))])
    rows = known.where(F.pmod(F.xxhash64("page_id"), every[F.col("lang")]) == 0).orderBy(F.xxhash64("page_id")).limit(2 * SAMPLE).collect()
    pairs = [(b, r.lang) for r in rows for b in blocks_of(r.text) if counts(b)][:SAMPLE_BLOCKS]
    if len({v for _, v in pairs}) < 2:
        return None
    return fit([b for b, _ in pairs], [v for _, v in pairs])


def _score(g: np.ndarray, langs: list[str]):
    def run(batches):
        for pdf in batches:
            ids, numbers, blocks = [], [], []
            for page, text in zip(pdf["page_id"], pdf["text"]):
                for no, b in enumerate(blocks_of(text), 1):
                    if counts(b):
                        ids.append(page)
                        numbers.append(no)
                        blocks.append(b)
            lang, sure = predict(blocks, g, langs)
            out = pd.DataFrame({"page_id": ids, "block_no": numbers, "lang": lang, "confidence": sure.astype(float)})
            labels = dict(zip(pdf["page_id"], pdf["language"]))
            found = out.groupby("page_id")["lang"].agg(frozenset)
            wrong = {p: found[p] != label_of(labels[p]) or len(found[p]) > 1 for p in found.index}
            yield out.assign(label_differs=[bool(wrong[p]) for p in out["page_id"]])

    return run


def block_languages(pages: DataFrame, model: tuple[np.ndarray, list[str]]) -> DataFrame:
    """(page_id, block_no, lang, confidence, label_differs) of every block with at least ``LEAST_WORDS`` words.

    ``label_differs`` holds where the page's label is missing, names other languages than its blocks, or the blocks have
    several. Null, blank and short texts give no rows. One map without a shuffle.
    """
    some = pages.where(F.length("text") > 0).select("page_id", "text", "language")
    return some.mapInPandas(_score(*model), "page_id string, block_no bigint, lang string, confidence double, label_differs boolean")


def page_languages(blocks: DataFrame) -> DataFrame:
    """(page_id, lang, confidence): the languages of a page joined by ``+`` in order of their first block, and the mean confidence."""
    per = blocks.groupBy("page_id", "lang").agg(F.min("block_no").alias("first"), F.sum("confidence").alias("s"), F.count("*").alias("n"))
    return per.groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "lang"))), lambda r: r["lang"]), "+").alias("lang"), (F.sum("s") / F.sum("n")).alias("confidence"))


def _pages(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/ocr_results.parquet")
    return cut_lineage(current_rows(pages, "page_id", "created_at", ["text", "language"]))


def _blocks(spark, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    model = train(pages)
    if model is None:
        return spark.createDataFrame([], "page_id string, block_no bigint, lang string, confidence double, label_differs boolean")
    return block_languages(pages, model)


def p3_found(spark, sf_dir: str) -> DataFrame:
    """(page_id, block_no, lang): all counted blocks of pages whose label is missing or wrong, or that mix languages."""
    return _blocks(spark, sf_dir).where("label_differs").select("page_id", "block_no", "lang")


def p3_pages(spark, sf_dir: str) -> DataFrame:
    """(page_id, lang, confidence): the label that each page should have."""
    return page_languages(_blocks(spark, sf_dir))
