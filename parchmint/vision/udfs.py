"""Image operators on columns: images are structs of width, height and data (one or three bytes a pixel, by rows), in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from parchmint.vision import detect as V
from parchmint.vision import kernels as K

IMAGE = "struct<width int, height int, data binary>"
QUALITY = "struct<sharpness double, brightness double, glare double, blurry boolean, too_dark boolean, has_glare boolean>"


def image(width: int, height: int, data: bytes) -> np.ndarray:
    a = np.frombuffer(data, dtype=np.uint8)
    n = width * height
    if n <= 0 or len(a) not in (n, 3 * n):
        raise ValueError("the data doesn't fit the size")
    return a.reshape(height, width) if len(a) == n else a.reshape(height, width, 3)


def _map(pdf: pd.DataFrame, f) -> list:
    """The function of each image; null for null images and for data that don't fit the size."""
    out = []
    for w, h, d in zip(pdf["width"], pdf["height"], pdf["data"]):
        try:
            out.append(None if d is None else f(image(int(w), int(h), d)))
        except ValueError:
            out.append(None)
    return out


def _rgb(a: np.ndarray) -> np.ndarray:
    return K.to_rgb(a) if a.ndim == 2 else a


def _gray(a: np.ndarray) -> np.ndarray:
    return a if a.ndim == 2 else K.to_gray(a)


def _frame(images: list) -> pd.DataFrame:
    rows = [(None, None, None) if a is None else (a.shape[1], a.shape[0], a.tobytes()) for a in images]
    return pd.DataFrame(rows, columns=["width", "height", "data"])


def _image_udf(f):
    @F.pandas_udf(IMAGE)
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _frame(_map(pdf, f))

    return run


def process(img: Column, preset: str, adjustments: dict | None = None) -> Column:
    """A scan preset, then manual adjustments."""
    return _image_udf(lambda a: K.process_image(_rgb(a), preset, adjustments))(img)


def resize(img: Column, most: int) -> Column:
    """Reduced so that the longer side has at most that many pixels."""

    def f(a: np.ndarray) -> np.ndarray:
        s = min(1.0, most / max(a.shape[:2]))
        return a if s >= 1 else K.resize(a, max(1, int(a.shape[1] * s + 0.5)), max(1, int(a.shape[0] * s + 0.5)))

    return _image_udf(f)(img)


def rotate(img: Column, turns: int) -> Column:
    return _image_udf(lambda a: K.rotate90(a, turns))(img)


def to_gray(img: Column) -> Column:
    return _image_udf(_gray)(img)


def split_double_page(img: Column) -> Column:
    """Left and right half; a middle column goes to the right."""
    left, right = _image_udf(lambda a: np.ascontiguousarray(a[:, : a.shape[1] // 2])), _image_udf(lambda a: np.ascontiguousarray(a[:, a.shape[1] // 2 :]))
    return F.array(left(img), right(img))


def clean_signature(img: Column) -> Column:
    """Ink alone as gray: light above 200 is nothing, below 120 full; cut to the ink with six pixels around it."""

    def f(a: np.ndarray) -> np.ndarray:
        alpha = np.clip((200 - _gray(a).astype(float)) / 80, 0, 1) * 255
        ys, xs = np.nonzero(alpha > 40)
        if not len(ys):
            return np.zeros((1, 1), np.uint8)
        y0, y1, x0, x1 = max(0, ys.min() - 6), ys.max() + 7, max(0, xs.min() - 6), xs.max() + 7
        return K.clamp(alpha[y0:y1, x0:x1])

    return _image_udf(f)(img)


@F.pandas_udf(IMAGE)
def rectify(pdf: pd.DataFrame, quad: pd.Series, size: pd.DataFrame) -> pd.DataFrame:
    """The part of the image inside a quad (8 numbers) as an upright picture of the given width and height."""
    out = []
    for (w, h, d), q, tw, th in zip(pdf[["width", "height", "data"]].itertuples(index=False), quad, size["width"], size["height"]):
        ok = d is not None and q is not None and len(q) == 8
        try:
            out.append(K.warp(image(int(w), int(h), d), np.asarray(q, dtype=float).reshape(4, 2), int(tw), int(th)) if ok else None)
        except ValueError:
            out.append(None)
    return _frame(out)


@F.pandas_udf("string")
def d_hash(pdf: pd.DataFrame) -> pd.Series:
    return pd.Series(_map(pdf, K.d_hash), dtype=object)


@F.pandas_udf("struct<ink double, blank boolean>")
def blank_score(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([(None, None) if r is None else r for r in _map(pdf, lambda a: K.blank_page_score(_rgb(a)))], columns=["ink", "blank"])


@F.pandas_udf("struct<turns int, confidence double>")
def text_direction(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([(None, None) if r is None else r for r in _map(pdf, lambda a: K.text_direction(_rgb(a)))], columns=["turns", "confidence"])


@F.pandas_udf("struct<quad array<double>, score double, partial boolean>")
def detect(pdf: pd.DataFrame) -> pd.DataFrame:
    """Outline (8 numbers or null), score, and whether it leaves the frame."""
    rows = []
    for r in _map(pdf, lambda a: V.detect_document(_gray(a))):
        rows.append((None, None, None) if r is None else (None if r[0] is None else r[0].ravel().tolist(), r[1], r[2]))
    return pd.DataFrame(rows, columns=["quad", "score", "partial"])


@F.pandas_udf(QUALITY)
def quality(pdf: pd.DataFrame, quad: pd.Series) -> pd.DataFrame:
    """Sharpness, brightness and glare, inside the quad if there is one."""
    rows = []
    for w, h, d, q in zip(pdf["width"], pdf["height"], pdf["data"], quad):
        ok = d is not None and len(d) in (w * h, 3 * w * h)
        rows.append(V.assess_quality(_gray(image(int(w), int(h), d)), None if q is None or len(q) != 8 else np.asarray(q, dtype=float).reshape(4, 2)) if ok else {})
    return pd.DataFrame(rows, columns=["sharpness", "brightness", "glare", "blurry", "too_dark", "has_glare"])


def header_size(content: Column) -> Column:
    """Struct of width, height, components of a PNG or JPEG file's header; null for anything else."""

    @F.pandas_udf("struct<width int, height int, components int>")
    def run(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_size(bytes(d)) if d is not None else (None, None, None) for d in data], columns=["width", "height", "components"])

    return run(content)


def _size(d: bytes) -> tuple:
    if d[:8] == b"\x89PNG\r\n\x1a\n" and len(d) >= 26:
        return int.from_bytes(d[16:20], "big"), int.from_bytes(d[20:24], "big"), {0: 1, 2: 3, 3: 3, 4: 2, 6: 4}.get(d[25], 3)
    i = 2
    while d[:2] == b"\xff\xd8" and i + 9 < len(d):
        if d[i] != 0xFF:
            break
        m = d[i + 1]
        if m == 0xFF:
            i += 1
        elif 0xC0 <= m <= 0xCF and m not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(d[i + 7 : i + 9], "big"), int.from_bytes(d[i + 5 : i + 7], "big"), d[i + 9]
        else:
            i += 2 if m == 1 or 0xD0 <= m <= 0xD9 else 2 + int.from_bytes(d[i + 2 : i + 4], "big")
    return None, None, None


def best_orientation(words: int, confidence: float, candidates: list[tuple[int, int, float]]) -> int:
    """The quarter turns to read a page with: another one only if the page reads badly and that one reads clearly better.

    Badly is a confidence below 62 or fewer than 4 words; clearly better is 12 more confidence and at least half the words.
    """
    if confidence >= 62 and words >= 4:
        return 0
    good = [(c, t) for t, n, c in candidates if c >= confidence + 12 and n >= words * 0.5]
    return max(good)[1] if good else 0
