"""Plane geometry on columns (points are structs of x and y, polygons arrays of them) and small linear algebra in numpy."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def distance(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def cross(o: Column, a: Column, b: Column) -> Column:
    return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])


def _next(poly: Column) -> Column:
    """The polygon's vertices shifted by one."""
    return F.concat(F.slice(poly, 2, F.greatest(F.size(poly) - 1, F.lit(0))), F.slice(poly, 1, 1))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def signed_area(poly: Column) -> Column:
    return _sum(F.zip_with(poly, _next(poly), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])) / 2


def polygon_area(poly: Column) -> Column:
    return F.abs(signed_area(poly))


def perimeter(poly: Column) -> Column:
    return _sum(F.zip_with(poly, _next(poly), distance))


def centroid(poly: Column) -> Column:
    n = F.size(poly)
    return F.struct((_sum(F.transform(poly, lambda p: p["x"])) / n).alias("x"), (_sum(F.transform(poly, lambda p: p["y"])) / n).alias("y"))


def is_convex(poly: Column) -> Column:
    """All turns go one way; straight ones don't count. Fewer than three vertices are not convex."""
    after = F.concat(F.slice(poly, 3, F.greatest(F.size(poly) - 2, F.lit(0))), F.slice(poly, 1, 2))
    pairs = F.arrays_zip(poly.alias("a"), _next(poly).alias("b"), after.alias("c"))
    turns = F.filter(F.transform(pairs, lambda t: F.signum(cross(t["a"], t["b"], t["c"]))), lambda s: s != 0)
    return (F.size(poly) >= 3) & (F.size(F.array_distinct(turns)) <= 1)


def angle_at(a: Column, b: Column, c: Column) -> Column:
    """Degrees of the angle at b; 0 where a side has no length."""
    ux, uy, vx, vy = a["x"] - b["x"], a["y"] - b["y"], c["x"] - b["x"], c["y"] - b["y"]
    size = F.hypot(ux, uy) * F.hypot(vx, vy)
    return F.when(size == 0, 0.0).otherwise(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ux * vx + uy * vy) / size)))))


def quad_angles(q: Column) -> Column:
    return F.array(*[angle_at(q[(i + 3) % 4], q[i], q[(i + 1) % 4]) for i in range(4)])


def order_quad(q: Column) -> Column:
    """Clockwise on screen from the corner with the least x + y (the upper one on ties)."""
    c = centroid(q)
    turned = F.transform(F.array_sort(F.transform(q, lambda p: F.struct(F.atan2(p["y"] - c["y"], p["x"] - c["x"]).alias("a"), p["x"].alias("x"), p["y"].alias("y")))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    first = F.array_min(F.transform(turned, lambda p, i: F.struct((F.round((p["x"] + p["y"]) / EPS) * EPS).alias("k"), p["y"].alias("y"), i.alias("i"))))["i"]
    return F.concat(F.slice(turned, first + 1, F.lit(4)), F.slice(turned, F.lit(1), first))


def scale_quad(q: Column, sx: Column, sy: Column | None = None) -> Column:
    sy = sx if sy is None else sy
    return F.transform(q, lambda p: F.struct((p["x"] * sx).alias("x"), (p["y"] * sy).alias("y")))


def clamp_quad(q: Column, width: Column, height: Column) -> Column:
    keep = lambda v, most: F.least(most.cast("double"), F.greatest(F.lit(0.0), v))
    return F.transform(q, lambda p: F.struct(keep(p["x"], width).alias("x"), keep(p["y"], height).alias("y")))


def full_frame_quad(width: Column, height: Column, inset: float = 0.0) -> Column:
    i = F.lit(float(inset))
    return F.array(point(i, i), point(width - i, i), point(width - i, height - i), point(i, height - i))


def inset_quad(q: Column, f: float) -> Column:
    """Every corner moved towards the centroid by twice the share ``f``."""
    c = centroid(q)
    return F.transform(q, lambda p: F.struct((p["x"] + (c["x"] - p["x"]) * (2 * f)).alias("x"), (p["y"] + (c["y"] - p["y"]) * (2 * f)).alias("y")))


def max_corner_distance(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, distance))


def line_intersection(p1: Column, p2: Column, p3: Column, p4: Column) -> Column:
    """Where the lines meet; null if they are parallel."""
    d1x, d1y, d2x, d2y = p2["x"] - p1["x"], p2["y"] - p1["y"], p4["x"] - p3["x"], p4["y"] - p3["y"]
    den = d1x * d2y - d1y * d2x
    t = ((p3["x"] - p1["x"]) * d2y - (p3["y"] - p1["y"]) * d2x) / F.nullif(den, F.lit(0.0))
    return F.when(F.abs(den) >= EPS, F.struct((p1["x"] + t * d1x).alias("x"), (p1["y"] + t * d1y).alias("y")))


def point_in_polygon(p: Column, poly: Column) -> Column:
    """Even-odd rule."""
    hits = F.zip_with(poly, _next(poly), lambda a, b: F.when(((a["y"] > p["y"]) != (b["y"] > p["y"])) & (p["x"] < (b["x"] - a["x"]) * (p["y"] - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]), 1).otherwise(0))
    return F.aggregate(hits, F.lit(0), lambda s, v: s + v) % 2 == 1


def rotate_point_90(p: Column, width: Column, height: Column, turns: Column) -> Column:
    t = F.pmod(turns, F.lit(4))
    return F.when(t == 1, point(height - p["y"], p["x"])).when(t == 2, point(width - p["x"], height - p["y"])).when(t == 3, point(p["y"], width - p["x"])).otherwise(point(p["x"], p["y"]))


def quad_to_array(q: Column) -> Column:
    return F.flatten(F.transform(q, lambda p: F.array(p["x"], p["y"])))


def apply_homography(h: Column, p: Column) -> Column:
    w = h[6] * p["x"] + h[7] * p["y"] + h[8]
    return F.struct(((h[0] * p["x"] + h[1] * p["y"] + h[2]) / w).alias("x"), ((h[3] * p["x"] + h[4] * p["y"] + h[5]) / w).alias("y"))


def invert3(m: Column) -> Column:
    """Inverse of a 3x3 matrix (9 numbers, by rows); null where it has none."""
    minor = lambda a, b, c, d: m[a] * m[d] - m[b] * m[c]
    adj = [minor(4, 5, 7, 8), minor(2, 1, 8, 7), minor(1, 2, 4, 5), minor(5, 3, 8, 6), minor(0, 2, 6, 8), minor(2, 0, 5, 3), minor(3, 4, 6, 7), minor(1, 0, 7, 6), minor(0, 1, 3, 4)]
    det = m[0] * adj[0] + m[1] * adj[3] + m[2] * adj[6]
    return F.when(F.abs(det) >= 1e-15, F.array(*[a / det for a in adj]))


# Long side by short side of known formats, in the order of trial.
KNOWN_RATIOS = [("A4", 297 / 210), ("Letter", 11 / 8.5), ("Carte", 85.6 / 53.98)]


def estimate_output_size(q: Column, snap: bool = True, most: int = 4096) -> Column:
    """Struct of width and height: the longer of opposite edges, snapped to a known format within 6 %."""
    w, h = F.greatest(distance(q[0], q[1]), distance(q[3], q[2])), F.greatest(distance(q[0], q[3]), distance(q[1], q[2]))
    long, short = F.greatest(w, h), F.least(w, h)
    ratio = long / F.greatest(F.lit(1.0), short)
    if snap:
        fit = short
        for _, k in reversed(KNOWN_RATIOS):
            fit = F.when(F.abs(ratio - k) / k < 0.06, long / k).otherwise(fit)
        short = fit
    s = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(long, short))
    size = lambda v: F.greatest(F.lit(1), F.floor(v * s + 0.5)).cast("int")
    wide = w >= h
    return F.struct(size(F.when(wide, long).otherwise(short)).alias("width"), size(F.when(wide, short).otherwise(long)).alias("height"))


def fit_line(x: Column, y: Column) -> Column:
    """Aggregate: total least squares as struct of x, y (the mean) and dx, dy; null below two points."""
    sxy, sxx, syy = F.covar_pop(x, y), F.var_pop(x), F.var_pop(y)
    a = F.atan2(2 * sxy, sxx - syy) / 2
    return F.when(F.count("*") >= 2, F.struct(F.avg(x).alias("x"), F.avg(y).alias("y"), F.cos(a).alias("dx"), F.sin(a).alias("dy")))


# Page sizes in points; quality profiles as longest side and JPEG quality.
PAGE_SIZES = {"A4": (595.28, 841.89), "Letter": (612.0, 792.0)}
PROFILES = {"small": (1400, 0.55), "standard": (2200, 0.75), "high": (3508, 0.9)}


def layout_page(width: Column, height: Column, size: str = "A4", orientation: str = "auto", margin: float = 0.0) -> Column:
    """Struct of page width and height and the picture's x, y, w, h: contained in the page inside its margins, centred."""
    pw, ph = PAGE_SIZES.get(size, (0.0, 0.0))
    if size == "auto":
        scale = (PAGE_SIZES["A4"][1] - 2 * margin) / F.greatest(width, height)  # the picture's shape, as long as A4
        page_w, page_h = width * scale + 2 * margin, height * scale + 2 * margin
    else:
        landscape = F.lit(orientation == "landscape") if orientation != "auto" else width > height
        page_w, page_h = F.when(landscape, F.lit(ph)).otherwise(F.lit(pw)), F.when(landscape, F.lit(pw)).otherwise(F.lit(ph))
    inner = lambda v: F.greatest(F.lit(1.0), v - 2 * margin)
    s = F.least(inner(page_w) / width, inner(page_h) / height)
    w, h = width * s, height * s
    return F.struct(page_w.alias("page_w"), page_h.alias("page_h"), ((page_w - w) / 2).alias("x"), ((page_h - h) / 2).alias("y"), w.alias("w"), h.alias("h"))


def estimate_pdf_size(pages: Column, profile: str = "standard") -> Column:
    """Bytes of an export: pages (width, height, grayscale) reduced to the profile's longest side, at its bits for each pixel."""
    side, quality = PROFILES[profile]

    def page(p: Column) -> Column:
        s = F.least(F.lit(1.0), side / F.greatest(p["width"], p["height"]))
        return p["width"] * s * p["height"] * s * (0.25 + quality * quality * 1.9) * F.when(p["grayscale"], 0.6).otherwise(1.0) / 8 + 900

    return F.floor(F.aggregate(pages, F.lit(1200.0), lambda a, p: a + page(p)) + 0.5).cast("bigint")


# -- numpy: per object, not per column ----------------------------------------------------------------------------------
def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the hull, counter-clockwise in a system with y upwards; collinear points are left out."""
    p = np.unique(np.asarray(points, dtype=float), axis=0)
    if len(p) < 3:
        return p

    def chain(rows):
        out: list = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    rows = p.tolist()
    return np.array(chain(rows) + chain(rows[::-1]))


def ordered(quad: np.ndarray) -> np.ndarray:
    c = quad.mean(axis=0)
    q = quad[np.argsort(np.arctan2(quad[:, 1] - c[1], quad[:, 0] - c[0]), kind="stable")]
    start = min(range(4), key=lambda i: (round((q[i, 0] + q[i, 1]) / EPS), q[i, 1]))
    return np.roll(q, -start, axis=0)


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """The 3x3 map of four points onto four others, last element 1; None where the points are degenerate."""
    rows, right = [], []
    for (x, y), (u, v) in zip(src, dst):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    sol = solve_linear(np.array(rows, dtype=float), np.array(right, dtype=float))
    return None if sol is None else np.append(sol, 1.0).reshape(3, 3)


def solve_linear(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """None for a singular system."""
    if abs(np.linalg.det(a)) < 1e-12:
        return None
    return np.linalg.solve(a, b)


def line_through(points: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Mean and direction by total least squares."""
    if len(points) < 2:
        return None
    mean = points.mean(axis=0)
    d = points - mean
    a = 0.5 * math.atan2(2 * (d[:, 0] * d[:, 1]).sum(), (d[:, 0] ** 2).sum() - (d[:, 1] ** 2).sum())
    return mean, np.array([math.cos(a), math.sin(a)])
