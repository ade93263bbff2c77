"""Image kernels in numpy. Gray images are (h, w) and colour images (h, w, 3) arrays of uint8; results are rounded half to even and clamped."""

from __future__ import annotations

import math

import numpy as np


def clamp(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def to_gray(rgb: np.ndarray) -> np.ndarray:
    c = rgb.astype(np.int32)
    return ((77 * c[..., 0] + 150 * c[..., 1] + 29 * c[..., 2]) >> 8).astype(np.uint8)


def to_rgb(gray: np.ndarray) -> np.ndarray:
    return np.repeat(gray[..., None], 3, axis=2)


def _bounds(n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    step = n / parts
    a = np.floor(np.arange(parts) * step).astype(int)
    return a, np.minimum(n, np.maximum(a + 1, np.floor((np.arange(parts) + 1) * step).astype(int)))


def box_resize(img: np.ndarray, width: int, height: int) -> np.ndarray:
    """Each pixel is the mean of its box, by an integral image."""
    s = np.zeros((img.shape[0] + 1, img.shape[1] + 1, *img.shape[2:]))
    s[1:, 1:] = img.astype(float).cumsum(0).cumsum(1)
    y0, y1 = _bounds(img.shape[0], height)
    x0, x1 = _bounds(img.shape[1], width)
    total = s[y1][:, x1] - s[y0][:, x1] - s[y1][:, x0] + s[y0][:, x0]
    n = ((y1 - y0)[:, None] * (x1 - x0)[None, :]).astype(float)
    return clamp(total / (n[..., None] if img.ndim == 3 else n))


def sample(img: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear samples; outside the image all is white."""
    h, w = img.shape[:2]
    pad = np.pad(img.astype(float), ((1, 2), (1, 2)) + ((0, 0),) * (img.ndim - 2), constant_values=255.0)
    x, y = np.clip(x, -1.0, w) + 1, np.clip(y, -1.0, h) + 1
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    ax, ay = x - x0, y - y0
    if img.ndim == 3:
        ax, ay = ax[..., None], ay[..., None]
    return pad[y0, x0] * (1 - ax) * (1 - ay) + pad[y0, x0 + 1] * ax * (1 - ay) + pad[y0 + 1, x0] * (1 - ax) * ay + pad[y0 + 1, x0 + 1] * ax * ay


def resize(img: np.ndarray, width: int, height: int) -> np.ndarray:
    """Boxes for a reduction to less than half, else bilinear."""
    h, w = img.shape[:2]
    if width < w / 2 or height < h / 2:
        return box_resize(img, width, height)
    x = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    return clamp(sample(img, *np.meshgrid(x, y)))


def rotate90(img: np.ndarray, turns: int) -> np.ndarray:
    """Quarter turns clockwise."""
    return np.ascontiguousarray(np.rot90(img, -turns))


def warp(img: np.ndarray, quad: np.ndarray, width: int, height: int) -> np.ndarray:
    """The quad of the image as an upright rectangle, sampled at pixel centres."""
    from parchmint.functions.geometry import homography

    m = homography(np.array([[0, 0], [width, 0], [width, height], [0, height]], dtype=float), np.asarray(quad, dtype=float))
    if m is None:
        raise ValueError("degenerate quad")
    x, y = np.meshgrid(np.arange(width) + 0.5, np.arange(height) + 0.5)
    d = m[2, 0] * x + m[2, 1] * y + m[2, 2]
    return clamp(sample(img, (m[0, 0] * x + m[0, 1] * y + m[0, 2]) / d - 0.5, (m[1, 0] * x + m[1, 1] * y + m[1, 2]) / d - 0.5))


def gaussian_kernel(sigma: float) -> np.ndarray:
    r = max(1, math.ceil(sigma * 2.5))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    return k / k.sum()


def _convolve(a: np.ndarray, k: np.ndarray, axis: int) -> np.ndarray:
    r = len(k) // 2
    p = np.pad(a, [(r, r) if i == axis else (0, 0) for i in range(a.ndim)], mode="edge")
    n = a.shape[axis]
    return sum(v * np.take(p, np.arange(i, i + n), axis=axis) for i, v in enumerate(k))


def gaussian_blur(gray: np.ndarray, sigma: float) -> np.ndarray:
    k = gaussian_kernel(sigma)
    return clamp(_convolve(_convolve(gray.astype(float), k, 1), k, 0) + 0.5)


def sobel(gray: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(magnitude, direction): 0 and 2 for gradients along x and y, 1 and 3 for the diagonals; the border is 0."""
    s = gray.astype(float)
    mag, way = np.zeros(s.shape), np.zeros(s.shape, dtype=np.uint8)
    if min(s.shape) < 3:
        return mag, way
    smooth = lambda a, b, c: a + 2 * b + c
    gx = smooth(s[:-2, 2:], s[1:-1, 2:], s[2:, 2:]) - smooth(s[:-2, :-2], s[1:-1, :-2], s[2:, :-2])
    gy = smooth(s[2:, :-2], s[2:, 1:-1], s[2:, 2:]) - smooth(s[:-2, :-2], s[:-2, 1:-1], s[:-2, 2:])
    mag[1:-1, 1:-1] = np.hypot(gx, gy)
    t = 0.41421356
    ax, ay = np.abs(gx), np.abs(gy)
    way[1:-1, 1:-1] = np.where(ay <= ax * t, 0, np.where(ax <= ay * t, 2, np.where(gx * gy > 0, 1, 3)))
    return mag, way


def magnitude_quantile(mag: np.ndarray, q: float, bins: int = 1024, most: float = 1448.0) -> float:
    """Centre of the bin in which the share ``q`` of the values above 0 is reached; 0 without such values."""
    v = mag[mag > 0]
    if not len(v):
        return 0.0
    count = np.bincount(np.minimum(bins - 1, (v / most * bins).astype(int)), minlength=bins).cumsum()
    return (int(np.argmax(count >= len(v) * q)) + 0.5) / bins * most


_RING = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def label(mask: np.ndarray) -> np.ndarray:
    """Numbers from 1 for the 8-connected parts of a mask: runs of rows, united where they touch."""
    h, w = mask.shape
    out = np.zeros((h, w), dtype=np.int32)
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    ry, rx = np.nonzero(edge == 1)
    _, re = np.nonzero(edge == -1)
    parent = list(range(len(ry)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(ry, np.arange(h + 1))
    xs, es = rx.tolist(), re.tolist()
    for y in range(1, h):
        i, j = int(first[y - 1]), int(first[y])
        i_end, j_end = int(first[y]), int(first[y + 1])
        while i < i_end and j < j_end:
            if xs[i] <= es[j] and xs[j] <= es[i]:  # touching, corners included (ends are exclusive)
                a, b = root(i), root(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if es[i] < es[j]:
                i += 1
            else:
                j += 1
    number: dict[int, int] = {}
    for k in range(len(ry)):
        out[ry[k], xs[k] : es[k]] = number.setdefault(root(k), len(number) + 1)
    return out


def canny(gray: np.ndarray, quantile: float = 0.85, least: float = 40, most: float = 320, ratio: float = 0.4) -> tuple[np.ndarray, np.ndarray]:
    """(edges 0/255, gradient magnitude): thinned along the gradient, kept where connected to a strong edge."""
    m, way = sobel(gray)
    high = min(most, max(least, magnitude_quantile(m, quantile)))
    low = high * ratio
    p = np.pad(m, 1)
    shift = lambda dy, dx: p[1 + dy : 1 + dy + m.shape[0], 1 + dx : 1 + dx + m.shape[1]]
    before = np.choose(way, [shift(0, -1), shift(-1, -1), shift(-1, 0), shift(-1, 1)])
    after = np.choose(way, [shift(0, 1), shift(1, 1), shift(1, 0), shift(1, -1)])
    thin = (m >= low) & (m >= before) & (m > after)
    thin[[0, -1], :] = False
    thin[:, [0, -1]] = False
    parts = label(thin)
    strong = np.unique(parts[thin & (m >= high)])
    keep = np.zeros(parts.max() + 1, dtype=bool)
    keep[strong] = True
    keep[0] = False
    return np.where(keep[parts], 255, 0).astype(np.uint8), m


def _morph(img: np.ndarray, r: int, f, fill: int) -> np.ndarray:
    out = img
    for axis in (1, 0):
        p = np.pad(out, [(r, r) if i == axis else (0, 0) for i in range(2)], constant_values=fill)
        n = out.shape[axis]
        out = f.reduce([np.take(p, np.arange(i, i + n), axis=axis) for i in range(2 * r + 1)])
    return out


def dilate(img: np.ndarray, r: int = 1) -> np.ndarray:
    return _morph(img, r, np.maximum, 0)


def erode(img: np.ndarray, r: int = 1) -> np.ndarray:
    return _morph(img, r, np.minimum, 255)


def histogram(gray: np.ndarray) -> np.ndarray:
    return np.bincount(gray.ravel(), minlength=256)


def otsu_threshold(hist: np.ndarray) -> int:
    """The first level with the greatest variance between the classes below and above; 127 where there is none."""
    h = hist.astype(float)
    below, moment = h.cumsum(), (h * np.arange(256)).cumsum()
    above = below[-1] - below
    ok = (below > 0) & (above > 0)
    if not ok.any():
        return 127
    mean_b = moment / np.where(ok, below, 1)
    mean_a = (moment[-1] - moment) / np.where(ok, above, 1)
    between = np.where(ok, below * above * (mean_b - mean_a) ** 2, 0)
    return int(between.argmax()) if between.max() > 0 else 127


def threshold(gray: np.ndarray, t: int, invert: bool = False) -> np.ndarray:
    return np.where((gray > t) != invert, 255, 0).astype(np.uint8)


def laplacian_variance(gray: np.ndarray, mask: np.ndarray | None = None) -> float:
    if min(gray.shape) < 3:
        return 0.0
    s = gray.astype(float)
    v = 4 * s[1:-1, 1:-1] - s[1:-1, :-2] - s[1:-1, 2:] - s[:-2, 1:-1] - s[2:, 1:-1]
    if mask is not None:
        v = v[mask[1:-1, 1:-1]]
    return float(v.var()) if v.size else 0.0


def percentile(hist: np.ndarray, total: float, p: float) -> int:
    c = hist.cumsum() >= total * p
    return int(np.argmax(c)) if c.any() else 255


# -- documents: light, tone, noise --------------------------------------------------------------------------------------
def background(gray: np.ndarray) -> np.ndarray:
    """Light of the paper: cell means, the greatest of 5 x 5 (ink vanishes), smoothed and enlarged again; 24 at least."""
    h, w = gray.shape
    cell = max(4, math.floor(max(w, h) / 96 + 0.5))
    sw, sh = max(2, math.ceil(w / cell)), max(2, math.ceil(h / cell))
    small = gaussian_blur(_morph(np.pad(box_resize(gray, sw, sh), 2, mode="edge"), 2, np.maximum, 0)[2:-2, 2:-2], 1.5).astype(float)

    def axis(n: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        f = np.clip((np.arange(n) + 0.5) / cell - 0.5, 0, cells - 1)
        a = np.floor(f).astype(int)
        return a, np.minimum(cells - 1, a + 1), f - a

    y0, y1, ay = axis(h, sh)
    x0, x1, ax = axis(w, sw)
    rows = small[y0] * (1 - ay)[:, None] + small[y1] * ay[:, None]
    return np.maximum(24, rows[:, x0] * (1 - ax) + rows[:, x1] * ax)


def flatten_illumination(rgb: np.ndarray, strength: float = 1.0) -> np.ndarray:
    k = 1 + (255 / background(to_gray(rgb)) - 1) * strength
    return clamp(rgb * k[..., None])


def _tone(rgb: np.ndarray, lut: np.ndarray) -> np.ndarray:
    return clamp(lut)[rgb]


def auto_levels(rgb: np.ndarray, low: float = 0.01, high: float = 0.99) -> np.ndarray:
    hist, n = histogram(to_gray(rgb)), rgb.shape[0] * rgb.shape[1]
    lo = percentile(hist, n, low)
    hi = max(lo + 16, percentile(hist, n, high))
    return _tone(rgb, (np.arange(256) - lo) * 255 / (hi - lo))


def white_balance(rgb: np.ndarray) -> np.ndarray:
    """Gray paper: the means of light pixels are brought together, if there are a hundred of them."""
    light = rgb[to_gray(rgb) >= 120].astype(float)
    if len(light) < 100:
        return rgb.copy()
    mean = light.mean(axis=0)
    return clamp(rgb * (mean.mean() / np.maximum(1, mean)))


def document_curve(rgb: np.ndarray, white: float, black: float, gamma: float) -> np.ndarray:
    return _tone(rgb, np.clip((np.arange(256) - black) / (white - black), 0, 1) ** gamma * 255)


def unsharp_mask(rgb: np.ndarray, amount: float, sigma: float = 1.0) -> np.ndarray:
    if amount <= 0:
        return rgb.copy()
    soft = np.stack([gaussian_blur(rgb[..., c], sigma) for c in range(3)], axis=2).astype(float)
    return clamp(rgb + amount * (rgb - soft))


def _window(gray: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance in the window of radius r, cut at the border."""
    h, w = gray.shape
    v = gray.astype(float)
    y, x = np.arange(h), np.arange(w)
    y0, y1, x0, x1 = np.maximum(0, y - r), np.minimum(h, y + r + 1), np.maximum(0, x - r), np.minimum(w, x + r + 1)
    n = (y1 - y0)[:, None] * (x1 - x0)[None, :]

    def total(a: np.ndarray) -> np.ndarray:
        s = np.zeros((h + 1, w + 1))
        s[1:, 1:] = a.cumsum(0).cumsum(1)
        return s[y1][:, x1] - s[y0][:, x1] - s[y1][:, x0] + s[y0][:, x0]

    mean = total(v) / n
    return mean, np.maximum(0, total(v * v) / n - mean * mean)


def denoise(rgb: np.ndarray, strength: float) -> np.ndarray:
    if strength <= 0:
        return rgb.copy()
    out = np.empty(rgb.shape)
    for c in range(3):
        mean, var = _window(rgb[..., c], 2 if strength > 60 else 1)
        out[..., c] = mean + var / (var + 20 + strength * 6) * (rgb[..., c] - mean)
    return clamp(out)


def binarize(gray: np.ndarray, k: float = 0.18) -> np.ndarray:
    """Black and white by the local mean and deviation; very light pixels are paper, lone black ones are removed."""
    h, w = gray.shape
    mean, var = _window(gray, (max(15, math.floor(max(w, h) / 50 + 0.5)) | 1) >> 1)
    out = np.where((gray > mean * (1 + k * (np.sqrt(var) / 128 - 1))) | (gray > 225), 255, 0).astype(np.uint8)
    black = np.pad((out == 0).astype(int), 1)
    near = sum(black[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy, dx in _RING)
    lone = (out == 0) & (near == 0)
    lone[[0, -1], :] = False
    lone[:, [0, -1]] = False
    out[lone] = 255
    return out


def _luma(rgb: np.ndarray) -> np.ndarray:
    return (rgb.astype(float) @ np.array([0.299, 0.587, 0.114]))[..., None]


def saturation(rgb: np.ndarray, amount: float) -> np.ndarray:
    lum = _luma(rgb)
    return clamp(lum + (rgb - lum) * (1 + amount / 100))


FILTERS = ["original", "auto", "document", "enhanced", "grayscale", "bw"]
NEUTRAL = {"brightness": 0, "contrast": 0, "exposure": 0, "saturation": 0, "sharpness": 0, "denoise": 0}


def apply_preset(rgb: np.ndarray, name: str) -> np.ndarray:
    if name == "auto":
        return unsharp_mask(auto_levels(flatten_illumination(rgb, 0.92), 0.005, 0.99), 0.35)
    if name == "document":
        return unsharp_mask(document_curve(flatten_illumination(rgb), 228, 60, 1.35), 0.5)
    if name == "enhanced":
        return unsharp_mask(saturation(auto_levels(white_balance(flatten_illumination(rgb, 0.85))), 30), 0.4)
    if name == "grayscale":
        return to_rgb(to_gray(document_curve(flatten_illumination(rgb), 236, 40, 1.2)))
    if name == "bw":
        return to_rgb(binarize(to_gray(flatten_illumination(rgb))))
    return rgb.copy()


def apply_adjustments(rgb: np.ndarray, a: dict) -> np.ndarray:
    a = NEUTRAL | a
    if not any(a.values()):
        return rgb
    img = denoise(rgb, a["denoise"])
    c = a["contrast"] / 100 * 200
    lut = (np.arange(256) * 2 ** (a["exposure"] / 50) - 128) * (259 * (c + 255) / (255 * (259 - c))) + 128 + a["brightness"] * 1.28
    v = lut[img]
    if a["saturation"]:
        lum = _luma(img)
        lum = (v @ np.array([0.299, 0.587, 0.114]))[..., None]
        v = lum + (v - lum) * (1 + a["saturation"] / 100)
    return unsharp_mask(clamp(v), a["sharpness"] / 100 * 1.5) if a["sharpness"] > 0 else clamp(v)


def process_image(rgb: np.ndarray, name: str, adjustments: dict | None = None) -> np.ndarray:
    return apply_adjustments(apply_preset(rgb, name), adjustments or {})


# -- analysis -----------------------------------------------------------------------------------------------------------
def downscale(rgb: np.ndarray, most: int) -> np.ndarray:
    h, w = rgb.shape[:2]
    s = min(1.0, most / max(w, h))
    return rgb if s >= 1 else to_rgb(box_resize(to_gray(rgb), max(1, math.floor(w * s + 0.5)), max(1, math.floor(h * s + 0.5))))


def blank_page_score(rgb: np.ndarray) -> tuple[float, bool]:
    """(share of ink, blank): the page's light made even, a margin of 4 % ignored."""
    g = to_gray(flatten_illumination(downscale(rgb, 600)))
    my, mx = math.floor(g.shape[0] * 0.04 + 0.5), math.floor(g.shape[1] * 0.04 + 0.5)
    inner = g[my : g.shape[0] - my, mx : g.shape[1] - mx]
    ink = float((inner < 160).mean()) if inner.size else 0.0
    return ink, ink < 0.0025


def d_hash(img: np.ndarray) -> str:
    """64 bits as hexadecimal text: is a cell of the 9 x 8 reduction lighter than its right neighbour?"""
    s = box_resize(to_gray(img) if img.ndim == 3 else img, 9, 8).astype(int)
    bits = (s[:, :-1] > s[:, 1:]).ravel()
    return np.packbits(bits).tobytes().hex()


def text_direction(rgb: np.ndarray) -> tuple[int, float]:
    """(quarter turns, confidence): lines of text make the ink alternate across their direction."""
    g = to_gray(flatten_illumination(downscale(rgb, 500)))
    dark = g < 150
    if dark.sum() < dark.size * 0.003:
        return 0, 0.0
    strength = lambda p: np.abs(np.diff(p)).sum() / p.sum() if p.sum() else 0.0
    rows, cols = strength(dark.sum(axis=1).astype(float)), strength(dark.sum(axis=0).astype(float))
    return int(cols > rows * 1.35), min(1.0, abs(math.log((rows + 1e-9) / (cols + 1e-9))))
