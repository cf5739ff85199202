"""Further operations on histograms: labelled axes, polygons, sampling, merging of named results, spectra."""

from __future__ import annotations

import fnmatch
import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventframe.hist.compare import Graph
from eventframe.hist.histogram import Histogram
from eventframe.hist.profile import Efficiency, Profile


def labelled_counts(df: DataFrame, category: str, weight: str | None = None, categories: Sequence[str] | None = None) -> DataFrame:
    """Content of a categorical axis; states outside of ``categories`` overflow (null)."""
    state = F.col(category)
    if categories is not None:
        state = F.when(state.isin(list(categories)), state)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return df.groupBy(state.alias(category)).agg(F.sum(w).alias("content"), F.sum(w * w).alias("sumw2"))


def in_polygon(x: Column, y: Column, points: Sequence[tuple[float, float]]) -> Column:
    """Whether a point lies inside: crossings of a ray to the right are odd."""
    odd = F.lit(False)
    for (x1, y1), (x2, y2) in zip(points, [*points[1:], points[0]]):
        if y1 == y2:
            continue
        spans = (F.lit(y1) > y) != (F.lit(y2) > y)
        odd = odd != (spans & (x < (y - y1) * ((x2 - x1) / (y2 - y1)) + x1))
    return odd


def polygon_counts(df: DataFrame, x: str, y: str, polygons: Mapping[str, Sequence[tuple[float, float]]]) -> DataFrame:
    """Entries in each polygonal bin, the first that holds a point; null for none."""
    name = F.lit(None).cast("string")
    for label, points in reversed(list(polygons.items())):
        name = F.when(in_polygon(F.col(x).cast("double"), F.col(y).cast("double"), points), F.lit(label)).otherwise(name)
    return df.groupBy(name.alias("bin")).agg(F.count("*").alias("content"))


def profile_of(h: Histogram, along: int = 0) -> Profile:
    """Profile of a 2-D histogram: the mean of the other axis per bin, from bin centres."""
    other = 1 - along
    centers = h.axes[other].centers()
    content, squares = (np.moveaxis(a, along, 0)[:, 1:-1] for a in (h.content, h.variances(True)))
    p = Profile([h.axes[along]])
    p.w, p.wy, p.wyy, p.w2 = content.sum(1), content @ centers, content @ centers**2, squares.sum(1)
    p.entries = h.entries
    return p


def random_values(h: Histogram, n: int, seed: int = 0) -> np.ndarray:
    """Drawn from a 1-D histogram: a bin by its content, uniform inside."""
    rng = np.random.default_rng(seed)
    run = np.concatenate([[0.0], np.cumsum(np.maximum(h.counts(), 0))])
    return np.interp(rng.random(n) * run[-1], run, h.axes[0].all_edges())


def random_column(h: Histogram, uniform: Column) -> Column:
    """The same as a column of a uniform one."""
    run = np.concatenate([[0.0], np.cumsum(np.maximum(h.counts(), 0))])
    edges, out = h.axes[0].all_edges(), F.lit(float(h.axes[0].high))
    u = uniform * float(run[-1])
    for k in reversed(range(h.axes[0].n)):
        step = run[k + 1] - run[k]
        if step > 0:
            out = F.when(u < float(run[k + 1]), F.lit(float(edges[k])) + (u - float(run[k])) / float(step) * float(edges[k + 1] - edges[k])).otherwise(out)
    return out


def evaluated(h: Histogram, f: Callable[..., float]) -> Histogram:
    """Contents set to a function at the bin centres."""
    out = h.copy()
    grids = np.meshgrid(*[a.centers() for a in h.axes], indexing="ij")
    out.content[tuple(slice(1, -1) for _ in h.axes)] = np.vectorize(f)(*grids)
    return out


def fit_gaussian(h: Histogram, steps: int = 50) -> tuple[float, float, float]:
    """Height, mean and width by least squares with errors as weights (Gauss-Newton)."""
    x, y, e = h.axes[0].centers(), h.counts(), h.errors()
    use = e > 0
    x, y, w = x[use], y[use], 1 / e[use] ** 2
    if len(x) < 3:
        return 0.0, h.mean(), h.std()
    p = np.array([y.max(), h.mean(), h.std() or 1.0])
    cost = lambda q: float((w * (y - q[0] * np.exp(-0.5 * ((x - q[1]) / q[2]) ** 2)) ** 2).sum())
    for _ in range(steps):
        g = np.exp(-0.5 * ((x - p[1]) / p[2]) ** 2)
        j = np.stack([g, p[0] * g * (x - p[1]) / p[2] ** 2, p[0] * g * (x - p[1]) ** 2 / p[2] ** 3], 1)
        move = np.linalg.lstsq(j * np.sqrt(w)[:, None], (y - p[0] * g) * np.sqrt(w), rcond=None)[0]
        scale = 1.0
        while scale > 1e-6 and not cost(p + scale * move) <= cost(p):
            scale /= 2
        p = p + scale * move
        if np.abs(scale * move).max() < 1e-12 * max(1.0, np.abs(p).max()):
            break
    return float(p[0]), float(p[1]), abs(float(p[2]))


def fit_slices(h: Histogram, along: int = 0) -> list[tuple[int, float, float, float]]:
    """A Gaussian fitted to each slice of a 2-D histogram that has entries: bin, height, mean, width."""
    out = []
    for k in range(1, h.axes[along].n + 1):
        s = h.project(1 - along, ranges={along: (k, k)})
        if s.counts().sum() > 0:
            out.append((k, *fit_gaussian(s)))
    return out


def merged(results: Sequence[Mapping[str, object]], only: Sequence[str] = (), skip: Sequence[str] = ()) -> dict[str, object]:
    """Results of one name merged: histograms and profiles add, efficiencies count on, graphs and tables go end to end; others stay as first met."""
    out: dict[str, object] = {}
    for named in results:
        for name, thing in named.items():
            if only and not any(fnmatch.fnmatch(name, p) for p in only) or any(fnmatch.fnmatch(name, p) for p in skip):
                continue
            if name not in out:
                out[name] = thing.copy() if isinstance(thing, Histogram) else thing
            elif isinstance(thing, (Histogram, Profile)):
                out[name].add(thing)
            elif isinstance(thing, Efficiency):
                out[name].merge(thing)
            elif isinstance(thing, Graph):
                out[name].merge([thing])
            elif isinstance(thing, DataFrame):
                out[name] = out[name].unionByName(thing, allowMissingColumns=True)
    return out


def search_peaks(values, sigma: float = 2.0, threshold: float = 0.05) -> list[int]:
    """Bins of peaks: maxima of the second difference smoothed by a Gaussian, above a share of the largest."""
    v = np.asarray(values, float)
    half = max(1, math.ceil(4 * sigma))
    t = np.arange(-half, half + 1)
    kernel = (1 - (t / sigma) ** 2) * np.exp(-0.5 * (t / sigma) ** 2)
    kernel -= kernel.mean()
    r = np.convolve(np.pad(v, half, mode="edge"), kernel, "valid")
    top = r.max()
    return [i for i in range(1, len(r) - 1) if r[i] > threshold * top and r[i] >= r[i - 1] and r[i] > r[i + 1]]


def markov_smooth(values, window: int = 3) -> np.ndarray:
    """Smoothing by the stationary distribution of a random walk that prefers higher neighbours."""
    v = np.asarray(values, float)
    total, n = v.sum(), len(v)
    if total <= 0 or n < 2:
        return v.copy()
    top = v.max()
    out = np.ones(n)
    for i in range(n - 1):
        up = down = 0.0
        for k in range(1, window + 1):
            for there, here, sign in ((min(n - 1, i + k), i, 1), (max(0, i - k + 1), i + 1, -1)):
                a, b = v[there] / top, v[here] / top
                step = math.exp((a - b) / math.sqrt(a + b)) if a + b > 0 else 1.0
                up, down = (up + step, down) if sign > 0 else (up, down + step)
        out[i + 1] = out[i] * up / down
    return out / out.sum() * total


def deconvolved(values, response, iterations: int = 100) -> np.ndarray:
    """Richardson-Lucy: the spectrum that a response function spread."""
    v, r = np.asarray(values, float), np.asarray(response, float)
    r = r / r.sum()
    x, back = np.full(len(v), v.mean()), r[::-1]
    for _ in range(iterations):
        blurred = np.convolve(x, r, "full")[: len(v)]
        ratio = np.where(blurred > 0, v / np.where(blurred > 0, blurred, 1), 0)
        x = x * np.convolve(ratio, back, "full")[len(r) - 1 : len(r) - 1 + len(v)]
    return x


def walsh(values) -> np.ndarray:
    """Walsh-Hadamard transform in natural order, scaled to keep lengths."""
    v = np.asarray(values, float).copy()
    h, n = 1, len(v)
    if n & (n - 1):
        raise ValueError("the length must be a power of two")
    while h < n:
        v = v.reshape(-1, 2, h)
        v = np.stack([v[:, 0] + v[:, 1], v[:, 0] - v[:, 1]], 1).reshape(-1)
        h *= 2
    return v / math.sqrt(n)


def lowess(x, y, span: float = 0.67, iterations: int = 3) -> np.ndarray:
    """Locally weighted straight lines, made robust by weights of residuals."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    n = len(x)
    k = max(2, min(n, int(span * n + 1e-7)))
    weight, out = np.ones(n), np.zeros(n)
    for _ in range(iterations + 1):
        for i in range(n):
            d = np.abs(x - x[i])
            reach = np.partition(d, k - 1)[k - 1] or 1.0
            w = np.where(d < reach, (1 - np.minimum(d / reach, 1) ** 3) ** 3, 0) * weight
            s = w.sum() or 1.0
            mx, my = (w * x).sum() / s, (w * y).sum() / s
            var = (w * (x - mx) ** 2).sum()
            out[i] = my + ((w * (x - mx) * (y - my)).sum() / var * (x[i] - mx) if var > 0 else 0.0)
        rest = np.abs(y - out)
        scale = 6 * np.median(rest)
        if scale <= 0:
            break
        weight = np.where(rest < scale, (1 - np.minimum(rest / scale, 1) ** 2) ** 2, 0)
    return out


def kernel_smooth(x, y, width: float, at=None) -> np.ndarray:
    """Means with normal weights whose quartiles are a quarter of the width away."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    at = x if at is None else np.asarray(at, float)
    w = np.exp(-0.5 * ((at[:, None] - x) / (0.3706506 * width)) ** 2)
    return (w @ y) / w.sum(1)


#: Largest contents of whole-number storage, by its letter (fixed values).
STORAGE = {"C": 127, "S": 32767, "I": 2147483647, "L": 9223372036854775807}


def saturated(h: Histogram, storage: str) -> Histogram:
    """Contents held to what a storage type can hold; real storage holds all."""
    out = h.copy()
    if storage in STORAGE:
        top = STORAGE[storage]
        out.content = np.clip(np.trunc(out.content), -top, top)
    return out


class loc:  # noqa: N801
    """A bin by the value that lies in it, for indexing."""

    def __init__(self, value: float, offset: int = 0):
        self.value, self.offset = value, offset

    def bin(self, axis) -> int:
        return axis.find(self.value) - 1 + self.offset

    def __add__(self, n: int) -> loc:
        return loc(self.value, self.offset + n)


class rebin:  # noqa: N801
    """A slice's step: bins in groups."""

    def __init__(self, factor: int):
        self.factor = factor


def at(h: Histogram, *keys):
    """Indexing with ``loc`` and ``rebin``: numbers give contents, slices histograms."""
    plain, groups = [], []
    for k, a in zip(keys, h.axes):
        if isinstance(k, loc):
            plain.append(k.bin(a))
        elif isinstance(k, slice):
            ends = [e.bin(a) if isinstance(e, loc) else e for e in (k.start, k.stop)]
            groups.append(k.step.factor if isinstance(k.step, rebin) else 1)
            plain.append(slice(*ends, sum if k.step is sum else None))
        else:
            plain.append(k)
    out = h[tuple(plain)]
    if isinstance(out, Histogram):
        for axis, g in enumerate(groups[: out.dim]):
            if g > 1:
                out = out.rebin(g, axis)
    return out


class Stack:
    """Histograms one upon the other."""

    def __init__(self, histograms: Sequence[Histogram] = ()):
        self.histograms = list(histograms)

    def add(self, h: Histogram) -> Stack:
        self.histograms.append(h)
        return self

    def sums(self) -> list[Histogram]:
        """Running totals from the lowest up."""
        out: list[Histogram] = []
        for h in self.histograms:
            out.append(h.copy() if not out else out[-1].copy().add(h))
        return out

    def maximum(self) -> float:
        return max((s.maximum() for s in self.sums()), default=0.0)


def filled_at_random(h: Histogram, f: Callable[[float], float] | Histogram, n: int, seed: int = 0) -> Histogram:
    """``n`` fills distributed like a function over the axis, or like another histogram."""
    source = f if isinstance(f, Histogram) else evaluated(h, f)
    return h.copy().fill_n(random_values(source, n, seed))


def interpolated(h: Histogram, x: float, y: float) -> float:
    """Bilinear between the bin centres of a 2-D histogram; flat beyond the outer ones."""
    out, spots = 0.0, []
    for a, v in zip(h.axes, (x, y)):
        c = a.centers()
        k = int(np.clip(np.searchsorted(c, v) - 1, 0, len(c) - 2)) if len(c) > 1 else 0
        t = float(np.clip((v - c[k]) / (c[k + 1] - c[k]), 0, 1)) if len(c) > 1 else 0.0
        spots.append(((k, 1 - t), (min(k + 1, len(c) - 1), t)))
    for i, u in spots[0]:
        for j, w in spots[1]:
            out += u * w * h.counts()[i, j]
    return float(out)


def delaunay(points: Sequence[tuple[float, float]]) -> list[tuple[int, int, int]]:
    """Triangles whose circles hold no other point, by adding one point after the other."""
    p = np.asarray(points, float)
    center, span = p.mean(0), 1e3 * (np.ptp(p, axis=0).max() or 1.0)
    n = len(p)
    q = np.vstack([p, center + [[-span, -span], [span, -span], [0, span]]])

    def circle(t: tuple[int, int, int]) -> tuple[np.ndarray, float]:
        a, b, c = q[list(t)]
        m = 2 * np.array([b - a, c - a])
        o = np.linalg.solve(m, [b @ b - a @ a, c @ c - a @ a])
        return o, float(((o - a) ** 2).sum())

    triangles = {(n, n + 1, n + 2): circle((n, n + 1, n + 2))}
    for i in range(n):
        bad = [t for t, (o, r) in triangles.items() if ((o - q[i]) ** 2).sum() < r * (1 + 1e-12)]
        edges = [tuple(sorted(e)) for t in bad for e in ((t[0], t[1]), (t[1], t[2]), (t[0], t[2]))]
        for t in bad:
            del triangles[t]
        for e in set(edges):
            if edges.count(e) == 1:
                (x1, y1), (x2, y2) = q[e[0]] - q[i], q[e[1]] - q[i]
                if abs(x1 * y2 - x2 * y1) > 1e-12 * span:
                    triangles[(*e, i)] = circle((*e, i))
    return [t for t in triangles if max(t) < n]


def interpolated_plane(points: Sequence[tuple[float, float]], z: Sequence[float], x: float, y: float, outside: float = 0.0) -> float:
    """A value between scattered points: linear inside the triangle that holds it."""
    p = np.asarray(points, float)
    for t in delaunay(points):
        a, b, c = p[list(t)]
        m = np.array([b - a, c - a]).T
        if abs(np.linalg.det(m)) < 1e-15:
            continue
        u, v = np.linalg.solve(m, np.array([x, y]) - a)
        if u >= -1e-12 and v >= -1e-12 and u + v <= 1 + 1e-12:
            return float(z[t[0]] * (1 - u - v) + z[t[1]] * u + z[t[2]] * v)
    return outside
