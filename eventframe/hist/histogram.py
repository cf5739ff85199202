"""Histograms: contents, squared weights and moments, filled by one grouped aggregate."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventframe.functions import special
from eventframe.hist.axis import Axis

_XYZ = "xyz"


def moment_names(dim: int) -> list[str]:
    """Sums kept besides w and w2: first, then second and mixed moments of each axis."""
    names = [f"w{c}" for c in _XYZ[:dim]]
    return names + [f"w{a}{b}" for i, a in enumerate(_XYZ[:dim]) for b in _XYZ[i:dim]]


def bin_aggregates(xs: list[Column], w: Column) -> list[Column]:
    """Aggregates of each bin: entries, sums of weights and moments."""
    d = [x.cast("double") for x in xs]
    out = [F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"), F.sum(w * w).alias("w2"), F.max(w != 1.0).alias("weighted")]
    sums = [w * x for x in d] + [w * a * b for i, a in enumerate(d) for b in d[i:]]
    return out + [F.sum(s).alias(f"m_{n}") for n, s in zip(moment_names(len(xs)), sums)]


class Histogram:
    """A 1- to 3-dimensional histogram. Arrays count flow bins and have an axis per dimension."""

    def __init__(self, axes: Iterable, name: str = "", title: str = ""):
        self.axes = [Axis.of(a) for a in axes]
        self.name, self.title = name, title
        shape = tuple(a.n + 2 for a in self.axes)
        self.content, self.sumw2 = np.zeros(shape), np.zeros(shape)
        self.entries, self.weighted = 0.0, False
        self.moments = dict.fromkeys(["w", "w2", *moment_names(self.dim)], 0.0)

    @property
    def dim(self) -> int:
        return len(self.axes)

    # filling ------------------------------------------------------------------------------------------

    def fill(self, *values, weight: float = 1.0) -> Histogram:
        at = tuple(a.find(v) for a, v in zip(self.axes, values))
        self.content[at] += weight
        self.sumw2[at] += weight * weight
        self.entries += 1
        self.weighted |= weight != 1.0
        if all(1 <= i <= a.n for i, a in zip(at, self.axes)):
            self._add_moments([weight, weight * weight, *[weight * v for v in values], *[weight * u * v for i, u in enumerate(values) for v in values[i:]]])
        return self

    def fill_n(self, *columns, weights=None, stride: int = 1) -> Histogram:
        columns = [np.asarray(c)[::stride] for c in columns]
        weights = np.ones(len(columns[0])) if weights is None else np.asarray(weights)[::stride]
        for *v, w in zip(*columns, weights):
            self.fill(*v, weight=w)
        return self

    def _add_moments(self, sums) -> None:
        for name, s in zip(self.moments, sums):
            self.moments[name] += s

    def add_bins(self, rows: Iterable) -> Histogram:
        """Rows of ``fill_frame``: one for each bin that was filled."""
        names = moment_names(self.dim)
        for r in rows:
            at = tuple(r[f"b{_XYZ[k]}"] for k in range(self.dim))
            self.content[at] += r["w"]
            self.sumw2[at] += r["w2"]
            self.entries += r["n"]
            self.weighted |= bool(r["weighted"])
            if all(1 <= i <= a.n for i, a in zip(at, self.axes)):
                self._add_moments([r["w"], r["w2"], *[r[f"m_{n}"] for n in names]])
        return self

    def fill_frame(self, df: DataFrame, *columns: Column | str, weight: Column | str | None = None) -> DataFrame:
        """One row per filled bin of ``df``: bx (by, bz), n, w, w2, weighted and moments."""
        cols = [F.col(c) if isinstance(c, str) else c for c in columns]
        w = F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight).cast("double")
        named = df.select(*[c.cast("double").alias(f"v{k}") for k, c in enumerate(cols)], w.alias("wt"))
        binned = named.select("*", *[a.bin(F.col(f"v{k}")).alias(f"b{_XYZ[k]}") for k, a in enumerate(self.axes)])
        return binned.groupBy(*[f"b{_XYZ[k]}" for k in range(self.dim)]).agg(*bin_aggregates([F.col(f"v{k}") for k in range(self.dim)], F.col("wt")))

    # reading ---------------------------------------------------------------------------------------------

    def _inner(self, a: np.ndarray) -> np.ndarray:
        return a[tuple(slice(1, -1) for _ in self.axes)]

    def counts(self, flow: bool = False) -> np.ndarray:
        return self.content if flow else self._inner(self.content)

    values = counts

    def variances(self, flow: bool = False) -> np.ndarray:
        v = self.sumw2 if self.weighted else np.abs(self.content)
        return v if flow else self._inner(v)

    def errors(self, flow: bool = False) -> np.ndarray:
        return np.sqrt(self.variances(flow))

    def to_numpy(self, flow: bool = False) -> tuple:
        return (self.counts(flow), *[a.all_edges() for a in self.axes])

    def density(self) -> np.ndarray:
        volume = self.axes[0].widths()
        for a in self.axes[1:]:
            volume = np.multiply.outer(volume, a.widths())
        return self.counts() / (self.counts().sum() * volume)

    def to_df(self, spark: SparkSession) -> DataFrame:
        """One row per bin, flow included: bin numbers, content, sumw2."""
        rows = [(*map(int, at), float(self.content[at]), float(self.sumw2[at])) for at in np.ndindex(self.content.shape)]
        return spark.createDataFrame(rows, ", ".join([f"b{c} int" for c in _XYZ[: self.dim]] + ["content double", "sumw2 double"]))

    # statistics ------------------------------------------------------------------------------------------

    def sums(self) -> dict[str, float]:
        """Running sums, or sums over bins where there are none."""
        if self.moments["w"]:
            return self.moments
        out = dict.fromkeys(self.moments, 0.0)
        inner, squares = self.counts(), self.variances()
        grids = np.meshgrid(*[a.centers() for a in self.axes], indexing="ij")
        out["w"], out["w2"] = inner.sum(), squares.sum()
        for i, a in enumerate(_XYZ[: self.dim]):
            out[f"w{a}"] = (inner * grids[i]).sum()
            for j in range(i, self.dim):
                out[f"w{a}{_XYZ[j]}"] = (inner * grids[i] * grids[j]).sum()
        return out

    def mean(self, axis: int = 0) -> float:
        s = self.sums()
        return s[f"w{_XYZ[axis]}"] / s["w"] if s["w"] else 0.0

    def std(self, axis: int = 0) -> float:
        s, c = self.sums(), _XYZ[axis]
        return math.sqrt(abs(s[f"w{c}{c}"] / s["w"] - self.mean(axis) ** 2)) if s["w"] else 0.0

    def effective_entries(self) -> float:
        s = self.sums()
        return s["w"] ** 2 / s["w2"] if s["w2"] else abs(s["w"])

    def mean_error(self, axis: int = 0) -> float:
        n = self.effective_entries()
        return self.std(axis) / math.sqrt(n) if n else 0.0

    def std_error(self, axis: int = 0) -> float:
        n = self.effective_entries()
        return math.sqrt(self.std(axis) ** 2 / (2 * n)) if n else 0.0

    def covariance(self, a: int = 0, b: int = 1) -> float:
        s = self.sums()
        i, j = sorted((a, b))
        return s[f"w{_XYZ[i]}{_XYZ[j]}"] / s["w"] - self.mean(a) * self.mean(b) if s["w"] else 0.0

    def correlation(self, a: int = 0, b: int = 1) -> float:
        s = self.std(a) * self.std(b)
        return self.covariance(a, b) / s if s else 0.0

    def _central(self, axis: int, order: int) -> float:
        others = tuple(k for k in range(self.dim) if k != axis)
        w = self.counts().sum(axis=others) if others else self.counts()
        return float((w * (self.axes[axis].centers() - self.mean(axis)) ** order).sum() / w.sum()) if w.sum() else 0.0

    def skewness(self, axis: int = 0) -> float:
        s = self.std(axis)
        return self._central(axis, 3) / s**3 if s else 0.0

    def kurtosis(self, axis: int = 0) -> float:
        s = self.std(axis)
        return self._central(axis, 4) / s**4 - 3 if s else 0.0

    def integral(self, *ranges: tuple[int, int], width: bool = False, error: bool = False):
        """Sum over bin numbers (first, last) of each axis; all inner bins by default."""
        cut = tuple(slice(r[0], r[1] + 1) for r in (ranges or [(1, a.n) for a in self.axes]))
        scale = 1.0
        if width:
            for k, a in enumerate(self.axes):
                w = np.concatenate([[0.0], a.widths(), [0.0]])[cut[k]]
                scale = np.multiply.outer(scale, w)
        total = float((self.content[cut] * scale).sum())
        return (total, math.sqrt(float((self.variances(True)[cut] * scale**2).sum()))) if error else total

    def maximum(self) -> float:
        return float(self.counts().max())

    def minimum(self) -> float:
        return float(self.counts().min())

    def argmax(self) -> int:
        return int(np.argmax(self.counts())) + 1 if self.dim == 1 else int(self.global_bin(*(i + 1 for i in np.unravel_index(np.argmax(self.counts().T), self.counts().T.shape)[::-1])))

    def global_bin(self, *bins: int) -> int:
        """Bins in one number, x fastest, flow counted."""
        out, step = 0, 1
        for b, a in zip(bins, self.axes):
            out += b * step
            step *= a.n + 2
        return out

    def interpolate(self, x: float) -> float:
        """Linear between the bin centres of a 1-D histogram; flat beyond the outer ones."""
        return float(np.interp(x, self.axes[0].centers(), self.counts()))

    # algebra -----------------------------------------------------------------------------------------------

    def _check(self, other: Histogram) -> None:
        if self.dim != other.dim or not all(a.same(b) for a, b in zip(self.axes, other.axes)):
            raise ValueError("histograms with different axes")

    def copy(self) -> Histogram:
        out = type(self).__new__(type(self))
        out.__dict__.update({k: v.copy() if isinstance(v, (np.ndarray, dict, list)) else v for k, v in self.__dict__.items()})
        return out

    def _from_bins(self) -> Histogram:
        """Moments anew from bins."""
        self.moments = dict.fromkeys(self.moments, 0.0)
        self.moments = dict(self.sums())
        return self

    def add(self, other: Histogram, factor: float = 1.0) -> Histogram:
        self._check(other)
        mine, theirs = self.variances(True), other.variances(True)
        self.sumw2 = mine + factor * factor * theirs
        self.weighted |= other.weighted or factor != 1.0
        self.content = self.content + factor * other.content
        self.entries = abs(self.entries + factor * other.entries)
        if factor < 0:
            return self._from_bins()
        for k, v in other.moments.items():
            self.moments[k] += v * (factor * factor if k == "w2" else factor)
        return self

    def scale(self, factor: float, width: bool = False) -> Histogram:
        self.sumw2 = self.variances(True) * factor * factor
        self.content = self.content * factor
        self.weighted = True
        if width:
            for k, a in enumerate(self.axes):
                w = np.concatenate([[1.0], a.widths(), [1.0]]).reshape([-1 if i == k else 1 for i in range(self.dim)])
                self.content, self.sumw2 = self.content / w, self.sumw2 / w**2
        for k in self.moments:
            self.moments[k] *= factor * factor if k == "w2" else factor
        return self

    def multiply(self, other: Histogram) -> Histogram:
        self._check(other)
        a, b, ea, eb = self.content, other.content, self.variances(True), other.variances(True)
        self.content, self.sumw2, self.weighted = a * b, ea * b * b + eb * a * a, True
        return self._from_bins()

    def divide(self, other: Histogram, binomial: bool = False) -> Histogram:
        self._check(other)
        a, b, ea, eb = self.content, other.content, self.variances(True), other.variances(True)
        safe = np.where(b == 0, 1.0, b)
        ratio = np.where(b == 0, 0.0, a / safe)
        if binomial:
            e2 = np.where(a == b, 0.0, np.abs(((1 - 2 * ratio) * ea + ratio**2 * eb) / safe**2))
            self.entries = other.entries
        else:
            e2 = (ea * b * b + eb * a * a) / safe**4
        self.content, self.sumw2, self.weighted = ratio, np.where(b == 0, 0.0, e2), True
        return self._from_bins()

    def merge(self, others: Iterable[Histogram]) -> Histogram:
        for o in others:
            self.add(o)
        return self

    def reset(self) -> Histogram:
        self.__init__(self.axes, self.name, self.title)
        return self

    def normalized(self, to: float = 1.0) -> Histogram:
        total = self.integral()
        return self.copy().scale(to / total) if total else self.copy()

    # reshaping ---------------------------------------------------------------------------------------------

    def _regrouped(self, axis: int, edges: np.ndarray, to: np.ndarray) -> Histogram:
        axes = list(self.axes)
        old = axes[axis]
        even = old.edges is None and np.allclose(np.diff(edges), edges[1] - edges[0], rtol=1e-9)
        axes[axis] = Axis(len(edges) - 1, float(edges[0]), float(edges[-1])) if even else Axis.of(list(edges))
        out = type(self)(axes, self.name, self.title)
        index = [slice(None)] * self.dim
        for k, t in enumerate(to):
            source, target = list(index), list(index)
            source[axis], target[axis] = k, t
            out.content[tuple(target)] += self.content[tuple(source)]
            out.sumw2[tuple(target)] += self.sumw2[tuple(source)]
        out.entries, out.weighted, out.moments = self.entries, self.weighted, dict(self.moments)
        return out

    def rebin(self, groups, axis: int = 0) -> Histogram:
        """Bins in groups of so many (what is left over is overflow), or between given edges that exist."""
        old = self.axes[axis]
        edges = old.all_edges()
        if isinstance(groups, int):
            count = old.n // groups
            to = [0, *[1 + min(k // groups, count) for k in range(old.n)], count + 1]
            return self._regrouped(axis, edges[: count * groups + 1 : groups], np.array(to))
        wanted = np.asarray(groups, float)
        at = [int(np.argmin(np.abs(edges - e))) for e in wanted]
        if any(abs(edges[i] - e) > 1e-10 * (old.high - old.low) for i, e in zip(at, wanted)):
            raise ValueError("new edges must be among the old ones")
        to = np.searchsorted(np.array(at), np.arange(-1, old.n + 1), "right")
        to[0], to[-1] = 0, len(wanted)
        return self._regrouped(axis, wanted, np.minimum(to, len(wanted)))

    def project(self, *keep: int, ranges: dict[int, tuple[int, int]] | None = None) -> Histogram:
        """Sum over the axes that aren't kept, flow included, or bin ranges of them."""
        out = Histogram([self.axes[k] for k in keep], self.name, self.title)
        cut = tuple(slice(*((ranges[k][0], ranges[k][1] + 1) if ranges and k in ranges else (None, None))) for k in range(self.dim))
        gone = tuple(k for k in range(self.dim) if k not in keep)
        order = np.argsort(np.argsort(keep))
        out.content = np.transpose(self.content[cut].sum(axis=gone), order)
        out.sumw2 = np.transpose(self.sumw2[cut].sum(axis=gone), order)
        out.weighted, out.entries = self.weighted, self.entries if not ranges else float(out.content.sum())
        if ranges:
            return out._from_bins()
        m = self.moments
        out.moments["w"], out.moments["w2"] = m["w"], m["w2"]
        for i, k in enumerate(keep):
            out.moments[f"w{_XYZ[i]}"] = m[f"w{_XYZ[k]}"]
            for j in range(i, len(keep)):
                a, b = sorted((k, keep[j]))
                out.moments[f"w{_XYZ[i]}{_XYZ[j]}"] = m[f"w{_XYZ[a]}{_XYZ[b]}"]
        return out

    def cumulative(self, forward: bool = True) -> Histogram:
        out = self.copy()
        for name in ("content", "sumw2"):
            a = getattr(self, name)
            inner = tuple(slice(1, -1) for _ in self.axes)
            part = a[inner]
            for k in range(self.dim):
                part = np.cumsum(part, k) if forward else np.flip(np.cumsum(np.flip(part, k), k), k)
            full = np.zeros_like(a)
            full[inner] = part
            setattr(out, name, full)
        return out._from_bins()

    def quantiles(self, probabilities: Iterable[float]) -> list[float]:
        """Where the normalised running sum reaches each probability, linear across a bin."""
        edges, running = self.axes[0].all_edges(), np.concatenate([[0.0], np.cumsum(self.counts())])
        if not running[-1]:
            return [0.0 for _ in probabilities]
        running = running / running[-1]
        out = []
        for p in probabilities:
            k = min(max(int(np.searchsorted(running, p, "right")) - 1, 0), self.axes[0].n - 1)
            step = running[k + 1] - running[k]
            out.append(float(edges[k] + (edges[k + 1] - edges[k]) * (p - running[k]) / step) if step > 0 else float(edges[k]))
        return out

    # single bins, flow included ---------------------------------------------------------------------------------

    def bin_content(self, *at: int) -> float:
        return float(self.content[at])

    def set_bin_content(self, *at_and_value) -> None:
        *at, value = at_and_value
        self.content[tuple(at)] = value

    def add_bin_content(self, *at: int, weight: float = 1.0) -> None:
        self.content[at] += weight
        self.sumw2[at] += weight * weight

    def bin_error(self, *at: int) -> float:
        return float(self.errors(True)[at])

    def bin_error_limits(self, *at: int, level: float = 0.682689492137) -> tuple[float, float]:
        """How far an unweighted bin reaches down and up, by central Poisson limits."""
        n, tail = self.bin_content(*at), (1 - level) / 2
        low = special.gamma_quantile(tail, n) if n > 0 else 0.0
        return n - low, special.gamma_quantile(1 - tail, n + 1) - n

    def interpolated(self, x: float, order: int = 1) -> float:
        """Of one axis, by the polynomial through the nearest ``order + 1`` bin centres."""
        centers, y = self.axes[0].centers(), self.counts()
        k = int(np.clip(np.searchsorted(centers, x) - (order + 1) // 2, 0, max(0, len(centers) - order - 1)))
        near, values, out = centers[k : k + order + 1], y[k : k + order + 1], 0.0
        for i, (c, v) in enumerate(zip(near, values)):
            others = np.delete(near, i)
            out += v * float(np.prod((x - others) / (c - others)))
        return out

    # indexing by bins: ints, slices, ``sum`` ------------------------------------------------------------------

    def __getitem__(self, key):
        key = key if isinstance(key, tuple) else (key,)
        if all(isinstance(k, (int, np.integer)) for k in key):
            return float(self.content[tuple((k if k >= 0 else a.n + k) + 1 for k, a in zip(key, self.axes))])
        out, axis = self, 0
        for k, a in zip(key, self.axes):
            if isinstance(k, slice) and k.step is sum:
                low, high = (a.n if v is None and i else 0 if v is None else v for i, v in ((0, k.start), (1, k.stop)))
                out = out.project(*[i for i in range(out.dim) if i != axis], ranges={axis: (low + 1, high)})
            else:
                low, high = (k, k + 1) if not isinstance(k, slice) else (k.start or 0, a.n if k.stop is None else k.stop)
                edges = a.all_edges()[low : high + 1]
                to = np.clip(np.arange(-1, a.n + 1) - low + 1, 0, high - low + 1)
                out, axis = out._regrouped(axis, edges, to), axis + 1
        return out

    def __setitem__(self, key, value) -> None:
        key = key if isinstance(key, tuple) else (key,)
        self.content[tuple(k + 1 if isinstance(k, int) else slice((k.start or 0) + 1, (a.n if k.stop is None else k.stop) + 1) for k, a in zip(key, self.axes))] = value

    def __repr__(self) -> str:
        return f"<{type(self).__name__} {self.name!r} {[a.n for a in self.axes]} bins, {self.entries:g} entries>"
