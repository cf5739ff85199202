"""Functions of numbers: TMath and <cmath>, as columns where Spark has what they need."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventframe.functions import ieee, special
from eventframe.types import ExpressionError


def _d(x: Column | float) -> Column:
    return x.cast("double") if isinstance(x, Column) else F.lit(float(x))


def _trunc(x: Column) -> Column:
    d = _d(x)
    return F.when(F.isnan(d) | (F.abs(d) > 9e15), d).when(d < 0, _d(F.ceil(d))).otherwise(_d(F.floor(d)))


def _whole(f) -> Callable[[Column], Column]:
    return lambda x: F.when(F.isnan(_d(x)) | (F.abs(_d(x)) > 9e15), _d(x)).otherwise(_d(f(_d(x))))


def _gaus(x, mean=0.0, sigma=1.0, norm=None):
    arg = ieee.divided(_d(x) - _d(mean), _d(sigma))
    out = F.when(F.abs(arg) > 39, F.lit(0.0)).otherwise(F.exp(arg * arg * -0.5))
    if norm is not None:
        out = F.when(_d(norm) != 0, ieee.divided(out, F.lit(2.50662827463100024) * _d(sigma))).otherwise(out)
    return F.when(_d(sigma) == 0, F.lit(1e30)).otherwise(out)


def _breit_wigner(x, mean=0.0, gamma=1.0):
    return ieee.divided(_d(gamma), ((_d(x) - _d(mean)) * (_d(x) - _d(mean)) + _d(gamma) * _d(gamma) / 4)) / (2 * math.pi)


def arrow(f: Callable) -> Callable[..., Column]:
    """A function of arrays that Spark lacks, over Arrow batches; null where an argument is null."""

    @F.arrow_udf(T.DoubleType())
    def batch(rows: pa.Array) -> pa.Array:
        columns = rows.flatten()
        known = ~np.logical_or.reduce([c.is_null().to_numpy(zero_copy_only=False) for c in columns])
        out = np.full(len(rows), np.nan)
        if known.any():
            out[known] = f(*[c.to_numpy(zero_copy_only=False)[known].astype(np.float64) for c in columns])
        return pa.array(out, mask=~known)

    return lambda *cols: batch(F.struct(*[_d(c).alias(f"x{i}") for i, c in enumerate(cols)]))


def _finite(x):
    return ~F.isnan(_d(x)) & (F.abs(_d(x)) != ieee.INF)


_ONE: dict[str, Callable] = {
    "sqrt": lambda x: F.sqrt(_d(x)), "cbrt": lambda x: F.cbrt(_d(x)), "exp": lambda x: F.exp(_d(x)), "exp2": lambda x: F.pow(F.lit(2.0), _d(x)),
    "log": lambda x: ieee.logarithm(F.ln, x), "log10": lambda x: ieee.logarithm(F.log10, x), "log2": lambda x: ieee.logarithm(F.log2, x),
    "sin": lambda x: F.sin(_d(x)), "cos": lambda x: F.cos(_d(x)), "tan": lambda x: F.tan(_d(x)), "asin": lambda x: F.asin(_d(x)), "acos": lambda x: F.acos(_d(x)), "atan": lambda x: F.atan(_d(x)),
    "sinh": lambda x: F.sinh(_d(x)), "cosh": lambda x: F.cosh(_d(x)), "tanh": lambda x: F.tanh(_d(x)), "asinh": lambda x: F.asinh(_d(x)), "acosh": lambda x: F.acosh(_d(x)), "atanh": lambda x: F.atanh(_d(x)),
    "floor": _whole(F.floor), "ceil": _whole(F.ceil), "trunc": _trunc, "rint": lambda x: F.rint(_d(x)),
    "round": lambda x: F.when(_d(x) < 0, -_whole(F.floor)(-_d(x) + 0.5)).otherwise(_whole(F.floor)(_d(x) + 0.5)),
    "sq": lambda x: _d(x) * _d(x), "erf": arrow(special.erf), "erfc": arrow(special.erfc), "tgamma": arrow(special.gamma), "lgamma": arrow(special.log_gamma),
}
_TESTS = {
    "isnan": lambda x: F.isnan(_d(x)), "isinf": lambda x: F.abs(_d(x)) == ieee.INF, "isfinite": _finite,
}
_TWO: dict[str, Callable] = {
    "pow": lambda x, y: F.pow(_d(x), _d(y)), "atan2": lambda x, y: F.atan2(_d(x), _d(y)), "fmod": ieee.remainder, "hypot": lambda x, y: F.hypot(_d(x), _d(y)),
    "min": ieee.least, "max": ieee.greatest, "fmin": ieee.least, "fmax": ieee.greatest,
}

#: Names under ``TMath::`` that differ from <cmath>'s.
_TMATH = {
    "Sqrt": "sqrt", "Exp": "exp", "Log": "log", "Log10": "log10", "Log2": "log2", "Sin": "sin", "Cos": "cos", "Tan": "tan", "ASin": "asin", "ACos": "acos", "ATan": "atan",
    "SinH": "sinh", "CosH": "cosh", "TanH": "tanh", "ASinH": "asinh", "ACosH": "acosh", "ATanH": "atanh", "Floor": "floor", "Ceil": "ceil", "Nint": "rint", "Sq": "sq",
    "Erf": "erf", "Erfc": "erfc", "Gamma": "tgamma", "LnGamma": "lgamma", "Power": "pow", "ATan2": "atan2", "Hypot": "hypot", "Min": "min", "Max": "max", "IsNaN": "isnan", "Finite": "isfinite",
}

#: Constants under ``TMath::``, called without arguments (fixed values).
CONSTANTS = {
    "Pi": math.pi, "TwoPi": 2 * math.pi, "PiOver2": math.pi / 2, "PiOver4": math.pi / 4, "InvPi": 1 / math.pi, "E": math.e, "Ln10": math.log(10),
    "LogE": math.log10(math.e), "Sqrt2": math.sqrt(2), "DegToRad": math.pi / 180, "RadToDeg": 180 / math.pi, "C": 299792458.0,
    "QuietNaN": math.nan, "SignalingNaN": math.nan, "Infinity": math.inf,
}

#: Name: (least arguments, most, function of columns, kind of the result).
REGISTRY: dict[str, tuple[int, int, Callable, str]] = {}
for _name, _f in _ONE.items():
    REGISTRY[_name] = (1, 1, _f, "f64")
for _name, _f in _TESTS.items():
    REGISTRY[_name] = (1, 1, _f, "bool")
for _name, _f in _TWO.items():
    REGISTRY[_name] = (2, 2, _f, "f64")
for _name in list(REGISTRY):
    REGISTRY[f"std::{_name}"] = REGISTRY[_name]
for _name, _of in _TMATH.items():
    REGISTRY[f"TMath::{_name}"] = REGISTRY[_of]
for _name, _v in CONSTANTS.items():
    REGISTRY[f"TMath::{_name}"] = (0, 0, lambda v=_v: F.lit(v), "f64")
REGISTRY |= {
    "TMath::Sign": (2, 2, lambda a, b: F.when(_d(b) >= 0, F.abs(_d(a))).otherwise(-F.abs(_d(a))), "f64"),
    "TMath::Gaus": (1, 4, _gaus, "f64"),
    "TMath::BreitWigner": (1, 3, _breit_wigner, "f64"),
    "TMath::Gamma": (1, 2, lambda z, x=None: _ONE["tgamma"](z) if x is None else arrow(special.incomplete_gamma)(z, x), "f64"),
    "TMath::Even": (1, 1, lambda x: _d(x).cast("long") % 2 == 0, "bool"),
    "TMath::Odd": (1, 1, lambda x: _d(x).cast("long") % 2 != 0, "bool"),
    "TMath::FloorNint": (1, 1, lambda x: F.floor(_d(x)).cast("int"), "i32"),
    "TMath::CeilNint": (1, 1, lambda x: F.ceil(_d(x)).cast("int"), "i32"),
    "TMath::AreEqualAbs": (3, 3, lambda a, b, e: F.abs(_d(a) - _d(b)) < _d(e), "bool"),
    "TMath::AreEqualRel": (3, 3, lambda a, b, e: (_d(a) == _d(b)) | (F.abs(_d(a) - _d(b)) <= F.lit(0.5) * _d(e) * (F.abs(_d(a)) + F.abs(_d(b)))), "bool"),
    "TMath::LaplaceDist": (1, 3, lambda x, alpha=0.0, beta=1.0: F.exp(-F.abs((_d(x) - _d(alpha)) / _d(beta))) / (2.0 * _d(beta)), "f64"),
    "TMath::CauchyDist": (1, 3, lambda x, t=0.0, s=1.0: _d(s) / ((_d(x) - _d(t)) * (_d(x) - _d(t)) + _d(s) * _d(s)) / math.pi, "f64"),
}
for _name, (_n, _f) in special.SCALARS.items():
    REGISTRY.setdefault(_name, (_f.required, _n, arrow(_f), "f64"))


def function(name: str, count: int) -> tuple[Callable, str]:
    if name not in REGISTRY:
        raise ExpressionError(f"no function {name}")
    least, most, f, kind = REGISTRY[name]
    if not least <= count <= most:
        raise ExpressionError(f"{name} takes {least} to {most} arguments, not {count}")
    return f, kind
