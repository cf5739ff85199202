"""Collections of four-vectors as one column of structs: transverse momentum, pseudorapidity, azimuth and mass."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventframe.functions.vecops import delta_phi, let, mass_of, momentum


def zipped(pt: Column, eta: Column, phi: Column, m: Column) -> Column:
    """One struct for each place of four collections."""
    own = [F.transform(c, lambda x: x.cast("double")) for c in (pt, eta, phi, m)]
    return F.transform(F.arrays_zip(*own), lambda r: F.struct(*[r.getField(str(k)).alias(n) for k, n in enumerate(("pt", "eta", "phi", "m"))]))


def cartesian(v: Column) -> Column:
    """x, y, z and e of one four-vector."""
    return F.struct(*[c.alias(n) for n, c in zip("xyze", momentum(v["pt"], v["eta"], v["phi"], v["m"]))])


def total(vs: Column) -> Column:
    """The sum of a collection of four-vectors."""
    zero = F.struct(*[F.lit(0.0).alias(n) for n in "xyze"])
    return F.aggregate(F.transform(vs, cartesian), zero, lambda a, p: F.struct(*[(a[n] + p[n]).alias(n) for n in "xyze"]))


def mass(p: Column) -> Column:
    return let(p, lambda q: mass_of([q[n] for n in "xyze"]))


def transverse(p: Column) -> Column:
    return let(p, lambda q: F.hypot(q["x"], q["y"]))


def distance(a: Column, b: Column) -> Column:
    """In pseudorapidity and azimuth."""
    return F.hypot(a["eta"] - b["eta"], delta_phi(a["phi"], b["phi"]))
