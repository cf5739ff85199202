"""Binned results: filled by grouped aggregates, handled on the driver."""

from eventframe.hist.axis import Axis, good_limits
from eventframe.hist.compare import Graph, background, chi2, kolmogorov, smooth
from eventframe.hist.histogram import Histogram
from eventframe.hist.profile import Efficiency, Profile, sparse_bins

__all__ = ["Axis", "Efficiency", "Graph", "Histogram", "Profile", "background", "chi2", "good_limits", "kolmogorov", "smooth", "sparse_bins"]
