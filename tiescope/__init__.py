"""Spatiotemporal co-occurrence analytics as Spark DataFrame jobs.

Location updates ("this user was at this point from A to B") are cleaned,
binned into grid cells and time bins, paired into co-occurrences, and turned
into per-pair features, contact graphs, distribution reports and models that
predict who meets again.
"""

from tiescope.config import BinConfig, Period

__all__ = ["BinConfig", "Period"]
