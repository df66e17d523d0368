"""All queries by name."""

from __future__ import annotations

from tiescope.catalog import (binning, cleaning, features, graph, joins, models, order, profiles,
                              sequences, sets, sources, viewer)
from tiescope.catalog.base import Query

QUERIES: dict[str, Query] = {}
for _module in (sources, binning, cleaning, joins, profiles, sequences, order, sets, features,
                graph, models, viewer):
    QUERIES.update(_module.QUERIES)
