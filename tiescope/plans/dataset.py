"""Train and test sets from location updates of three consecutive periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tiescope.config import BinConfig, Period
from tiescope.operators.cohorts import cross_occupancy
from tiescope.operators.features import labelled_features
from tiescope.operators.presence import presence
from tiescope.session import stage


def build_dataset(locations: DataFrame, cfg: BinConfig, periods: list[Period],
                  apps: DataFrame | None = None, demographics: DataFrame | None = None,
                  share: float | None = None, zone: str = "Europe/Stockholm",
                  halves: Sequence[int] = (0, 1)) -> tuple[DataFrame, ...]:
    """Feature tables (train, test) with the label of the following period.

    ``share`` restricts the pairs to users seen in that part of the bins of
    every period. ``halves`` names the tables that are wanted, train (0) and
    test (1): tables of users are written for each.
    """
    first, _, third = periods
    people = stage(presence(locations, cfg, Period(first.start, third.end)), "presence")
    users = stage(cross_occupancy(people, periods, share), "users") if share is not None else None
    options = {"apps": apps, "demographics": demographics, "users": users, "zone": zone}
    return tuple(labelled_features(people, cfg, periods[half], periods[half + 1], **options) for half in halves)
