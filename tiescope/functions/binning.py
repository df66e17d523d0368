"""Spatial and temporal binning as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tiescope.config import BinConfig, Period


def _floor_div(value: Column, width: int) -> Column:
    """Integer floor division, exact for negative values too."""
    return ((value - F.pmod(value, F.lit(width))) / F.lit(width)).cast("bigint")


def spatial_bin(lng: Column, lat: Column, decimals: int = 3, stride: str = "lng") -> Column:
    """Flat id of the grid cell that holds the point, row (latitude) first."""
    scale = 10 ** decimals
    width = {"lng": 360, "ref": 180}[stride] * scale
    row = F.floor((lat + 90.0) * float(scale)).cast("bigint")
    column = F.floor((lng + 180.0) * float(scale)).cast("bigint")
    return row * F.lit(width).cast("bigint") + column


def start_bin(moment: Column, cfg: BinConfig) -> Column:
    """Bin that contains the instant."""
    since = F.unix_micros(moment) - F.lit(cfg.origin_micros).cast("bigint")
    return _floor_div(since, cfg.bin_micros)


def end_bin(moment: Column, cfg: BinConfig) -> Column:
    """First bin that starts at or after the instant."""
    before = F.lit(cfg.origin_micros).cast("bigint") - F.unix_micros(moment)
    return -_floor_div(before, cfg.bin_micros)


def time_bins(start: Column, end: Column | None, cfg: BinConfig,
              period: Period | None = None) -> Column:
    """Array of the bins an update covers; empty when it ends before it starts.

    ``sequence`` counts downwards when its bounds are swapped, so each use is
    guarded. A ``period`` clips the array before anything is exploded.
    """
    first = start_bin(start, cfg)
    stop = F.coalesce(end_bin(end, cfg), first) if end is not None else first
    last = F.when(first == stop, first).otherwise(stop - 1)
    if period is not None:
        first = F.greatest(first, F.lit(period.start).cast("bigint"))
        last = F.least(last, F.lit(period.end - 1).cast("bigint"))
    nothing = F.array().cast("array<bigint>")
    return F.when(first <= last, F.sequence(first, last)).otherwise(nothing)


def bin_start(time_bin: Column, cfg: BinConfig) -> Column:
    """Timestamp at which a time bin starts (inverse of ``start_bin``)."""
    micros = time_bin.cast("bigint") * F.lit(cfg.bin_micros).cast("bigint")
    return F.timestamp_micros(micros + F.lit(cfg.origin_micros).cast("bigint"))


def slots_of_day(start: Column, end: Column, minutes: int, ref_compat: bool = False) -> Column:
    """Time-of-day slots between two clock times, last one excluded.

    Where the end's clock time is before the start's, the slots go on over
    midnight; ``ref_compat`` gives none.
    """
    def clock(moment: Column) -> Column:
        return F.hour(moment) * 60 + F.minute(moment)
    first = F.floor(clock(start) / F.lit(minutes))
    stop = F.ceil(clock(end) / F.lit(minutes))
    nothing = F.array().cast("array<bigint>")
    same_day = F.when(first < stop, F.sequence(first, stop - 1)).otherwise(nothing)
    if ref_compat:
        return same_day
    day = 24 * 60 // minutes
    over = F.concat(F.sequence(first, F.lit(day - 1).cast("bigint")),
                    F.when(stop > 0, F.sequence(F.lit(0).cast("bigint"), stop - 1)).otherwise(nothing))
    return F.when(clock(end) < clock(start), F.array_distinct(over)).otherwise(same_day)


def magnitude_bucket(value: Column, per_octave: int = 256) -> Column:
    """Coarse bucket that never decreases when ``value`` grows.

    Values of one octave (from a power of two to the next) fall into
    ``per_octave`` buckets, so the number of buckets is bounded for any number
    while each bucket holds a slice of the values.
    """
    size = F.floor(F.log2(F.abs(value.cast("double")) + 1.0) * float(per_octave))
    return F.when(value < 0, -size).otherwise(size)
