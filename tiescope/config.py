"""Grid, time-bin and period settings shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
MICROS_PER_MINUTE = 60_000_000

# Default start of time bin 0 (local midnight in Stockholm, summer time).
DEFAULT_ORIGIN = datetime(2015, 8, 9, tzinfo=timezone(timedelta(hours=2)))


def to_micros(moment: datetime) -> int:
    """Microseconds since the Unix epoch; naive datetimes are read as UTC."""
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    return (moment - EPOCH) // timedelta(microseconds=1)


@dataclass(frozen=True)
class Period:
    """Half-open range of time bins ``[start, end)``."""

    start: int
    end: int

    @property
    def length(self) -> int:
        return self.end - self.start


@dataclass(frozen=True)
class BinConfig:
    """Grid resolution and time-bin size of one run.

    ``stride="lng"`` flattens the grid with the longitude width (360 degrees),
    which makes ids unique. ``stride="ref"`` uses the latitude span (180
    degrees) and exists to reproduce ids stored by older runs.
    """

    decimals: int = 3
    minutes: int = 60
    origin: datetime = DEFAULT_ORIGIN
    stride: str = "lng"

    @property
    def origin_micros(self) -> int:
        return to_micros(self.origin)

    @property
    def bin_micros(self) -> int:
        return self.minutes * MICROS_PER_MINUTE

    def bin_of(self, moment: datetime) -> int:
        """Time bin that contains ``moment``."""
        return (to_micros(moment) - self.origin_micros) // self.bin_micros

    def period(self, start: datetime, end: datetime) -> Period:
        """Period from ``start`` up to, and without, ``end``."""
        last = -((self.origin_micros - to_micros(end)) // self.bin_micros)
        return Period(self.bin_of(start), last)
