"""Time windows: every report takes an explicit ``as_of`` instead of a wall clock.

Trailing windows are ``[as_of - days, +inf)`` and date ranges are the
half-open ``[date_from 00:00, date_to + 1 day 00:00)`` in UTC.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_datetime(value: datetime | date | str) -> datetime:
    """UTC wall-clock time; a value with a zone is converted first."""
    if isinstance(value, date) and not isinstance(value, datetime):
        return datetime.combine(value, datetime.min.time())
    moment = value if isinstance(value, datetime) else datetime.fromisoformat(str(value))
    return moment if moment.tzinfo is None else moment.astimezone(timezone.utc).replace(tzinfo=None)


def as_date(value: datetime | date | str) -> date:
    if isinstance(value, datetime):
        return value.date()
    if isinstance(value, date):
        return value
    return date.fromisoformat(str(value)[:10])


def ts_lit(value: datetime | date | str) -> Column:
    """A timestamp literal in UTC wall-clock form (folds to a constant, so it
    is pushed to the Parquet scan)."""
    return F.lit(as_datetime(value).strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def date_lit(value: datetime | date | str) -> Column:
    return F.lit(as_date(value).isoformat()).cast("date")


@dataclass(frozen=True)
class Span:
    """Half-open time interval ``[start, end)``; ``end=None`` is unbounded."""

    start: datetime
    end: datetime | None = None

    @classmethod
    def trailing(cls, as_of, days: int) -> "Span":
        return cls(as_datetime(as_of) - timedelta(days=days), None)

    @classmethod
    def trailing_hours(cls, as_of, hours: int) -> "Span":
        return cls(as_datetime(as_of) - timedelta(hours=hours), None)

    @classmethod
    def dates(cls, date_from, date_to) -> "Span":
        d0, d1 = as_date(date_from), as_date(date_to)
        if d1 < d0:
            raise ValueError("date_to must be on or after date_from")
        return cls(as_datetime(d0), as_datetime(d1 + timedelta(days=1)))

    def filter(self, df, col: str, day_col: str = "seen_day"):
        """``df`` restricted to the span; when the table is partitioned by a
        day column the same bounds are added on it, so whole day directories
        are pruned at planning time."""
        out = df.filter(self.contains(col))
        if day_col in df.columns:
            out = out.filter(F.col(day_col) >= date_lit(self.start))
            if self.end is not None:
                out = out.filter(F.col(day_col) <= date_lit(self.end))
        return out

    def contains(self, col: Column | str) -> Column:
        c = F.col(col) if isinstance(col, str) else col
        cond = c >= ts_lit(self.start)
        if self.end is not None:
            cond = cond & (c < ts_lit(self.end))
        return cond


def span_of(as_of=None, days: int | None = None, date_from=None, date_to=None) -> Span:
    """Either a trailing window (as_of, days) or an inclusive date range."""
    if date_from is not None or date_to is not None:
        return Span.dates(date_from, date_to)
    if as_of is None or days is None:
        raise ValueError("give (as_of, days) or (date_from, date_to)")
    return Span.trailing(as_of, days)
