"""Fixed-width time buckets."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegauge.errors import SchemaError
from tidegauge.functions.scalar import micros

EPOCH = datetime(1970, 1, 1)

# Named query windows.
WINDOWS = {
    "1min": timedelta(minutes=1),
    "5min": timedelta(minutes=5),
    "1h": timedelta(hours=1),
    "1hour": timedelta(hours=1),
    "1day": timedelta(days=1),
    "1week": timedelta(weeks=1),
}

_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def window_length(name: str) -> timedelta:
    """The length of a named query window such as ``1h``."""
    try:
        return WINDOWS[name.lower()]
    except KeyError:
        raise SchemaError(f"unknown window {name!r}; have {sorted(WINDOWS)}") from None


def width_of(granularity: str | timedelta) -> timedelta:
    """The width of a granularity such as ``30 minutes``."""
    if isinstance(granularity, timedelta):
        return granularity
    count, _, unit = granularity.strip().lower().partition(" ")
    seconds = _UNITS.get(unit.rstrip("s"))
    if not count.isdigit() or int(count) == 0 or seconds is None:
        raise SchemaError(f"unknown granularity {granularity!r}; write e.g. '15 minutes' or '1 day'")
    return timedelta(seconds=int(count) * seconds)


def interval_text(width: timedelta) -> str:
    return f"{width // timedelta(microseconds=1)} microseconds"


def bucket(ts: Column | str, granularity: str | timedelta, origin: datetime = EPOCH) -> Column:
    """The start of the bucket holding ``ts``.

    Buckets are counted from ``origin``: weekly buckets start on Thursday by default and
    on Monday with ``origin=datetime(1970, 1, 5)``. The type of ``ts`` is kept, and a null
    time has a null bucket.
    """
    own = F.col(ts) if isinstance(ts, str) else ts
    micro = timedelta(microseconds=1)
    width = width_of(granularity)
    past = F.pmod(micros(own) - F.lit((origin - EPOCH) % width // micro), F.lit(width // micro))
    seconds = (past.cast("decimal(18,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    return own - F.make_dt_interval(secs=seconds)


def watermarked_bucket(ts: Column | str, granularity: str | timedelta, origin: datetime = EPOCH) -> Column:
    """``bucket`` for streams: keeps the watermark of ``ts``, and drops rows with a null time."""
    width = width_of(granularity)
    shift = (origin - EPOCH) % width
    start = interval_text(shift) if shift else None
    return F.window(ts, interval_text(width), None, start).getField("start")


def floor_to(moment: datetime, granularity: str | timedelta, origin: datetime = EPOCH) -> datetime:
    """``bucket`` for a single moment on the driver."""
    width = width_of(granularity)
    return moment - (moment - origin) % width


def ceil_to(moment: datetime, granularity: str | timedelta, origin: datetime = EPOCH) -> datetime:
    low = floor_to(moment, granularity, origin)
    return low if low == moment else low + width_of(granularity)


def align_out(
    start: datetime, end: datetime, granularity: str | timedelta, origin: datetime = EPOCH
) -> tuple[datetime, datetime]:
    """The smallest window of whole buckets around ``[start, end)``."""
    return floor_to(start, granularity, origin), ceil_to(end, granularity, origin)
