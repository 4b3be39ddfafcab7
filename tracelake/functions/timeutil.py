"""Interval strings, relative times and period arithmetic, always against a given ``now``."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800, "M": 30 * 86400, "y": 365 * 86400}


def interval_seconds(text: str | None, default: str = "5m") -> int:
    """``5m`` -> 300; anything that isn't number + s/m/h/d falls back to the default."""
    m = re.fullmatch(r"(\d+)([smhd])", text or "") or re.fullmatch(r"(\d+)([smhd])", default)
    return int(m[1]) * _SECONDS[m[2]]


def resolve_time(text: str, now: datetime) -> datetime:
    """ISO-8601, ``now`` or ``now-7d`` (s, m, h, d, w, M = 30 days, y = 365 days)."""
    m = re.fullmatch(r"now(?:([-+])(\d+)([smhdwMy]))?", text.strip())
    if not m:
        return datetime.fromisoformat(text.replace("Z", "+00:00")).replace(tzinfo=None)
    if not m[1]:
        return now
    step = timedelta(seconds=int(m[2]) * _SECONDS[m[3]])
    return now - step if m[1] == "-" else now + step


def resolve_range(start: str, end: str, now: datetime) -> tuple[datetime, datetime]:
    a, z = resolve_time(start, now), resolve_time(end, now)
    if a >= z:
        raise ValueError("the start of a range must lie before its end")
    return a, z


def default_range(now: datetime) -> tuple[datetime, datetime]:
    return now - timedelta(hours=1), now


def time_range(ts: Column, start, end) -> Column:
    """Both ends belong to the range."""
    return (ts >= F.lit(start)) & (ts <= F.lit(end))


def bucket(ts: Column, seconds: int) -> Column:
    """Start of the epoch-aligned bucket."""
    return F.window(ts, f"{seconds} seconds")["start"]


def series_interval(span_seconds: float) -> int:
    """Bucket width by length of the range: 1 m, 5 m, 1 h, 6 h, 1 d."""
    for most, width in ((3600, 60), (86400, 300), (7 * 86400, 3600), (30 * 86400, 21600)):
        if span_seconds <= most:
            return width
    return 86400


def auto_interval(span_seconds: float, buckets: int = 100) -> int:
    """The smallest usual width that needs at most so many buckets."""
    for width in (1, 5, 10, 30, 60, 300, 600, 1800, 3600, 10800, 21600, 43200, 86400, 604800, 2592000):
        if span_seconds / width <= buckets:
            return width
    return 31536000


def previous_periods(start: datetime, end: datetime, count: int = 7, step: timedelta = timedelta(days=1)) -> list[tuple[datetime, datetime]]:
    """The same range shifted back 1..count steps."""
    return [(start - step * i, end - step * i) for i in range(1, count + 1)]


def horizon_points(text: str, interval: str) -> int:
    """How many buckets of ``interval`` fit in a horizon such as ``24h`` or ``2w``."""
    m = re.fullmatch(r"(\d+)\s*(h|d|w|month)", text)
    seconds = int(m[1]) * {"h": 3600, "d": 86400, "w": 604800, "month": 30 * 86400}[m[2]]
    return max(1, seconds // interval_seconds(interval, "1h"))


def format_time(ts: Column, style: str = "medium") -> Column:
    return F.date_format(ts, {"short": "HH:mm", "medium": "yyyy-MM-dd HH:mm", "long": "yyyy-MM-dd HH:mm:ss"}[style])
