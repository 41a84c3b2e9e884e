"""Times, cube keys and periods. Times are UTC without a zone; cube keys are text in a fixed offset."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column
from pyspark.sql import functions as F

CUBE_HOURS = 8


def _column(at: str | Column) -> Column:
    return F.col(at) if isinstance(at, str) else at


def local_day(at: str | Column, hours: int = CUBE_HOURS) -> Column:
    return (_column(at) + F.make_dt_interval(hours=F.lit(hours))).cast("date").cast("string")


def local_hour(at: str | Column, hours: int = CUBE_HOURS) -> Column:
    text = (_column(at) + F.make_dt_interval(hours=F.lit(hours))).cast("string")
    return F.concat(F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 2), F.lit(":00"))


def zoned(at: str | Column, zone: str) -> Column:
    """Local time in an IANA zone, summer time included."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), _column(at))


def zone_day(at: str | Column, zone: str) -> Column:
    return zoned(at, zone).cast("date").cast("string")


def zone_hour(at: str | Column, zone: str) -> Column:
    return local_hour(zoned(at, zone), 0)


def week_key(day: str | Column) -> Column:
    """Monday of a day's ISO week."""
    d = _column(day).cast("date")
    return F.date_sub(d, F.weekday(d)).cast("string")


def month_key(day: str | Column) -> Column:
    return F.concat(F.substring(_column(day), 1, 7), F.lit("-01"))


def floor_hour(at: str | Column) -> Column:
    return F.date_trunc("hour", _column(at)).cast("timestamp_ntz")


def ceil_hour(at: str | Column) -> Column:
    floor = floor_hour(at)
    return F.when(floor == _column(at), floor).otherwise(floor + F.expr("interval 1 hour"))


def uuid7_millis(value: str | Column) -> Column:
    """Milliseconds in the first 12 hex digits of a version 7 UUID; null if there aren't 12."""
    digits = F.substring(F.replace(_column(value), F.lit("-"), F.lit("")), 1, 12)
    return F.when(digits.rlike("^[0-9a-fA-F]{12}$"), F.conv(digits, 16, 10).cast("bigint"))


@dataclass(frozen=True)
class Period:
    """A request's window and what it is compared with, in UTC; None is open."""

    label: str
    start: datetime | None
    end: datetime
    compare_start: datetime | None
    compare_end: datetime | None
    zone: str
    grain: str
    partial: bool


def midnight(day: date, zone: ZoneInfo) -> datetime | None:
    """A day's first moment in UTC: the earlier if there are two, none if the clock skips it."""
    local = datetime(day.year, day.month, day.day, tzinfo=zone)
    at = local.astimezone(UTC)
    return at if at.astimezone(zone).replace(tzinfo=None) == local.replace(tzinfo=None) else None


def shifted_month(day: date, months: int) -> date:
    years, month = divmod(day.year * 12 + day.month - 1 + months, 12)
    return date(years, month + 1, 1)


#: The default grain of each label, and whether its last bucket is partial.
GRAINS = {
    "today": ("hour", True),
    "week": ("day", True),
    "rolling7": ("day", False),
    "month": ("day", True),
    "rolling30": ("day", False),
    "weeks12": ("week", True),
    "months12": ("month", True),
    "lifetime": ("month", False),
}
DEFAULT_ZONE, DEFAULT_PERIOD = "Asia/Shanghai", "rolling30"


def resolve_period(label: str | None, zone: str | None, now: datetime) -> Period:
    """The window of a label at a pinned time. Unknown labels are open; unknown zones are DEFAULT_ZONE."""
    label = label or DEFAULT_PERIOD
    try:
        tz = ZoneInfo(zone or DEFAULT_ZONE)
    except (ZoneInfoNotFoundError, ValueError):
        tz = ZoneInfo(DEFAULT_ZONE)
    now = now.replace(tzinfo=UTC) if now.tzinfo is None else now.astimezone(UTC)
    today = now.astimezone(tz).date()
    week, month = today - timedelta(days=today.weekday()), today.replace(day=1)
    grain, partial = GRAINS.get(label, ("month", False))
    days = {"rolling7": 7, "rolling30": 30}.get(label)
    first = {"today": today, "week": week, "month": month, "weeks12": week - timedelta(weeks=11), "months12": shifted_month(month, -11)}.get(label)
    start = now - timedelta(days=days) if days else midnight(first, tz) if first else None
    before = {"today": today - timedelta(days=1), "week": week - timedelta(weeks=1), "month": shifted_month(month, -1), "months12": shifted_month(month, -23)}.get(label)
    if before:
        compare_start = midnight(before, tz)
    else:
        compare_start = start - timedelta(weeks=12) if label == "weeks12" and start else start - timedelta(days=days) if days and start else None
    compare_end = start if compare_start is not None else None
    if label in ("today", "week", "month") and compare_start and start:
        compare_end = min(compare_start + (now - start), start)
    return Period(label, start, now, compare_start, compare_end, tz.key, grain, partial)


def duration_label(minutes: str | Column) -> Column:
    """Minutes as text: in days or hours if they are whole, else in minutes."""
    m = _column(minutes)
    unit = lambda n, name: F.concat((m / n).cast("bigint").cast("string"), F.lit(f" {name}"))
    return F.when((m >= 1440) & (m % 1440 == 0), unit(1440, "days")).when((m >= 60) & (m % 60 == 0), unit(60, "hours")).otherwise(unit(1, "minutes"))


def crosses(start: str | Column, end: str | Column, zone: str, year: bool = False) -> Column:
    """Whether a window's start and end lie in different months, or years, of a zone; false without a start."""
    part = lambda at: F.substring(zoned(at, zone).cast("string"), 1, 4 if year else 7)
    return F.coalesce(part(start) != part(end), F.lit(False))
