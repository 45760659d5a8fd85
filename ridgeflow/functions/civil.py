"""Civil days, origins and windows in Paris time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Europe/Paris"
ORIGIN_LEAD_DAYS = 7


def civil_date(instant: Column) -> Column:
    """Paris civil day of an instant."""
    return F.to_date(F.from_utc_timestamp(instant, ZONE))


def midnight(day: Column) -> Column:
    """Instant of 00:00 in Paris of a civil day, across clock changes."""
    return F.to_utc_timestamp(day.cast("timestamp"), ZONE)


def origin(day: Column) -> Column:
    """Instant from which nothing later is known: midnight, seven days before."""
    return midnight(F.date_sub(day, ORIGIN_LEAD_DAYS))


def available(instant: Column, at_origin: Column) -> Column:
    return instant < at_origin


def is_origin(instant: Column) -> Column:
    """The instant is a Paris midnight."""
    local = F.from_utc_timestamp(instant, ZONE)
    return local == F.date_trunc("day", local)


def window_bound(at_origin: Column, days: Column) -> Column:
    """Low bound of a window of civil days (not 24 h multiples); null = all the past."""
    day = F.date_sub(civil_date(at_origin), days.cast("int"))
    return F.when(days.isNotNull(), midnight(day))


def curve_age_days(available_at: Column, day: Column) -> Column:
    return F.datediff(day, civil_date(available_at))


def in_date_range(start: Column, date_from: Column, date_to: Column) -> Column:
    """Paris day of a start within a closed range."""
    return civil_date(start).between(date_from, date_to)


def clock_time(start: Column, elapsed_s: Column) -> Column:
    """Clock time of an elapsed time after a start."""
    return F.timestamp_micros(F.unix_micros(start) + F.round(elapsed_s * 1_000_000).cast("long"))


def decimal_hour(moment: Column) -> Column:
    return F.hour(moment) + F.minute(moment) / 60 + F.second(moment) / 3600


def period_of(day: Column, start: Column, end: Column) -> Column:
    """Before, inside (discovery) or after a declared period; all without one."""
    return (
        F.when(start.isNull(), "all")
        .when(day < start, "before")
        .when(day > end, "after")
        .otherwise("discovery")
    )
