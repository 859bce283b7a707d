"""Dates and times. The zone and today are parameters; nothing reads the session's zone or clock."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicons as L
from .text import col

BARE_DATE = r"^\d{4}-\d{2}-\d{2}$"
ISO = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2}))?$"
CLOCK = r"(?i)(?<![A-Za-z0-9_])(\d{1,2})(?::(\d{2}))?\s*(am|pm)(?![A-Za-z0-9_])"


def day(value: date | str | Column) -> Column:
    """A date parameter as a Column."""
    return value if isinstance(value, Column) else F.to_date(F.lit(str(value)))


def valid_date(c: str | Column) -> Column:
    """Date of a well-formed, existing calendar day; else null."""
    return F.when(col(c).rlike(BARE_DATE), F.try_to_date(col(c), "yyyy-MM-dd"))


def is_iso_or_date(c: str | Column) -> Column:
    """Shape check at the publishing boundary."""
    return col(c).rlike(ISO)


def utc_instant(c: str | Column) -> Column:
    """Zone-less UTC timestamp of an ISO text with offset; null if there is none."""
    c = col(c)
    wall = F.try_to_timestamp(F.concat(F.substring(c, 1, 10), F.lit(" "), F.substring(c, 12, 8), F.lit("+00:00")), F.lit("yyyy-MM-dd HH:mm:ssXXX"))
    zone = F.regexp_extract(c, r"(Z|[+-]\d{2}:?\d{2})$", 1)
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    minutes = F.when((zone == "Z") | (zone == ""), 0).otherwise(sign * (F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")))
    seconds = F.unix_timestamp(wall) - minutes * 60
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.when(c.rlike(ISO) & (zone != ""), epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)")))


def zone_time(utc: str | Column, tz: str = L.TIME_ZONE) -> Column:
    """Wall time in a zone of a zone-less UTC timestamp."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), col(utc))


def local_date(c: str | Column, tz: str = L.TIME_ZONE) -> Column:
    """Day of an event: a bare date as it is, an instant's date in the zone, null if invalid."""
    return F.when(col(c).rlike(BARE_DATE), valid_date(c)).otherwise(F.to_date(zone_time(utc_instant(c), tz)))


def display_time(c: str | Column, all_day: str | Column, tz: str = L.TIME_ZONE) -> Column:
    """``All day``, ``TBD`` or ``h:mm AM``."""
    shown = F.date_format(zone_time(utc_instant(c), tz), "h:mm a")
    return F.when(col(all_day) | col(c).rlike(BARE_DATE), "All day").otherwise(F.coalesce(shown, F.lit("TBD")))


def _clock(c: Column) -> tuple[Column, Column]:
    """Hour from 0 and minute of a time text; null where out of range or absent."""
    hour = F.regexp_extract(c, CLOCK, 1).try_cast("int")
    minute = F.coalesce(F.regexp_extract(c, CLOCK, 2).try_cast("int"), F.lit(0))
    pm = F.lower(F.regexp_extract(c, CLOCK, 3)) == "pm"
    ok = hour.between(1, 12) & (minute <= 59)
    return F.when(ok, hour % 12 + F.when(pm, 12).otherwise(0)), minute


def minute_of_day(c: str | Column, all_day_rank: int = 0, last: int = 1 << 30) -> Column:
    """Minutes since midnight of a time text; all-day and absent times rank as given, unreadable ones last."""
    c = F.coalesce(col(c), F.lit(""))
    hour, minute = _clock(c)
    return F.when((c == "") | c.rlike(r"(?i)all\s*day"), all_day_rank).otherwise(F.coalesce(hour * 60 + minute, F.lit(last)))


def parse_hour(c: str | Column) -> Column:
    """Hour of a time text, or null."""
    return _clock(F.coalesce(col(c), F.lit("")))[0]


def days_between(a: str | Column, b: str | Column) -> Column:
    return F.datediff(col(b), col(a))


def add_days(c: str | Column, n: int | Column) -> Column:
    return F.date_add(col(c), n)


def weekend_days(today: date | str | Column) -> Column:
    """This weekend's Saturday and Sunday; on a Sunday yesterday and today."""
    t = day(today)
    saturday = F.date_add(t, F.when(F.dayofweek(t) == 1, -1).otherwise(7 - F.dayofweek(t)))
    return F.array(saturday, F.date_add(saturday, 1))


def recency(c: str | Column, today: date | str | Column) -> Column:
    """Bonus of days soon ahead, falling to nothing."""
    ahead = F.datediff(col(c), day(today))
    return F.when(ahead.between(0, L.RECENCY_DAYS), F.floor(L.RECENCY * (1 - ahead / L.RECENCY_DAYS) + 0.5)).otherwise(0).cast("int")


def fuzzy_score(distance: str | Column) -> Column:
    """Points of a loose match by its distance from 0 to 1."""
    return F.floor((1 - col(distance)) * 40 + 0.5).cast("int")


def with_utc_suffix(c: str | Column) -> Column:
    """UTC time texts as ISO with Z; a bare date is its midnight."""
    c = F.replace(F.trim(col(c)), F.lit(" "), F.lit("T"))
    return F.when(c.rlike(BARE_DATE), F.concat(c, F.lit("T00:00:00Z"))).when(c.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), c).otherwise(F.concat(c, F.lit("Z")))


def _offset(wall: Column, utc: Column, tz: str) -> Column:
    """Seconds that the zone is ahead of UTC at a UTC instant."""
    return F.timestamp_diff("SECOND", utc, zone_time(utc, tz))


def _with_offset(wall: Column, seconds: Column) -> Column:
    mark = F.when(seconds < 0, "-").otherwise("+")
    hours, minutes = F.floor(F.abs(seconds) / 3600).cast("int"), (F.abs(seconds) / 60 % 60).cast("int")
    return F.concat(F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss"), mark, F.lpad(hours.cast("string"), 2, "0"), F.lit(":"), F.lpad(minutes.cast("string"), 2, "0"))


def _noon(wall: Column) -> Column:
    return (F.to_date(wall).cast("timestamp_ntz") + F.expr("INTERVAL 12 HOURS")).cast("timestamp_ntz")


def token_to_iso(c: str | Column, tz: str = L.TIME_ZONE, standard: int = -8 * 3600) -> Column:
    """ISO text of a compact token: a date as it is, wall time with its offset.

    Standard time is tried first, so an hour that occurs twice is the later
    one; an hour that does not occur takes the offset at noon UTC of its day.
    Malformed tokens and days that do not exist are null.
    """
    c = col(c)
    date_part = valid_date(F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2)))
    wall = F.try_to_timestamp(F.regexp_replace(c, "Z$", ""), F.lit("yyyyMMdd'T'HHmmss")).cast("timestamp_ntz")
    as_standard = wall - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(standard))
    summer = as_standard - F.expr("INTERVAL 1 HOUR")
    seconds = (
        F.when(_offset(wall, as_standard, tz) == standard, F.lit(standard))
        .when(_offset(wall, summer, tz) == standard + 3600, F.lit(standard + 3600))
        .otherwise(_offset(wall, _noon(wall), tz))
    )
    timed = F.when(c.rlike(r"^\d{8}T\d{6}Z$"), F.concat(F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).otherwise(_with_offset(wall, seconds))
    return F.when(c.rlike(r"^\d{8}$") & date_part.isNotNull(), date_part.cast("string")).when(c.rlike(r"^\d{8}T\d{6}Z?$") & date_part.isNotNull(), timed)


def us_datetime_to_iso(c: str | Column, tz: str = L.TIME_ZONE) -> Column:
    """ISO text of ``MM/dd/yyyy hh:mm am``; the day's offset is that of its noon UTC."""
    text = F.upper(F.regexp_replace(F.trim(col(c)), r"\s+", " "))
    wall = F.try_to_timestamp(text, F.lit("MM/dd/yyyy hh:mm a")).cast("timestamp_ntz")
    return F.when(text.rlike(r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2} [AP]M$"), _with_offset(wall, _offset(wall, _noon(wall), tz)))


def export_window(c: str | Column, on: str | Column) -> Column:
    """Struct of start and end of an exported event: one hour from its time, noon if that is unreadable, the whole day if it has none."""
    hour, minute = _clock(F.coalesce(col(c), F.lit("")))
    all_day = F.coalesce(col(c), F.lit("")).rlike(r"(?i)all\s*day")
    midnight = col(on).cast("timestamp_ntz")
    start = midnight + F.make_dt_interval(F.lit(0), F.coalesce(hour, F.lit(12)), F.when(hour.isNull(), 0).otherwise(minute), F.lit(0))
    return F.struct(
        all_day.alias("all_day"),
        F.when(all_day, midnight).otherwise(start).alias("start"),
        F.when(all_day, midnight + F.expr("INTERVAL 1 DAY")).otherwise(start + F.expr("INTERVAL 1 HOUR")).alias("end"),
    )


def is_contiguous(dates: str | Column) -> Column:
    """Whether distinct sorted dates follow each other day by day."""
    d = col(dates)
    return F.size(d) == F.datediff(F.element_at(d, -1), F.element_at(d, 1)) + 1


def in_window(dates: str | Column, today: date | str | Column, days: int = 6) -> Column:
    """Number of dates from today to so many days ahead."""
    t = day(today)
    return F.size(F.filter(col(dates), lambda d: d.between(t, F.date_add(t, days))))


def run_shape(on: str | Column, end: str | Column, dates: str | Column, today: date | str | Column) -> Column:
    """Struct of an occurrence set: single, continuous or gappy; ongoing or not; first and last day; days in the coming week."""
    t, d = day(today), col(dates)
    many = F.coalesce(F.size(d), F.lit(0)) > 1
    last = F.when(many, F.coalesce(col(end), F.element_at(d, -1))).otherwise(col(on))
    return F.struct(
        F.when(~many, "single").when(is_contiguous(d), "continuous").otherwise("gappy").alias("shape"),
        (col(on).__le__(t) & (last >= t)).alias("ongoing"),
        col(on).alias("first"),
        last.alias("last"),
        F.when(many, in_window(d, today)).otherwise(col(on).between(t, F.date_add(t, 6)).cast("int")).alias("coming"),
    )


def age_hours(last: str | Column, now: str | Column) -> Column:
    """Hours from one timestamp to another, to a tenth; null if negative or unknown."""
    hours = F.timestamp_diff("SECOND", col(last), col(now)) / 3600
    return F.when(hours >= 0, F.floor(hours * 10 + 0.5) / 10)
