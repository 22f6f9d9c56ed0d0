"""Dates in listings, crawl schedules and back-off as Catalyst expressions."""

from __future__ import annotations

import datetime as dt
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

#: Schedules that are off, and named ones in seconds.
DISABLED = ("disabled", "none", "null")
NAMED = {"hourly": 3600, "daily": 86400, "weekly": 604800, "monthly": 2592000}
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def parse_date(text: Column) -> Column:
    """The first date in a text at midnight: YYYY-M-D with . / - and blanks, else YY.M.D; an impossible date is null."""
    # The forms that count as dates.
    long, short = r"(\d{4})\s*[./-]\s*(\d{1,2})\s*[./-]\s*(\d{1,2})", r"\b(\d{2})[./-](\d{1,2})[./-](\d{1,2})\b"
    part = lambda p, i: F.regexp_extract(text, p, i).cast("int")

    def at(p: str, base: int) -> Column:
        day = F.concat_ws("-", F.lpad((F.lit(base) + part(p, 1)).cast("string"), 4, "0"), F.lpad(part(p, 2).cast("string"), 2, "0"), F.lpad(part(p, 3).cast("string"), 2, "0"))
        return F.try_to_date(day, "yyyy-MM-dd").cast("timestamp")

    return F.when(text.rlike(long), at(long, 0)).when(text.rlike(short), at(short, 2000))


def schedule_seconds(schedule: Column) -> Column:
    """Seconds between runs: a named schedule, N with a unit, or plain seconds; null for off, cron and invalid ones."""
    s = F.lower(F.trim(schedule))
    out = F.lit(None).cast("bigint")
    for name, seconds in NAMED.items():
        out = F.when(s == name, F.lit(seconds).cast("bigint")).otherwise(out)
    form = r"^(\d{1,12})(?:\s*([smhd]))?$"
    number, unit = F.regexp_extract(s, form, 1).try_cast("bigint"), F.regexp_extract(s, form, 2)
    scale = F.lit(1)
    for name, seconds in UNITS.items():
        scale = F.when(unit == name, seconds).otherwise(scale)
    return F.when(s.rlike(form), number * scale).otherwise(out)


def schedule_kind(schedule: Column) -> Column:
    """disabled, interval, cron (any five fields) or invalid; null and blank are disabled."""
    s = F.lower(F.trim(F.coalesce(schedule, F.lit(""))))
    cron = s.rlike(r"^\S+(?:\s+\S+){4}$")
    return F.when((s == "") | s.isin(*DISABLED), "disabled").when(schedule_seconds(s).isNotNull(), "interval").when(cron, "cron").otherwise("invalid")


def cron_field_matches(field: Column, value: Column) -> Column:
    """Whether a value meets a cron field: *, */N (value divisible by N), lists, ranges and numbers; malformed ones do not."""

    def part(p: Column) -> Column:
        every = F.regexp_extract(p, r"^\*/(\d{1,9})$", 1).try_cast("int")
        low, high = (F.regexp_extract(p, r"^(\d{1,9})-(\d{1,9})$", i).try_cast("int") for i in (1, 2))
        return (
            F.when(p == "*", True).when(p.rlike(r"^\*/\d{1,9}$"), (every > 0) & (F.try_mod(value, every) == 0))
            .when(p.rlike(r"^\d{1,9}-\d{1,9}$"), value.between(low, high)).when(p.rlike(r"^\d{1,9}$"), p.try_cast("int") == value).otherwise(False)
        )

    return F.coalesce(F.exists(F.split(field, ","), lambda p: F.coalesce(part(p), F.lit(False))), F.lit(False))


def cron_matches(schedule: Column, at: Column) -> Column:
    """Whether a minute meets a five-field cron schedule; day and weekday are alternatives where both are restricted; Sunday is 0 or 7."""
    f = F.split(F.trim(schedule), r"\s+")
    field = lambda i: F.get(f, F.lit(i))
    weekday = F.dayofweek(at) - 1
    day = cron_field_matches(field(2), F.dayofmonth(at))
    dow = cron_field_matches(field(4), weekday) | (weekday == 0) & cron_field_matches(field(4), F.lit(7))
    days = F.when((field(2) != "*") & (field(4) != "*"), day | dow).otherwise(day & dow)
    return (F.size(f) == 5) & cron_field_matches(field(0), F.minute(at)) & cron_field_matches(field(1), F.hour(at)) & cron_field_matches(field(3), F.month(at)) & days


def backoff_seconds(failures: Column) -> Column:
    """60 s doubled per failure in a row, to the tenth; a day at most."""
    return F.least(F.lit(86400), F.lit(60) * F.pow(F.lit(2), F.least(F.greatest(failures, F.lit(1)), F.lit(10)) - 1)).cast("bigint")


#: Minutes that are looked through for a cron schedule's next run, and what is waited if there is none.
CRON_MINUTES, CRON_REST = 525_600, 86_400


def _fields(schedule: str) -> tuple[list[set[int]], bool, bool] | None:
    """The values that meet each of the five fields, and whether day and weekday are restricted."""
    parts = schedule.split()
    if len(parts) != 5:
        return None
    ranges = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))

    def values(field: str, low: int, high: int) -> set[int]:
        out: set[int] = set()
        for part in field.split(","):
            whole = range(low, high + 1)
            if part == "*":
                out |= set(whole)
            elif m := re.fullmatch(r"\*/(\d+)", part):
                out |= {v for v in whole if int(m[1]) and v % int(m[1]) == 0}
            elif m := re.fullmatch(r"(\d+)-(\d+)", part):
                out |= {v for v in whole if int(m[1]) <= v <= int(m[2])}
            elif part.isdigit():
                out |= {v for v in whole if v == int(part)}
        return out

    sets = [values(f, *r) for f, r in zip(parts, ranges, strict=True)]
    # 7 is Sunday too, but no step falls on it.
    sets[4] = values(parts[4], 0, 6) | ({0} if 7 in values(re.sub(r"\*/\d+|\*", "", parts[4]), 0, 7) else set())
    return sets, parts[2] != "*", parts[4] != "*"


def next_tick(schedule: str, after: dt.datetime) -> dt.datetime:
    """The first minute after `after` that meets a cron schedule, day by day; a day later if none does within a year."""
    told = _fields(schedule)
    start = after.replace(second=0, microsecond=0) + dt.timedelta(minutes=1)
    end = start + dt.timedelta(minutes=CRON_MINUTES)
    if told:
        (minutes, hours, days, months, weekdays), by_day, by_weekday = told
        times = sorted(dt.time(h, m) for h in hours for m in minutes)
        day = start.date()
        while times and day <= end.date():
            on_day, on_weekday = day.day in days, (day.weekday() + 1) % 7 in weekdays
            if day.month in months and (on_day or on_weekday if by_day and by_weekday else on_day and on_weekday):
                for t in times:
                    at = dt.datetime.combine(day, t, after.tzinfo)
                    if start <= at < end:
                        return at
            day += dt.timedelta(days=1)
    return after + dt.timedelta(seconds=CRON_REST)


@arrow_udf(T.LongType())
def _next_ticks(seconds: pa.Array, schedules: pa.Array) -> pa.Array:
    out = []
    for second, schedule in zip(seconds.to_pylist(), schedules.to_pylist(), strict=True):
        if second is None or schedule is None:
            out.append(None)
        else:
            out.append(int(next_tick(schedule, dt.datetime.fromtimestamp(second, dt.UTC)).timestamp()))
    return pa.array(out, pa.int64())


def next_run(last: Column, schedule: Column) -> Column:
    """The next run after `last`: of an interval schedule so much later, of a cron schedule its next minute (UTC); else null."""
    base, kind = F.unix_timestamp(last), schedule_kind(schedule)
    later = F.when(kind == "interval", base + schedule_seconds(schedule)).when(kind == "cron", _next_ticks(F.when(kind == "cron", base), schedule))
    return F.timestamp_seconds(later)


def retry_seconds(kind: str, attempt: Column, backoff: float = 1.0) -> Column:
    """The wait after a failed try (from 0): doubling for fetches and drafts of specs, one second more each time for a model."""
    return (attempt + 1).cast("double") if kind == "model" else F.lit(float(backoff)) * F.pow(F.lit(2.0), attempt)


def crawl_delay(setting: Column, declared: Column) -> Column:
    """The longer of the set and the declared wait between requests."""
    return F.greatest(setting, F.coalesce(declared, setting))
