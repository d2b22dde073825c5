"""Date and time verbs.  Inside, dates are DateType and times TimestampType in UTC; ISO
text is made only where the verb's result is text.  Text arguments may be ISO dates or
timestamps; what doesn't parse gives null."""

from __future__ import annotations

from datetime import date, datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import col, value_of, verb
from .scalar import text

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss"


def as_time(x) -> Column:
    return F.try_to_timestamp(col(x).cast("string"))


def as_date(x) -> Column:
    return F.to_date(as_time(x))


def only_date(x) -> Column:
    """A date or date-only text; a timestamp gives null."""
    s = col(x).cast("string")
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(s, "yyyy-MM-dd"))


def spark_pattern(pattern: str) -> str:
    """Tokens YYYY YY MM DD HH mm ss; other letters are literal."""
    out, i = "", 0
    tokens = {"YYYY": "yyyy", "yyyy": "yyyy", "YY": "yy", "MM": "MM", "DD": "dd", "dd": "dd", "HH": "HH", "mm": "mm", "ss": "ss"}
    while i < len(pattern):
        for t in sorted(tokens, key=len, reverse=True):
            if pattern.startswith(t, i):
                out += tokens[t]
                i += len(t)
                break
        else:
            ch = pattern[i]
            out += f"'{ch}'" if ch.isalpha() else "''" if ch == "'" else ch
            i += 1
    return out


@verb("today")
def today():
    return F.current_date()


@verb("now")
def now():
    return F.date_format(F.current_timestamp(), ISO)


@verb("formatDate")
def format_date(d, pattern):
    return F.date_format(as_time(d), spark_pattern(value_of(pattern)))


@verb("parseDate")
def parse_date(s, pattern):
    return F.to_date(F.coalesce(F.try_to_timestamp(col(s), F.lit(spark_pattern(value_of(pattern)))), as_time(s)))


@verb("formatTime")
def format_time(t, pattern="HH:mm:ss"):
    s = F.regexp_replace(col(t).cast("string"), r"^T?(\d{2}:\d{2})", "1970-01-01T$1")
    return F.date_format(as_time(s), spark_pattern(value_of(pattern)))


@verb("formatTimestamp")
def format_timestamp(t, pattern=None):
    return F.date_format(as_time(t), ISO if pattern is None else spark_pattern(value_of(pattern)))


@verb("parseTimestamp")
def parse_timestamp(s, pattern):
    return F.date_format(F.coalesce(F.try_to_timestamp(col(s), F.lit(spark_pattern(value_of(pattern)))), as_time(s)), ISO_SECONDS)


@verb("addDays")
def add_days(d, n):
    return F.date_add(only_date(d), col(n).cast("int"))


@verb("addMonths")
def add_months(d, n):
    return F.add_months(only_date(d), col(n).cast("int"))


@verb("addYears")
def add_years(d, n):
    return F.add_months(only_date(d), (col(n) * 12).cast("int"))


@verb("dateDiff")
def date_diff(a, b, unit="days"):
    u = value_of(unit).lower().rstrip("s")
    a, b = only_date(a), only_date(b)
    if u == "day":
        return F.datediff(b, a)
    if u == "month":
        return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    if u == "year":
        return F.year(b) - F.year(a)
    return F.lit(None).cast("int")


def _plus(t, n, seconds: int) -> Column:
    return F.timestamp_micros(F.unix_micros(as_time(t)) + (col(n) * (seconds * 1_000_000)).cast("bigint"))


@verb("addHours")
def add_hours(t, n):
    return _plus(t, n, 3600)


@verb("addMinutes")
def add_minutes(t, n):
    return _plus(t, n, 60)


@verb("addSeconds")
def add_seconds(t, n):
    return _plus(t, n, 1)


@verb("startOfDay")
def start_of_day(d):
    return F.date_trunc("day", as_time(d))


@verb("endOfDay")
def end_of_day(d):
    return F.timestamp_micros(F.unix_micros(F.date_trunc("day", as_time(d))) + 86_399_999_000)


@verb("startOfMonth")
def start_of_month(d):
    return F.trunc(as_date(d), "month")


@verb("endOfMonth")
def end_of_month(d):
    return F.last_day(as_date(d))


@verb("startOfYear")
def start_of_year(d):
    return F.trunc(as_date(d), "year")


@verb("endOfYear")
def end_of_year(d):
    return F.make_date(F.year(as_date(d)), F.lit(12), F.lit(31))


@verb("dayOfWeek")
def day_of_week(d):
    return F.weekday(as_date(d)) + 1


@verb("weekOfYear")
def week_of_year(d):
    return F.weekofyear(as_date(d))


@verb("quarter")
def quarter(d):
    return F.quarter(as_date(d))


@verb("isLeapYear")
def is_leap_year(x):
    y = F.coalesce(F.when(text(x).rlike(r"^\d{1,4}$"), text(x).try_cast("int")), F.year(as_date(x)))
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


@verb("isBefore")
def is_before(a, b):
    return as_time(a) < as_time(b)


@verb("isAfter")
def is_after(a, b):
    return as_time(a) > as_time(b)


@verb("isBetween")
def is_between(t, lo, hi):
    return as_time(t).between(as_time(lo), as_time(hi))


@verb("toUnix")
def to_unix(t):
    return F.unix_seconds(as_time(t))


@verb("fromUnix")
def from_unix(s):
    return F.date_format(F.timestamp_seconds(col(s)), ISO)


@verb("daysBetweenDates")
def days_between_dates(a, b):
    return F.datediff(as_date(b), as_date(a))


@verb("ageFromDate")
def age_from_date(dob, as_of=None):
    d, n = as_date(dob), F.current_date() if as_of is None else as_date(as_of)
    early = (F.month(n) < F.month(d)) | ((F.month(n) == F.month(d)) & (F.dayofmonth(n) < F.dayofmonth(d)))
    return F.when(n >= d, F.year(n) - F.year(d) - F.when(early, 1).otherwise(0))


@verb("isValidDate")
def is_valid_date(s, pattern=None):
    p = "yyyy-MM-dd" if pattern is None else spark_pattern(value_of(pattern))
    return F.coalesce(F.try_to_date(col(s).cast("string"), p).isNotNull(), F.lit(False))


#: Short and long patterns by locale.
LOCALE_DATES = {
    "en-US": ("M/d/yy", "MMMM d, yyyy"), "en-GB": ("dd/MM/yyyy", "d MMMM yyyy"), "de-DE": ("dd.MM.yy", "d. MMMM yyyy"),
    "fr-FR": ("dd/MM/yyyy", "d MMMM yyyy"), "es-ES": ("d/M/yy", "d 'de' MMMM 'de' yyyy"),
}
#: Month names.
MONTHS = {
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
}


@verb("formatLocaleDate")
def format_locale_date(d, locale="en-US", style="short"):
    loc, s = value_of(locale), value_of(style)
    short, long_ = LOCALE_DATES.get(loc, LOCALE_DATES["en-US"])
    if s not in ("short", "long"):
        return format_date(d, s)
    if s == "short" or loc[:2] not in MONTHS:
        return F.date_format(as_time(d), short if s == "short" else long_)
    name = F.element_at(F.array(*map(F.lit, MONTHS[loc[:2]].split())), F.month(as_date(d)))
    before, after = long_.split("MMMM")
    part = lambda p: F.date_format(as_time(d), p) if p.strip() else F.lit(p)
    return F.concat(part(before), name, part(after))


@verb("businessDays")
def business_days(d, n):
    """n weekdays on (or back), in closed form: whole weeks, then the rest."""
    d, n = as_date(d), col(n).cast("int")
    w = F.weekday(d)
    # a weekend start counts from the Friday before (forward) or the Monday after (back)
    fwd_start = F.when(w >= 5, F.date_sub(d, w - 4)).otherwise(d)
    back_start = F.when(w >= 5, F.date_add(d, 7 - w)).otherwise(d)
    fw, bw = F.least(w, F.lit(4)), F.when(w >= 5, 0).otherwise(w)
    m = F.abs(n)
    weeks, rest = F.floor(m / 5).cast("int"), (m % 5).cast("int")
    ahead = F.date_add(fwd_start, weeks * 7 + rest + F.when(fw + rest > 4, 2).otherwise(0))
    back = F.date_sub(back_start, weeks * 7 + rest + F.when(bw - rest < 0, 2).otherwise(0))
    return F.when(n == 0, d).when(n > 0, ahead).otherwise(back)


@verb("nextBusinessDay")
def next_business_day(d):
    d = as_date(d)
    w = F.weekday(d)
    return F.date_add(d, F.when(w == 4, 3).when(w == 5, 2).otherwise(1))


@verb("formatDuration")
def format_duration(x):
    """ISO-8601 durations or seconds as "1 day, 2 hours"."""
    s = text(x)
    iso = s.rlike("^P")
    part = lambda rx: F.coalesce(F.regexp_extract(s, rx, 1).try_cast("int"), F.lit(0))
    total = F.coalesce(s.try_cast("double"), F.lit(0.0)).cast("bigint")
    units = [
        ("year", part(r"^P[^T]*?(\d+)Y"), F.lit(0)), ("month", part(r"^P[^T]*?(\d+)M"), F.lit(0)), ("day", part(r"^P[^T]*?(\d+)D"), F.floor(total / 86400)),
        ("hour", part(r"T[^H]*?(\d+)H"), F.floor(total % 86400 / 3600)), ("minute", part(r"T.*?(\d+)M"), F.floor(total % 3600 / 60)), ("second", part(r"T.*?(\d+)(?:\.\d+)?S"), total % 60),
    ]
    said = []
    for name, a, b in units:
        n = F.when(iso, a).otherwise(b).cast("bigint")
        said.append(F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, "").otherwise("s"))))
    out = F.array_join(F.array_compact(F.array(*said)), ", ")
    return F.when(iso | s.try_cast("double").isNotNull(), F.when(out == "", "0 seconds").otherwise(out))
