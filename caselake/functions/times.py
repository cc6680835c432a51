"""Times read from names and tags, as naive or Unix seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DATE = r"(20\d{2})[_.\-]?(0[1-9]|1[0-2])[_.\-]?(0[1-9]|[12]\d|3[01])"
_SOLID = r"(20\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])"
_HOUR, _60 = r"([01]\d|2[0-3])", r"([0-5]\d)"
#: The name patterns in their order; the first that fits anywhere wins, and then its leftmost place.
PATTERNS = (
    rf"(?i){_DATE}[ T_\-]+{_HOUR}h{_60}m{_60}s",
    rf"{_DATE}[ T_\-]+{_HOUR}[:_.\-]?{_60}[:_.\-]?{_60}",
    rf"{_SOLID}[ T_\-]+{_HOUR}{_60}{_60}",
    rf"{_DATE}(?!\d)",
)


def civil_days(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970-01-01 in the Gregorian calendar; a day past its month's end runs on into the next."""
    first = F.make_date(year, month, F.lit(1))
    return F.unix_date(first) + day - 1


def recording_time(*names: Column) -> Column:
    """struct(secs_naive, text, date, has_time) of the first name that holds a time; null if none does.

    The seconds are wall-clock ones, good for differences only. With a date alone has_time is
    false. Days are not checked against the month.
    """
    return F.coalesce(*[_from_name(n) for n in names])


def _from_name(name: Column) -> Column:
    out = None
    for at, pattern in enumerate(PATTERNS):
        g = [F.regexp_extract(name, pattern, k) for k in range(1, 7 if at < 3 else 4)]
        date = F.concat_ws("-", *g[:3])
        days = civil_days(*[x.cast("int") for x in g[:3]]).cast("long")
        if at < 3:
            h, m, s = (x.cast("long") for x in g[3:])
            value = F.struct((days * 86400 + h * 3600 + m * 60 + s).alias("secs_naive"), F.concat(date, F.lit(" "), F.concat_ws(":", *g[3:])).alias("text"), date.alias("date"), F.lit(True).alias("has_time"))
        else:
            value = F.struct((days * 86400).alias("secs_naive"), date.alias("text"), date.alias("date"), F.lit(False).alias("has_time"))
        found = F.when(name.rlike(pattern), value)
        out = found if out is None else F.coalesce(out, found)
    return out


def creation_time(text: Column) -> Column:
    """struct(unix, tz_assumed) of YYYY-MM-DD[T ]HH:MM:SS[.frac][Z or offset]; null if it is none.

    Days past the month's end, second 60 and times before 1970 are refused. Without a zone
    UTC is assumed, and tz_assumed tells so.
    """
    pattern = r"^(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2}):(\d{2}):(\d{2})(?:\.\d*)?)?(?:(Z).*|([+-])(\D*\d\D*\d.*))?$"
    t = F.trim(text)
    g = [F.regexp_extract(t, pattern, k) for k in range(1, 10)]
    number = lambda c: F.coalesce(c.try_cast("long"), F.lit(0))
    y, mo, d, h, mi, s = (number(x) for x in g[:6])
    month_days = F.when(mo == 2, F.when(((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0), 29).otherwise(28)).when(mo.isin(4, 6, 9, 11), 30).otherwise(31)
    ok = t.rlike(pattern) & mo.between(1, 12) & d.between(1, month_days) & (h <= 23) & (mi <= 59) & (s <= 59)
    digits = F.regexp_replace(g[8], r"\D", "")
    minutes = F.when(F.length(digits) >= 4, number(F.substring(digits, 3, 2))).otherwise(0)
    offset = (number(F.substring(digits, 1, 2)) * 3600 + minutes * 60) * F.when(g[7] == "-", -1).otherwise(1)
    days = F.unix_date(F.make_date(F.greatest(y, F.lit(1)).cast("int"), F.when(ok, mo).otherwise(1).cast("int"), F.lit(1))) + d - 1
    unix = days.cast("long") * 86400 + h * 3600 + mi * 60 + s - F.when(g[7] != "", offset).otherwise(0)
    return F.when(ok & (unix >= 0), F.struct(unix.alias("unix"), ((g[6] == "") & (g[7] == "")).alias("tz_assumed")))


def day_of(unix: Column) -> Column:
    """YYYY-MM-DD of Unix seconds in UTC, without the session's zone."""
    return F.date_format(F.date_from_unix_date(F.floor(unix / 86400).cast("int")), "yyyy-MM-dd")


def packed_date(value: Column) -> Column:
    """Naive seconds of a packed 32-bit recorder date (6 bits year from 2000, 4 month, 5 day, 5 hour, 6 minute, 6 second); null if it is no date."""
    part = lambda shift, bits: F.shiftright(value, shift).bitwiseAND((1 << bits) - 1)
    s, mi, h, d, mo, y = part(0, 6), part(6, 6), part(12, 5), part(17, 5), part(22, 4), part(26, 6) + 2000
    month_days = F.when(mo == 2, F.when(y % 4 == 0, 29).otherwise(28)).when(mo.isin(4, 6, 9, 11), 30).otherwise(31)
    ok = mo.between(1, 12) & d.between(1, month_days) & (h < 24) & (mi < 60) & (s < 60)
    days = F.unix_date(F.make_date(y.cast("int"), F.when(ok, mo).otherwise(1).cast("int"), F.lit(1))) + d - 1
    return F.when(ok, days.cast("long") * 86400 + h * 3600 + mi * 60 + s)
