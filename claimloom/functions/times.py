"""Times as texts: parsed, compared, and brought to a day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ISO texts that are read as moments; those without offset are in UTC.
_ISO = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?))?(Z|[+-]\d{2}:?\d{2})?$"
# English months as claims abbreviate them.
_MONTHS = {m: i + 1 for i, names in enumerate("jan january,feb february,mar march,apr april,may,jun june,jul july,aug august,sep sept september,oct october,nov november,dec december".split(",")) for m in names.split()}


#: The other forms of ISO 8601: basic and week dates, any sign between date and time, times cut short, longer fractions.
_WIDER = r"^(?:(\d{4})-?(\d{2})-?(\d{2})|(\d{4})-?W(\d{2})(?:-?([1-7]))?)(?:[^\d](\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?(Z|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?)?)?$"


def plain_moment(c: Column) -> Column:
    """The moment that a text states in the extended form, as views read it; null where it states none."""
    t = F.trim(c)
    zone = F.regexp_replace(F.regexp_extract(t, _ISO, 3), r"^([+-]\d{2}):?(\d{2})$", "$1:$2")
    clock = F.coalesce(F.nullif(F.regexp_extract(t, _ISO, 2), F.lit("")), F.lit("00:00"))
    full = F.concat(F.regexp_extract(t, _ISO, 1), F.lit(" "), clock, F.when(F.length(clock) == 5, ":00").otherwise(""), F.when(zone.isin("", "Z"), "+00:00").otherwise(zone))
    return F.when(t.rlike(_ISO), full.try_cast("timestamp"))


def moment(c: Column) -> Column:
    """The moment that an ISO text states in any of its forms, null where it states none."""
    t = F.trim(c)
    return F.when(t.rlike(_ISO), plain_moment(t)).when(t.rlike(_WIDER), _wider(t))


def _wider(t: Column) -> Column:
    part = lambda i: F.nullif(F.regexp_extract(t, _WIDER, i), F.lit(""))
    two = lambda i: F.coalesce(part(i), F.lit("00"))
    # Week 1 is that of 4 January; a week that the year doesn't have would lie in another one.
    monday = F.date_trunc("week", F.concat(part(4), F.lit("-01-04")).try_cast("date")).cast("date")
    day = F.date_add(monday, (part(5).cast("int") - 1) * 7 + F.coalesce(part(6), F.lit("1")).cast("int") - 1)
    in_week = F.when((part(5) != "00") & (F.extract(F.lit("YEAROFWEEK"), day) == part(4).cast("int")), F.date_format(day, "yyyy-MM-dd"))
    date = F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3))
    zone = F.regexp_replace(F.when(F.coalesce(part(11), F.lit("Z")) == "Z", "+00").otherwise(part(11)), ":", "")
    offset = F.concat(F.left(zone, F.lit(3)), F.lit(":"), F.rpad(F.substring(zone, 4, 2), 2, "0"), F.when(F.length(zone) > 5, F.concat(F.lit(":"), F.substring(zone, 6, 2))).otherwise(""))
    return F.concat(F.coalesce(in_week, date), F.lit(" "), two(7), F.lit(":"), two(8), F.lit(":"), two(9), F.lit("."), F.left(F.concat(F.coalesce(part(10), F.lit("")), F.lit("000000")), F.lit(6)), offset).try_cast("timestamp")


def now_utc() -> Column:
    """The time of the query as ISO text in UTC, in whole seconds. Runs that must be repeatable pass a time instead."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_utc(c: Column) -> Column:
    """A moment as ISO text in UTC with ``Z``, with a fraction only where it has one."""
    utc = F.to_utc_timestamp(c, F.current_timezone())
    digits = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(digits, r"\.000000$", ""), F.lit("Z"))


def order_key(c: Column) -> Column:
    """Sorts texts in time; those that aren't times come first, by text."""
    m = moment(c)
    return F.struct(m.isNotNull().alias("is_time"), m.alias("at"), F.when(m.isNull(), c).alias("text"))


def claim_day(reported: Column, first_seen: Column) -> Column:
    """The day a view sorts by: the reported one, else the first sighting's, else the first of 1970."""

    def day(c: Column) -> Column:
        t = F.trim(c)
        a, b = r"(?i)^(\d{1,2})\s+([a-z]+)[,.]?\s+(\d{4})$", r"(?i)^([a-z]+)\s+(\d{1,2}),?\s+(\d{4})$"
        table = F.create_map(*[F.lit(x) for kv in _MONTHS.items() for x in kv])
        named = lambda p, d, m: F.to_date(F.try_make_timestamp_ntz(F.regexp_extract(t, p, 3).try_cast("int"), F.try_element_at(table, F.lower(F.regexp_extract(t, p, m))), F.regexp_extract(t, p, d).try_cast("int"), F.lit(0), F.lit(0), F.lit(0)))
        return F.when(t.rlike(a), named(a, 1, 2)).when(t.rlike(b), named(b, 2, 1)).otherwise(F.to_date(F.to_utc_timestamp(plain_moment(t), F.current_timezone())))

    return F.coalesce(day(reported), day(first_seen), F.lit("1970-01-01").cast("date"))
