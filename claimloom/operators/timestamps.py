"""Mixed timestamp notations to one UTC form.

An ordered cascade of anchored patterns rewrites each text into one record of fields (kind, the date's three numbers, hour,
minute, second, fraction, am/pm, zone text); the first pattern that matches the whole text decides. What follows is strict:
every field is range-checked by ``try_make_timestamp_ntz``, so an impossible date gives null rather than a rolled-over one.
All of it is built-in expressions, evaluated inside the JVM.

Zones: a written offset wins over a zone name, that over an abbreviation, that over the source's default from the lookup
table, that over UTC. Local times that occur twice mean the first; those that the clocks skip are read with the offset before
the change. Both are what ``convert_timezone`` does for local times, independent of the session's zone.
"""

from __future__ import annotations

import zoneinfo
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.session import bind

# Month names (English, Spanish, French, German, Italian, Portuguese, Dutch), by number.
MONTHS = {
    1: "january jan enero ene janvier janv januar jän jänner gennaio gen janeiro januari",
    2: "february feb febrero février févr fevrier fév februar febbraio fevereiro fev februari",
    3: "march mar marzo mars märz maerz mrz março marco maart mrt",
    4: "april apr abril abr avril avr aprile",
    5: "may mayo mai maggio mag maio mei",
    6: "june jun junio juin juni giugno giu junho",
    7: "july jul julio juillet juil juli luglio lug julho",
    8: "august aug agosto ago août aout augustus",
    9: "september sept sep septiembre setiembre septembre settembre set setembro",
    10: "october oct octubre octobre oktober okt ottobre ott outubro out",
    11: "november nov noviembre novembre novembro",
    12: "december dec diciembre dic décembre decembre déc dezember dez dicembre dezembro",
}
# Zone abbreviations and their minutes east of UTC. IST and CST mean India and US Central.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120,
    "sast": 120, "eet": 120, "eest": 180, "msk": 180, "trt": 180, "gst": 240, "pkt": 300, "ist": 330, "npt": 345, "wib": 420,
    "hkt": 480, "sgt": 480, "awst": 480, "jst": 540, "kst": 540, "acst": 570, "aest": 600, "acdt": 630, "lhst": 630,
    "lhdt": 660, "aedt": 660, "nzst": 720, "nzdt": 780, "nst": -210, "ndt": -150, "ast": -240, "adt": -180, "brt": -180,
    "art": -180, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
    "akst": -540, "akdt": -480, "hst": -600,
}

# The parts that the patterns share. TAIL captures hour, minute, second, fraction, am/pm, zone text; all may be absent.
_TAIL = r"(?:(?:\s*t\s*|\s*,?\s+(?:at\s+|um\s+|à\s+|a las\s+)?)(\d{1,2})[:h](\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?:\s*([ap])\.?m\b\.?)?(?:\s*(\S.*))?)?$"
_DAY = r"(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?\.?,?\s+)?"
_WORD = r"(\p{L}+)"
_LABEL = r"^\s*(?:(?:posted|published|updated|added|reported|discovered|date|first seen|seen)(?:\s+on)?\s*:?\s*)?"

#: name, pattern, record. Groups of TAIL follow those of the date.
CASCADE: list[tuple[str, str, str]] = [
    ("iso date", rf"(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}}){_TAIL}", "ymd|$1|$3|$4|$5|$6|$7|$8|$9|$10"),
    ("compact", r"(\d{4})(\d{2})(\d{2})(?:t?(\d{2})(\d{2})(\d{2})?(?:[.,](\d{1,9}))?\s*()(z|[+-]\d{2}:?\d{2})?)?$", "ymd|$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    ("epoch seconds", r"(\d{10})(?:\.(\d{1,9}))?$", "epoch|$1||||||$2||"),
    ("epoch milliseconds", r"(\d{10})(\d{3})$", "epoch|$1||||||$2||"),
    ("epoch microseconds", r"(\d{10})(\d{6})$", "epoch|$1||||||$2||"),
    ("epoch nanoseconds", r"(\d{10})(\d{9})$", "epoch|$1||||||$2||"),
    ("iso week", rf"(\d{{4}})-?w(\d{{2}})-?([1-7]){_TAIL}", "week|$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    ("ordinal", rf"(\d{{4}})-(\d{{3}}){_TAIL}", "ord|$1|1|$2|$3|$4|$5|$6|$7|$8"),
    ("numbers", rf"(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}}|\d{{2}}){_TAIL}", "num|$1|$3|$4|$5|$6|$7|$8|$9|$10"),
    ("day month year", rf"{_DAY}(\d{{1,2}})(?:\.|st|nd|rd|th|er|º|ª)?(?:[\s-]+|\s*\.\s*)(?:de\s+|of\s+)?{_WORD}\.?,?(?:[\s-]+)(?:de\s+|del\s+)?(\d{{4}}){_TAIL}", "ymd|$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    ("month day year", rf"{_DAY}{_WORD}\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}}){_TAIL}", "ymd|$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    ("ctime", rf"{_DAY}{_WORD}\s+(\d{{1,2}})\s+(\d{{1,2}}):(\d{{2}}):(\d{{2}})()()\s*((?:[a-z]{{1,5}}|[+-]\d{{2}}:?\d{{2}})?)\s*(\d{{4}})$", "ymd|$9|$1|$2|$3|$4|$5|$6|$7|$8"),
]


def _lookup(table: dict, key: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.try_element_at(m, key)


def _int(c: Column) -> Column:
    return c.try_cast("int")


def known_zones() -> list[str]:
    """Region names of the public time zone database, each of which the JVM knows too."""
    return sorted(z for z in zoneinfo.available_timezones() if "/" in z and not z.startswith(("posix/", "right/", "SystemV/"))) + ["UTC", "GMT"]


def with_moments(df: DataFrame, text: str, tz_name: str, date_order: str, out: str = "utc_value") -> DataFrame:
    """``df`` with ``out``: what ``text`` states, as ``YYYY-MM-DDTHH:MM:SS.ffffffZ``, or ``YYYY-MM-DD`` where it has no time of day.

    ``tz_name`` and ``date_order`` (``dmy``, ``mdy`` or ``ymd``) are columns with the source's conventions, null where it has
    none: zoneless times are then UTC, and dates in numbers only that don't start with a four-digit year are undecidable.
    Null, empty, unreadable, relative and impossible texts give null. Rows, repeats included, and other columns stay as they
    are; helper columns never clash with them.
    """
    taken = set(df.columns)

    def name(k: str) -> str:
        n = f"__{out}_{k}"
        while n in taken:
            n += "_"
        return n

    raw, rec, part, local, off, zone = (name(k) for k in ("raw", "rec", "part", "local", "off", "zone"))
    t = F.col(raw)
    found = reduce(lambda acc, p: acc.when(t.rlike("(?i)^" + p[1]), F.regexp_replace(t, "(?i)^" + p[1], p[2])), CASCADE, F.when(t.isNull() | (t == ""), F.lit(None)))
    df = bind(df, raw, F.regexp_replace(F.regexp_replace(F.col(text), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), f"(?i){_LABEL}", ""))
    df = bind(df, rec, F.split(found, r"\|", 10))
    p = lambda i: F.get(F.col(rec), F.lit(i))
    kind, order = p(0), F.lower(F.trim(F.col(date_order)))
    names = {n: k for k, v in MONTHS.items() for n in v.split()}
    year4 = lambda c: F.when(F.length(c) == 4, _int(c)).when(F.length(c) == 2, _int(c) + F.when(_int(c) < 70, 2000).otherwise(1900))
    num = lambda y, m, d: F.struct(year4(y).alias("y"), _int(m).alias("m"), _int(d).alias("d"))
    parts = (
        F.when(kind == "ymd", F.struct(year4(p(1)).alias("y"), F.coalesce(_int(p(2)), _lookup(names, F.lower(p(2)))).alias("m"), _int(p(3)).alias("d")))
        .when((kind == "num") & (order == "dmy"), num(p(3), p(2), p(1)))
        .when((kind == "num") & (order == "mdy"), num(p(3), p(1), p(2)))
        .when((kind == "num") & (order == "ymd") & (F.length(p(3)) == 2) & (F.length(p(1)) == 2), num(p(1), p(2), p(3)))
        .when(kind == "ord", F.struct(_int(p(1)).alias("y"), F.lit(1).alias("m"), F.lit(1).alias("d")))
        .when(kind == "week", F.struct(_int(p(1)).alias("y"), F.lit(1).alias("m"), F.lit(4).alias("d")))
    )
    df = bind(df, part, parts)
    q = F.col(part)
    has_time = F.coalesce(p(4), F.lit("")) != ""
    clock12 = F.coalesce(p(8), F.lit("")) != ""
    h = _int(p(4))
    hour = F.when(~clock12, h).when(h.between(1, 12), h % 12 + F.when(F.lower(p(8)) == "p", 12).otherwise(0))
    micros = F.rpad(F.substring(F.coalesce(p(7), F.lit("")), 1, 6), 6, "0")
    second = F.concat(F.when(p(6) == "", F.lit("0")).otherwise(p(6)), F.lit("."), micros).try_cast("decimal(8,6)")
    in_range = hour.between(0, 23) & (_int(p(5)) < 60) & (second < 60)
    at = lambda hh, mm, ss: F.try_make_timestamp_ntz(q["y"], q["m"], q["d"], hh, mm, ss)
    start = F.when(has_time & in_range, at(hour, _int(p(5)), second)).when(~has_time, at(F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)")))
    # Day of the year and of the week, each checked by going back from the moment to the number.
    doy = _int(p(3)) - 1
    by_day = F.timestamp_add("DAY", doy, start)
    week = (_int(p(2)) - 1) * 7 + (_int(p(3)) - 1) - F.weekday(start)
    by_week = F.timestamp_add("DAY", week, start)
    df = bind(
        df,
        local,
        F.when(kind == "ord", F.when((doy >= 0) & (F.year(by_day) == q["y"]), by_day))
        .when(kind == "week", F.when((F.weekofyear(by_week) == _int(p(2))), by_week))
        .when(kind == "epoch", F.lit(None).cast("timestamp_ntz"))
        .otherwise(start),
    )
    zt = F.trim(F.coalesce(p(9), F.lit("")))
    sign = F.regexp_extract(zt, r"(?i)^\(?(?:utc|gmt|[a-z]{2,5})?\s*([+-])(\d{2}):?(\d{2})\)?\s*(?:\[[\w/+-]+\]|\([a-z ]+\))?$", 1)
    hours, minutes = (_int(F.regexp_extract(zt, r"([+-])(\d{2}):?(\d{2})", i)) for i in (2, 3))
    region = F.regexp_extract(zt, r"^[\[(]?([A-Za-z_]+(?:/[A-Za-z0-9_+-]+)*)[\])]?$", 1)
    zones = known_zones()
    tz = F.trim(F.col(tz_name))
    df = bind(df, off, F.when((sign != "") & (hours <= 18) & (minutes < 60), (hours * 60 + minutes) * F.when(sign == "-", -1).otherwise(1)).when(sign == "", _lookup(ABBREVIATIONS, F.lower(region))))
    df = bind(df, zone, F.when(F.col(off).isNotNull(), F.lit(None)).when(zt == "", F.when(tz.isin(zones), tz).otherwise("UTC")).when(region.isin(zones), region))
    utc = F.when(F.col(off).isNotNull(), F.timestamp_add("MINUTE", -F.col(off), F.col(local))).when(F.col(zone).isNotNull(), F.convert_timezone(F.col(zone), F.lit("UTC"), F.col(local)))
    epoch = F.timestamp_add("MICROSECOND", p(1).try_cast("bigint") * 1000000 + _int(micros), F.lit("1970-01-01").cast("timestamp_ntz"))

    def iso(moment: Column) -> Column:
        digits = moment.cast("string")
        return F.concat(F.substring(digits, 1, 10), F.lit("T"), F.substring(digits, 12, 8), F.lit("."), F.rpad(F.substring(digits, 21, 6), 6, "0"), F.lit("Z"))

    value = F.when(kind == "epoch", iso(epoch)).when(F.col(local).isNull(), F.lit(None)).when(has_time, iso(utc)).otherwise(F.substring(F.col(local).cast("string"), 1, 10))
    return bind(df, out, value).drop(raw, rec, part, local, off, zone)


def conventions(df: DataFrame) -> DataFrame:
    """One row per source: ``__sid``, ``__tz``, ``__order``, ``__mark``, ``__unit``. Of repeated sources the smallest row counts."""
    return (
        df.where(F.col("source_id").isNotNull())
        .groupBy(F.lower(F.trim("source_id")).alias("__sid"))
        .agg(F.min(F.struct("tz_name", "date_order", "decimal_mark", "bare_size_unit")).alias("__c"))
        .select("__sid", F.col("__c.tz_name").alias("__tz"), F.col("__c.date_order").alias("__order"), F.col("__c.decimal_mark").alias("__mark"), F.col("__c.bare_size_unit").alias("__unit"))
    )


def normalize_fields(rows: DataFrame, source_conventions: DataFrame, fields: tuple[str, ...], key: str = "id", source: str = "source_id") -> DataFrame:
    """(key, field_name, utc_value) of every row and field of ``fields`` that states a real day or moment.

    Null keys stay null keys; null sources, and those without conventions, use UTC. The conventions are joined without a
    hint: Spark broadcasts them where their size, known from the files, is under its threshold, and sorts and merges with
    AQE's skew handling beyond it. An empty input gives an empty result with the same schema.
    """
    entries = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("t")) for f in fields]))
    long = rows.select(F.col(key).alias("__key"), F.lower(F.trim(F.col(source))).alias("__src"), entries.alias("__e")).select("__key", "__src", F.col("__e.f").alias("field_name"), F.col("__e.t").alias("__t")).where(F.length(F.trim("__t")) > 0)
    joined = long.join(conventions(source_conventions), F.col("__src") == F.col("__sid"), "left")
    out = with_moments(joined, "__t", "__tz", "__order")
    return out.where(F.col("utc_value").isNotNull()).select(F.col("__key").alias(key), "field_name", "utc_value")
