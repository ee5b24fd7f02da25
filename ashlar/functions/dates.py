"""Date and time functions.  A TIME is a day-time interval, so that it may pass 24 hours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The dialect's date format letters and the patterns for them.
FORMATS = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%c": "M", "%d": "dd", "%e": "d", "%H": "HH", "%k": "H", "%h": "hh", "%I": "hh", "%l": "h",
    "%i": "mm", "%s": "ss", "%S": "ss", "%f": "SSSSSS", "%p": "a", "%M": "MMMM", "%b": "MMM", "%W": "EEEE", "%a": "EEE", "%j": "DDD",
    "%T": "HH:mm:ss", "%r": "hh:mm:ss a", "%%": "'%'",
}
LONGEST_TIME = 838 * 3600 + 59 * 60 + 59
YEAR_ZERO_DAYS = 366


def pattern(fmt: str, late: bool = False) -> str:
    """A format as a pattern; letters outside % marks are quoted.  ``late`` is for years past 9999, which Spark's yyyy gives a plus sign."""
    out, i, text = "", 0, ""
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            if text:
                out, text = out + "'" + text.replace("'", "''") + "'", ""
            out += "y" if late and fmt[i + 1] == "Y" else FORMATS.get(fmt[i : i + 2], fmt[i + 1])
            i += 2
        else:
            if fmt[i].isalpha() or fmt[i] == "'":
                text += fmt[i]
            else:
                if text:
                    out, text = out + "'" + text.replace("'", "''") + "'", ""
                out += fmt[i]
            i += 1
    return out + ("'" + text.replace("'", "''") + "'" if text else "")


def date_format(d: Column, fmt: str) -> Column:
    usual, late = pattern(fmt), pattern(fmt, late=True)
    text = F.date_format(d, usual)
    return text if usual == late else F.when(F.year(d.cast("timestamp")) > 9999, F.date_format(d, late)).otherwise(text)


def str_to_date(s: Column, fmt: str) -> Column:
    """NULL where the text doesn't fit."""
    return F.try_to_timestamp(s, F.lit(pattern(fmt)))


def to_days(d: Column) -> Column:
    return F.datediff(F.to_date(d), F.lit("0001-01-01").cast("date")) + YEAR_ZERO_DAYS


def from_days(n: Column) -> Column:
    return F.date_add(F.lit("0001-01-01").cast("date"), n.cast("int") - YEAR_ZERO_DAYS)


def dayname(d: Column) -> Column:
    return F.date_format(d, "EEEE")


def monthname(d: Column) -> Column:
    return F.date_format(d, "MMMM")


def date_add(d: Column, n: int, unit: str) -> Column:
    """d + INTERVAL n unit; NULL past the year 9999."""
    step = {"year": 12, "quarter": 3, "month": 1}.get(unit)
    if step:
        moved = d + F.make_ym_interval(F.lit(0), F.lit(n * step))
    else:
        seconds = {"week": 604800, "day": 86400, "hour": 3600, "minute": 60, "second": 1}[unit] * n
        moved = d.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))
    return F.when(F.year(moved) <= 9999, moved)


def date_sub(d: Column, n: int, unit: str) -> Column:
    return date_add(d, -n, unit)


def makedate(year: Column, day: Column) -> Column:
    return F.when(day > 0, F.date_add(F.make_date(year, F.lit(1), F.lit(1)), day.cast("int") - 1))


def maketime(h: Column, m: Column, s: Column) -> Column:
    return F.when(m.between(0, 59) & (s < 60) & (s >= 0), F.make_dt_interval(F.lit(0), h, m, s))


def sec_to_time(n: Column) -> Column:
    held = F.least(F.greatest(n.cast("long"), F.lit(-LONGEST_TIME)), F.lit(LONGEST_TIME))
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), held)


def text_to_sec(s: Column) -> Column:
    """Seconds of ``[d ]h:m[:s]`` or ``hhmmss`` digits, however many; NULL if minutes or seconds pass 59."""
    day = F.coalesce(F.regexp_extract(s, r"^\s*(\d+) +\d+", 1).try_cast("long"), F.lit(0))
    rest = F.regexp_replace(s, r"^\s*\d+ +", "")
    colon = rest.contains(":")
    h = F.when(colon, F.regexp_extract(rest, r"^(\d+):", 1).try_cast("long"))
    m = F.when(colon, F.regexp_extract(rest, r"^\d+:(\d+)", 1).try_cast("long"))
    sec = F.when(colon, F.coalesce(F.regexp_extract(rest, r"^\d+:\d+:(\d+)", 1).try_cast("long"), F.lit(0)))
    digits = F.regexp_extract(rest, r"^(\d+)", 1).try_cast("long")
    h, m, sec = F.coalesce(h, F.floor(digits / 10000)), F.coalesce(m, F.floor(digits / 100) % 100), F.coalesce(sec, digits % 100)
    return F.when((m < 60) & (sec < 60), (day * 24 + h) * 3600 + m * 60 + sec)


def parse_time(s: Column) -> Column:
    """TIME from text as ``text_to_sec`` reads it, held within 838:59:59."""
    total = text_to_sec(s)
    return F.when(total.isNotNull(), sec_to_time(total))


def time_to_sec(t: Column) -> Column:
    """Seconds of an interval."""
    return (F.extract(F.lit("DAY"), t) * 86400 + F.extract(F.lit("HOUR"), t) * 3600 + F.extract(F.lit("MINUTE"), t) * 60 + F.floor(F.extract(F.lit("SECOND"), t))).cast("long")


def timediff(a: Column, b: Column) -> Column:
    return a - b


def period_add(p: Column, n: int) -> Column:
    months = F.floor(p / 100) * 12 + p % 100 - 1 + n
    return (F.floor(months / 12) * 100 + months % 12 + 1).cast("long")


def period_diff(a: Column, b: Column) -> Column:
    return (F.floor(a / 100) * 12 + a % 100 - F.floor(b / 100) * 12 - b % 100).cast("long")


def microsecond(ts: Column) -> Column:
    return (F.unix_micros(ts.cast("timestamp")) % 1000000).cast("long")


def week(d: Column, mode: int = 0) -> Column:
    """WEEK in its eight modes: bit 0 Monday first, bit 1 weeks run from 1 to 53, bit 2 the first week is the one with the first such day."""
    monday, from_one, first_day = bool(mode & 1), bool(mode & 2), bool(mode & 4)
    if not monday:
        first_day = not first_day
    # place of January 1st within its week, 0 for the first day of a week
    place = lambda x: F.weekday(x) if monday else F.dayofweek(x) - 1

    def start(year: Column) -> Column:
        """The day on which week 1 of a year begins."""
        jan = F.make_date(year, F.lit(1), F.lit(1))
        at = place(jan)
        ahead = (at != 0) if first_day else (at > 3)
        return F.when(ahead, F.date_add(jan, (7 - at).cast("int"))).otherwise(F.date_sub(jan, at.cast("int")))

    d = F.to_date(d)
    y = F.year(d)
    this, before, after = start(y), start(y - 1), start(y + 1)
    n = lambda s: F.floor(F.datediff(d, s) / 7) + 1
    if from_one:
        return F.when(d < this, n(before)).when(d >= after, n(after)).otherwise(n(this)).cast("int")
    return F.when(d < this, F.lit(0)).otherwise(n(this)).cast("int")


def yearweek(d: Column, mode: int = 0) -> Column:
    w = week(d, mode | 2)
    y = F.year(d) + F.when((F.month(d) == 1) & (w > 50), -1).when((F.month(d) == 12) & (w < 5), 1).otherwise(0)
    return (y * 100 + w).cast("int")


def extract(unit: str, d: Column) -> Column:
    """EXTRACT, compound units included, as one integer."""
    parts = {"year": (F.year, 1), "month": (F.month, 100), "day": (F.day, 100), "hour": (F.hour, 100), "minute": (F.minute, 100), "second": (F.second, 100)}
    names = list(parts)
    if "_" not in unit:
        return {"week": F.weekofyear, "quarter": F.quarter, "microsecond": microsecond}.get(unit, parts.get(unit, (None,))[0])(d)
    a, b = (names.index(x) for x in unit.split("_"))
    out = parts[names[a]][0](d).cast("long")
    for name in names[a + 1 : b + 1]:
        out = out * 100 + parts[name][0](d)
    return out


def adddate(d: Column, days: int) -> Column:
    return F.date_add(d, days)


def subdate(d: Column, days: int) -> Column:
    return F.date_sub(d, days)


def addtime(ts: Column, seconds: int) -> Column:
    return ts.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))


def subtime(ts: Column, seconds: int) -> Column:
    return addtime(ts, -seconds)


def convert_tz(ts: Column, source: str, target: str) -> Column:
    return F.convert_timezone(F.lit(source), F.lit(target), ts.cast("timestamp_ntz"))


def timestampadd(unit: str, n: int, ts: Column) -> Column:
    return date_add(ts, n, unit.lower())


def timestampdiff(unit: str, a: Column, b: Column) -> Column:
    """Whole units from a to b."""
    return F.timestamp_diff(unit.upper(), a.cast("timestamp"), b.cast("timestamp"))


def get_format(kind: str, region: str) -> str:
    """GET_FORMAT: the usual formats by region."""
    dates = {"USA": "%m.%d.%Y", "JIS": "%Y-%m-%d", "ISO": "%Y-%m-%d", "EUR": "%d.%m.%Y", "INTERNAL": "%Y%m%d"}
    times = {"USA": "%h:%i:%s %p", "JIS": "%H:%i:%s", "ISO": "%H:%i:%s", "EUR": "%H.%i.%s", "INTERNAL": "%H%i%s"}
    both = {"USA": "%Y-%m-%d %H.%i.%s", "JIS": "%Y-%m-%d %H:%i:%s", "ISO": "%Y-%m-%d %H:%i:%s", "EUR": "%Y-%m-%d %H.%i.%s", "INTERNAL": "%Y%m%d%H%i%s"}
    return {"DATE": dates, "TIME": times, "DATETIME": both}[kind.upper()][region.upper()]


def time_format(t: Column, fmt: str = "%H:%i:%s") -> Column:
    """A TIME as text; hours may pass 24."""
    s = time_to_sec(t)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    whole = F.abs(s)
    hours = F.floor(whole / 3600)
    parts = {"%H": F.when(hours < 100, two(hours)).otherwise(hours.cast("string")), "%k": hours.cast("string"), "%i": two(F.floor(whole / 60) % 60), "%s": two(whole % 60)}
    out, i = [F.when(s < 0, "-").otherwise("")], 0
    while i < len(fmt):
        step = 2 if fmt[i : i + 2] in parts else 1
        out.append(parts[fmt[i : i + 2]] if step == 2 else F.lit(fmt[i]))
        i += step
    return F.concat(*out)
