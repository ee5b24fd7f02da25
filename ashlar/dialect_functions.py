"""The dialect's functions as Spark SQL text: each takes its arguments' text and gives an expression.

The rules are those of :mod:`ashlar.functions`, which has the same functions for columns.  A TIME is a day-time
interval; formats (``%Y-%m``) and patterns have to be literals where they are translated.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from ashlar.functions import dates, strings

GROUP_CONCAT_LENGTH = 1024
#: Names that mean another function of Spark's.
RENAMED = {
    "std": "stddev_pop", "stddev": "stddev_pop", "variance": "var_pop", "lcase": "lower", "ucase": "upper", "length": "octet_length", "character_length": "char_length",
    "date": "to_date", "timestamp": "to_timestamp_ntz", "database": "current_database", "schema": "current_database", "session_user": "current_user", "system_user": "current_user",
    "ceiling": "ceil", "localtime": "now", "localtimestamp": "now", "sysdate": "now", "curdate": "current_date", "dayofmonth": "day", "sha": "sha1", "if": "if", "isnull": "isnull",
}
#: Functions that may be written without parentheses.
BARE = {
    "current_date": "current_date()", "current_timestamp": "current_timestamp()", "localtime": "now()", "localtimestamp": "now()", "current_user": "current_user()",
    "current_time": "(now() - date_trunc('DAY', now()))", "utc_date": "to_date(to_utc_timestamp(now(), current_timezone()))", "utc_timestamp": "to_utc_timestamp(now(), current_timezone())",
    "unknown": "CAST(NULL AS BOOLEAN)",
}
_SECONDS = {"week": 604800, "day": 86400, "hour": 3600, "minute": 60, "second": 1}
_MONTHS = {"year": 12, "quarter": 3, "month": 1}
_PARTS = ("year", "month", "day", "hour", "minute", "second")
_POSIX = {"alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "space": r"\s", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "punct": r"\p{Punct}", "xdigit": r"\p{XDigit}"}


def literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def java_pattern(pattern: str) -> str:
    for name, java in _POSIX.items():
        pattern = pattern.replace(f"[:{name}:]", java)
    return pattern.replace("[[:<:]]", r"\b").replace("[[:>:]]", r"\b")


def quantified(x: str, op: str, kind: str, sub: str) -> str:
    """``x op ANY/ALL (sub)``: false or true over no rows, unknown where only a NULL could decide."""
    if (op, kind) in (("=", "any"), ("<>", "all")):
        return f"({x} {'NOT ' if op == '<>' else ''}IN ({sub}))"
    one = f"(SELECT named_struct('lo', min(c), 'hi', max(c), 'n', count(*), 'known', count(c)) FROM ({sub}) AS q(c))"
    if op in ("=", "<>"):  # = ALL and <> ANY: one value, or another, decides
        differs = f"({x} <> {one}.lo OR {x} <> {one}.hi)"
        hit = differs
    else:
        end = "hi" if (op[0] == "<") == (kind == "any") else "lo"
        hit = f"({x} {op} {one}.{end})" if kind == "any" else f"(NOT ({x} {op} {one}.{end}))"
    empty, found = ("false", "true") if kind == "any" else ("true", "false")
    return f"(CASE WHEN {one}.n = 0 THEN {empty} WHEN {hit} THEN {found} WHEN {x} IS NULL OR {one}.known < {one}.n THEN CAST(NULL AS BOOLEAN) ELSE {empty} END)"


def add_interval(x: str, n: str, unit: str, sign: str = "") -> str:
    """x plus n units; NULL past the year 9999."""
    if unit in _MONTHS:
        moved = f"({x} + make_ym_interval(0, CAST({sign}({n}) AS INT) * {_MONTHS[unit]}))"
    elif unit in ("day", "week"):
        moved = f"({x} + make_interval(0, 0, 0, CAST({sign}({n}) AS INT) * {_SECONDS[unit] // 86400}))"
    elif unit == "microsecond":
        moved = f"(CAST({x} AS TIMESTAMP_NTZ) + make_dt_interval(0, 0, 0, {sign}({n}) / 1000000))"
    else:
        moved = f"(CAST({x} AS TIMESTAMP_NTZ) + make_dt_interval(0, 0, 0, {sign}({n}) * {_SECONDS[unit]}))"
    return f"(CASE WHEN year({moved}) <= 9999 THEN {moved} END)"


def time_literal(value: str) -> str:
    """A TIME out of text: ``[d ]h:m[:s]`` or digits, held within 838:59:59; NULL if minutes or seconds pass 59."""
    m = re.match(r"^\s*(?P<sign>-?)(?:(?P<d>\d+) +)?(?:(?P<h>\d+):(?P<m>\d+)(?::(?P<s>\d+))?|(?P<n>\d+))", value)
    none = "CAST(NULL AS INTERVAL DAY TO SECOND)"
    if m is None:
        return none
    n = int(m["n"] or 0)
    h, mi, s = (n // 10000, n // 100 % 100, n % 100) if m["n"] else (int(m["h"]), int(m["m"]), int(m["s"] or 0))
    if mi > 59 or s > 59:
        return none
    total = min((int(m["d"] or 0) * 24 + h) * 3600 + mi * 60 + s, dates.LONGEST_TIME)
    return f"make_dt_interval(0, 0, 0, {m['sign']}{total})"


def _time(x: str, value) -> str:
    return time_literal(value) if isinstance(value, str) and x.startswith("'") else x


def cast(x: str, kind: str, value: str | None) -> str:
    if kind in ("signed", "signedinteger"):
        return f"CAST(coalesce(try_cast(regexp_extract(CAST({x} AS STRING), '^\\\\s*([+-]?[0-9]+)', 1) AS BIGINT), if({x} IS NULL, NULL, 0)) AS BIGINT)"
    if kind in ("unsigned", "unsignedinteger"):
        return f"(CASE WHEN CAST({x} AS DECIMAL(38,0)) < 0 THEN CAST({x} AS DECIMAL(38,0)) + 18446744073709551616 ELSE CAST({x} AS DECIMAL(38,0)) END)"
    if kind.startswith(("char", "nchar")):
        n = re.search(r"\d+", kind)
        return f"left(CAST({x} AS STRING), {n[0]})" if n else f"CAST({x} AS STRING)"
    if kind == "time":
        return time_literal(value) if value is not None else f"(CAST({x} AS TIMESTAMP_NTZ) - date_trunc('DAY', CAST({x} AS TIMESTAMP_NTZ)))"
    if kind == "datetime":
        return f"try_cast({x} AS TIMESTAMP_NTZ)"
    if kind.startswith("binary"):
        return f"CAST({x} AS BINARY)"
    return f"try_cast({x} AS {'DECIMAL(10,0)' if kind == 'decimal' else kind.upper()})"


def extract(unit: str, x: str) -> str:
    if "_" not in unit:
        return f"CAST({'weekofyear(' + x + ')' if unit == 'week' else microsecond(x) if unit == 'microsecond' else unit + '(' + x + ')'} AS BIGINT)"
    a, b = unit.split("_")
    parts = [p for p in _PARTS if _PARTS.index(a) <= _PARTS.index(p) <= _PARTS.index(b if b != "microsecond" else "second")]
    out = f"CAST({parts[0]}({x}) AS BIGINT)"
    for p in parts[1:]:
        out = f"({out} * 100 + {p}({x}))"
    return f"({out} * 1000000 + {microsecond(x)})" if b == "microsecond" else out


def trim(x: str, what: str, where: str) -> str:
    what = literal(re.escape(what)).replace("\\\\ ", " ")[1:-1]
    if where in ("both", "leading"):
        x = f"regexp_replace({x}, '^(?:{what})+', '')"
    return f"regexp_replace({x}, '(?:{what})+$', '')" if where in ("both", "trailing") else x


def soundex(s: str) -> str:
    """Of any length, at least four characters: vowels dropped, equal neighbours merged."""
    letters = f"regexp_replace(upper({s}), '[^A-Z]', '')"
    codes = f"regexp_replace(replace(translate({letters}, 'BFPVCGJKQSXZDTLMNRAEIOUYHW', '11112222222233455600000000'), '0', ''), '(.)\\\\1+', '$1')"
    first = f"translate(left({letters}, 1), 'BFPVCGJKQSXZDTLMNR', '111122222222334556')"
    out = f"concat(left({letters}, 1), if(left({codes}, 1) = {first}, substring({codes}, 2), {codes}))"
    return f"(CASE WHEN {letters} = '' THEN '' ELSE rpad({out}, greatest(4, char_length({out})), '0') END)"


def microsecond(x: str) -> str:
    return f"(unix_micros(CAST({x} AS TIMESTAMP)) % 1000000)"


def week(d: str, mode: int) -> str:
    """The eight modes: bit 0 Monday first, bit 1 weeks from 1 to 53, bit 2 the first week is the one with the first such day."""
    monday, from_one, first_day = bool(mode & 1), bool(mode & 2), bool(mode & 4) ^ (not mode & 1)

    def start(year: str) -> str:
        jan = f"make_date({year}, 1, 1)"
        place = f"weekday({jan})" if monday else f"(dayofweek({jan}) - 1)"
        return f"if({place} {'<> 0' if first_day else '> 3'}, date_add({jan}, 7 - {place}), date_sub({jan}, {place}))"

    d = f"to_date({d})"
    n = lambda year: f"(floor(datediff({d}, {start(year)}) / 7) + 1)"
    y = f"year({d})"
    before = n(f"{y} - 1") if from_one else "0"
    after = f" WHEN {d} >= {start(f'{y} + 1')} THEN {n(f'{y} + 1')}" if from_one else ""
    return f"CAST(CASE WHEN {d} < {start(y)} THEN {before}{after} ELSE {n(y)} END AS INT)"


def yearweek(d: str, mode: int) -> str:
    w = week(d, mode | 2)
    shift = f"CASE WHEN month({d}) = 1 AND {w} > 50 THEN -1 WHEN month({d}) = 12 AND {w} < 5 THEN 1 ELSE 0 END"
    return f"((year({d}) + {shift}) * 100 + {w})"


def _null_if_any(name: str):
    return lambda *xs: f"(CASE WHEN {' OR '.join(f'{x} IS NULL' for x in xs)} THEN NULL ELSE {name}({', '.join(xs)}) END)"


def _substring(s: str, at: str, n: str | None = None) -> str:
    piece = f"substring({s}, {at}" + (f", {n})" if n else ")")
    return f"(CASE WHEN {at} = 0 OR {at} < -char_length({s})" + (f" OR {n} <= 0" if n else "") + f" THEN if({s} IS NULL, NULL, '') ELSE {piece} END)"


def _insert(s: str, at: str, n: str, new: str) -> str:
    return f"(CASE WHEN {at} BETWEEN 1 AND char_length({s}) THEN concat(substring({s}, 1, {at} - 1), {new}, if({n} < 0, '', substring({s}, {at} + {n}))) ELSE {s} END)"


def _truncate(x: str, d: str) -> str:
    wide = f"CAST({x} AS DECIMAL(30,8))"
    return f"CAST(signum({wide}) * floor(abs({wide}) * power(10, {d})) / power(10, {d}) AS DOUBLE)"


def _bits(b: str, i: int) -> str:
    return f"(shiftright(CAST({b} AS BIGINT), {i}) & 1) = 1"


def _make_set(b: str, *items: str) -> str:
    return f"(CASE WHEN {b} IS NOT NULL THEN concat_ws(',', {', '.join(f'if({_bits(b, i)}, {x}, NULL)' for i, x in enumerate(items))}) END)"


def _export_set(b: str, on: str, off: str, sep: str = "','", n: str = "64") -> str:
    return f"concat_ws({sep}, {', '.join(f'if({_bits(b, i)}, {on}, {off})' for i in range(int(n)))})"


def _interval(n: str, *bounds: str) -> str:
    return f"(CASE WHEN {n} IS NULL THEN -1 ELSE {' + '.join(f'if({b} <= {n}, 1, 0)' for b in bounds)} END)"


def _period(p: str) -> str:
    return f"(floor({p} / 100) * 12 + {p} % 100 - 1)"


def _seconds(t: str) -> str:
    return f"CAST(extract(DAY FROM {t}) * 86400 + extract(HOUR FROM {t}) * 3600 + extract(MINUTE FROM {t}) * 60 + floor(extract(SECOND FROM {t})) AS BIGINT)"


def _log(a: str, b: str | None = None) -> str:
    if b is None:
        return f"(CASE WHEN {a} > 0 THEN ln({a}) END)"
    return f"(CASE WHEN {a} > 0 AND {a} <> 1 AND {b} > 0 THEN ln({b}) / ln({a}) END)"


def _inet_aton(s: str) -> str:
    part = lambda i: f"try_cast(split({s}, '[.]')[{i}] AS BIGINT)"
    return f"(CASE WHEN size(split({s}, '[.]')) = 4 THEN {part(0)} * 16777216 + {part(1)} * 65536 + {part(2)} * 256 + {part(3)} END)"


def _inet_ntoa(n: str) -> str:
    return f"(CASE WHEN {n} BETWEEN 0 AND 4294967295 THEN concat_ws('.', {', '.join(f'CAST(shiftright(CAST({n} AS BIGINT), {s}) & 255 AS STRING)' for s in (24, 16, 8, 0))}) END)"


def _within(name: str):
    return lambda x: f"(CASE WHEN {x} BETWEEN -1 AND 1 THEN {name}({x}) END)"


#: Functions of the text of their arguments.
TEMPLATES = {
    "char": lambda *xs: f"concat({', '.join(f'if({x} IS NULL, {chr(39) * 2}, chr({x}))' for x in xs)})", "ord": lambda s: f"CAST(conv(hex(encode(left({s}, 1), 'UTF-8')), 16, 10) AS BIGINT)",
    "elt": lambda n, *xs: f"get(array({', '.join(xs)}), CAST({n} AS INT) - 1)", "field": lambda x, *xs: f"CAST(coalesce(array_position(array({', '.join(xs)}), {x}), 0) AS INT)",
    "find_in_set": lambda x, s: f"(CASE WHEN {s} = '' THEN if({x} IS NULL, NULL, 0) ELSE find_in_set({x}, {s}) END)", "make_set": _make_set, "export_set": _export_set,
    "format": lambda x, d: f"format_number({x}, {d})", "insert": _insert, "substring": _substring, "substr": _substring, "mid": _substring, "strcmp": lambda a, b: f"(CASE WHEN {a} < {b} THEN -1 WHEN {a} > {b} THEN 1 WHEN {a} = {b} THEN 0 END)",
    "quote": lambda s: f"coalesce(concat('\\'', regexp_replace({s}, '([\\\\\\\\\\'])', '\\\\\\\\$1'), '\\''), 'NULL')", "oct": lambda x: f"conv(CAST({x} AS STRING), 10, 8)", "soundex": soundex,
    "conv": lambda x, a, b: f"conv(CAST({x} AS STRING), {a}, {b})", "load_file": lambda path: "CAST(NULL AS BINARY)",  # the server's files are out of reach, as for a user without the right to them
    "space": lambda n: f"repeat(' ', {n})", "compress": lambda s: f"ashlar_compress({s})", "uncompress": lambda b: f"ashlar_uncompress({b})",
    "uncompressed_length": lambda b: f"(CASE WHEN octet_length({b}) = 0 THEN 0L ELSE CAST(conv(concat({', '.join(f'hex(substring({b}, {i}, 1))' for i in (4, 3, 2, 1))}), 16, 10) AS BIGINT) END)",
    "charset": lambda x: "'utf8'", "coercibility": lambda x: f"(CASE WHEN {x} IS NULL THEN 6 ELSE {4 if x.startswith(chr(39)) else 2} END)", "name_const": lambda n, v: v, "row": lambda *xs: f"({', '.join(xs)})",
    "acos": _within("acos"), "asin": _within("asin"), "sqrt": lambda x: f"(CASE WHEN {x} >= 0 THEN sqrt({x}) END)", "ln": _log, "log": _log, "log2": lambda x: f"(CASE WHEN {x} > 0 THEN log2({x}) END)",
    "log10": lambda x: f"(CASE WHEN {x} > 0 THEN log10({x}) END)", "cot": lambda x: f"try_divide(1.0D, tan({x}))", "truncate": _truncate, "atan": lambda *xs: f"{'atan' if len(xs) == 1 else 'atan2'}({', '.join(xs)})",
    "mod": lambda a, b: f"try_mod({a}, {b})", "greatest": _null_if_any("greatest"), "least": _null_if_any("least"), "interval": _interval, "crc32": lambda s: f"crc32(CAST({s} AS BINARY))", "md5": lambda s: f"md5(CAST({s} AS BINARY))",
    "bit_and": lambda x: f"coalesce(CAST(bit_and({x}) AS DECIMAL(20,0)), 18446744073709551615)", "bit_or": lambda x: f"coalesce(CAST(bit_or({x}) AS DECIMAL(20,0)), 0)", "bit_xor": lambda x: f"coalesce(CAST(bit_xor({x}) AS DECIMAL(20,0)), 0)",
    "to_days": lambda d: f"(datediff({d}, DATE'0001-01-01') + 366)", "from_days": lambda n: f"date_add(DATE'0001-01-01', CAST({n} AS INT) - 366)", "makedate": lambda y, n: f"(CASE WHEN {n} > 0 THEN date_add(make_date({y}, 1, 1), {n} - 1) END)",
    "maketime": lambda h, m, s: f"(CASE WHEN {m} BETWEEN 0 AND 59 AND {s} >= 0 AND {s} < 60 THEN make_dt_interval(0, {h}, {m}, {s}) END)", "sec_to_time": lambda n: f"make_dt_interval(0, 0, 0, least(greatest({n}, -{dates.LONGEST_TIME}), {dates.LONGEST_TIME}))",
    "dayname": lambda d: f"date_format({d}, 'EEEE')", "monthname": lambda d: f"date_format({d}, 'MMMM')", "microsecond": microsecond, "period_add": lambda p, n: f"CAST(floor(({_period(p)} + {n}) / 12) * 100 + ({_period(p)} + {n}) % 12 + 1 AS BIGINT)",
    "period_diff": lambda a, b: f"CAST({_period(a)} - {_period(b)} AS BIGINT)", "convert_tz": lambda t, a, b: f"convert_timezone({a}, {b}, CAST({t} AS TIMESTAMP_NTZ))", "unix_timestamp": lambda *xs: f"unix_timestamp({', '.join(f'CAST({x} AS TIMESTAMP)' for x in xs)})",
    "curtime": lambda: BARE["current_time"], "utc_date": lambda: BARE["utc_date"], "utc_timestamp": lambda: BARE["utc_timestamp"], "utc_time": lambda: "(to_utc_timestamp(now(), current_timezone()) - date_trunc('DAY', to_utc_timestamp(now(), current_timezone())))",
    "inet_aton": _inet_aton, "inet_ntoa": _inet_ntoa, "password": lambda s: f"(CASE WHEN {s} = '' THEN '' ELSE concat('*', upper(sha1(unhex(sha1({s}))))) END)", "extractvalue": lambda x, p: f"array_join(xpath({x}, concat({p}, '/text()')), ' ')",
    "adddate": lambda d, n: f"date_add({d}, {n})", "subdate": lambda d, n: f"date_sub({d}, {n})", "rand": lambda *xs: f"rand({', '.join(xs)})",
}


def _formatted(name: str, x: str, fmt: str, is_late: str) -> str:
    usual, late = (f"{name}({x}, {literal(dates.pattern(fmt, late=after))})" for after in (False, True))
    return usual if usual == late else f"(CASE WHEN {is_late} THEN {late} ELSE {usual} END)"


def _format(x: tuple, fmt: tuple) -> str:
    return _formatted("date_format", x[0], fmt[1], f"year(CAST({x[0]} AS TIMESTAMP)) > 9999")


def _from_unixtime(n: tuple, fmt: tuple = ("", "%Y-%m-%d %H:%i:%s")) -> str:
    return _formatted("from_unixtime", n[0], fmt[1], f"CAST({n[0]} AS BIGINT) >= unix_seconds(TIMESTAMP'+10000-01-01 00:00:00')")


def _shifted(sign: str):
    """ADDDATE and its like with an interval, ``(text, (n, unit))``, or a number of days."""
    return lambda d, n: add_interval(d[0], *n[1], sign=sign) if isinstance(n[1], tuple) else f"{'date_sub' if sign else 'date_add'}({d[0]}, {n[0]})"


def _time_format(t: tuple, fmt: tuple = ("", "%H:%i:%s")) -> str:
    s = _seconds(_time(*t))
    two = lambda x: f"lpad(CAST({x} AS STRING), 2, '0')"
    hours = f"floor(abs({s}) / 3600)"
    parts = {"%H": f"if({hours} < 100, {two(hours)}, CAST({hours} AS STRING))", "%k": f"CAST({hours} AS STRING)", "%i": two(f"(floor(abs({s}) / 60) % 60)"), "%s": two(f"(abs({s}) % 60)")}
    out = [f"if({s} < 0, '-', '')"] + [parts.get(x, literal(x)) for x in re.findall(r"%[Hkis]|.", fmt[1], re.S)]
    return f"concat({', '.join(out)})"


#: Functions that look at literals: arguments are (text, value).
WITH_VALUES = {
    "date_format": _format, "str_to_date": lambda s, fmt: f"try_to_timestamp({s[0]}, {literal(dates.pattern(fmt[1]))})",
    "from_unixtime": _from_unixtime,
    "date_add": _shifted(""), "adddate": _shifted(""), "date_sub": _shifted("-"), "subdate": _shifted("-"),
    "week": lambda d, mode=("0", "0"): week(d[0], int(mode[1])), "yearweek": lambda d, mode=("0", "0"): yearweek(d[0], int(mode[1])),
    "time": lambda x: _time(*x) if x[0].startswith("'") else f"(CAST({x[0]} AS TIMESTAMP_NTZ) - date_trunc('DAY', CAST({x[0]} AS TIMESTAMP_NTZ)))",
    "time_to_sec": lambda t: _seconds(_time(*t)), "timediff": lambda a, b: f"({_time(*a)} - {_time(*b)})", "time_format": _time_format,
    "addtime": lambda a, b: f"(CAST({a[0]} AS TIMESTAMP_NTZ) + {_time(*b)})", "subtime": lambda a, b: f"(CAST({a[0]} AS TIMESTAMP_NTZ) - {_time(*b)})",
}


def register(spark: SparkSession, text: str) -> None:
    """Makes the few functions known that need Python, where a text names one."""
    if re.search(r"compress\s*\(", text, re.I):
        spark.udf.register("ashlar_compress", strings.compress_udf())
        spark.udf.register("ashlar_uncompress", strings.uncompress_udf())

