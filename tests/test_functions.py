"""Golden values of the dialect: single results of functions and operators."""

import datetime as dt

import pytest

from pyspark.sql import functions as F

from ashlar.functions import bits, coerce, dates, numbers, strings

def cases():
    L = F.lit
    D = lambda s: F.lit(s).cast("date")
    return {
        "shift 32": (bits.shift_left(L(1), 32), 4294967296), "shift 63": (bits.shift_left(L(1), 63), 9223372036854775808), "shift 64": (bits.shift_left(L(1), 64), 0),
        "right": (bits.shift_right(L(4), 2), 1), "right 63": (bits.shift_right(L(4), 63), 0), "minus right": (bits.shift_right(L(-1), 1), 9223372036854775807),
        "minus left": (bits.shift_left(L(-1), 1), 18446744073709551614), "minus or": (bits.bit_or(L(-1), L(0)), 18446744073709551615), "minus xor": (bits.bit_xor(L(-1), L(0)), 18446744073709551615),
        "minus and": (bits.bit_and(L(-1), L(0)), 0), "bit count": (bits.bit_count(L(7)), 3),
        "divide": (coerce.divide(L(8), L(5)).cast("string"), "1.6000"), "divide by zero": (coerce.divide(L(1), L(0)), None), "modulo": (coerce.modulo(L(8), L(5)), 3), "modulo zero": (coerce.modulo(L(8), L(0)), None),
        "integer division": (coerce.int_divide(L(-7), L(2)), -3), "integer division by zero": (coerce.int_divide(L(7), L(0)), None),
        "prefix": (coerce.to_number(L("12.5abc")), 12.5), "no prefix": (coerce.to_number(L("Hel")), 0.0), "null prefix": (coerce.to_number(L(None)), None),
        "clamp": (coerce.clamp(L(300), "tinyint"), 127), "clamp low": (coerce.clamp(L(-5), "int unsigned"), 0), "collation": (coerce.collated(L("a")) == coerce.collated(L("A ")), True),
        "interval": (numbers.interval(L(13), L(7), L(14), L(21)), 1), "interval null": (numbers.interval(L(None).cast("int"), L(1), L(10), L(100)), -1),
        "find b": (strings.find_in_set(L("b"), L("a,b,c")), 2), "find empty": (strings.find_in_set(L(""), L("a,b,c")), 0), "find empty at end": (strings.find_in_set(L(""), L("a,b,c,")), 4), "find empty at start": (strings.find_in_set(L(""), L(",a,b,c")), 1),
        "make set 0": (strings.make_set(L(0), L("a"), L("b"), L("c")), ""), "make set all": (strings.make_set(L(-1), L("a"), L("b"), L("c")), "a,b,c"), "make set nulls": (strings.make_set(L(5), L("a"), L(None), L("c")), "a,c"),
        "make set null": (strings.make_set(L(None).cast("int"), L("a")), None), "export set": (strings.export_set(L(9), "Y", "N", "-", 5), "Y-N-N-Y-N"), "elt out": (strings.elt(L(2), L(1)), None), "field null": (strings.field(L(None).cast("string"), L("a"), L("b")), 0),
        "concat_ws": (strings.concat_ws("<---->", L(1413006), L("idlfmv")), "1413006<---->idlfmv"), "substring 0": (strings.substring(L("abc"), 0, 2), ""), "substring tail": (strings.substring(L("abc"), -2), "bc"), "before start": (strings.substring(L("abc"), -5, 2), ""),
        "insert": (strings.insert(L("Quadratic"), 3, 4, L("What")), "QuWhattic"), "insert outside": (strings.insert(L("abc"), 9, 1, L("x")), "abc"), "trim": (strings.trim(L("xyxyabxy"), "xy"), "ab"), "trim leading": (strings.trim(L("xxax"), "x", "leading"), "ax"),
        "quote": (strings.quote(L("Don't!")), "'Don\\'t!'"), "quote null": (strings.quote(L(None).cast("string")), "NULL"), "length": (strings.length(L("é")), 2), "ord": (strings.ord_(L("é")), 50089), "strcmp": (strings.strcmp(L("a"), L("b")), -1),
        "soundex": (strings.soundex(L("Hello")), "H400"), "soundex long": (strings.soundex(L("Quadratically")), "Q36324"), "inet": (strings.inet_aton(L("209.207.224.40")), 3520061480), "inet back": (strings.inet_ntoa(L(3520061480)), "209.207.224.40"),
        "regexp": (strings.regexp(L("Ab1"), "^[[:alpha:]]+[[:digit:]]$"), True), "regexp null": (L(None).cast("string").rlike("a"), None), "like": (strings.like(L("A_b"), "a\\_B"), True),
        "password": (strings.password(L("password")), "*2470C0C06DEE42FD1618BB99005ADCA2EC9D1E19"), "compress": (strings.uncompress(strings.compress(L("abc" * 50))), "abc" * 50), "compressed length": (strings.uncompressed_length(strings.compress(L("abc" * 50))), 150),
        "truncate": (numbers.truncate(L(-1.999), 1).cast("double"), -1.9), "truncate tens": (numbers.truncate(L(122), -2).cast("long"), 100), "greatest": (numbers.greatest(L(2), L(None).cast("int")), None), "log": (F.round(numbers.log(2, L(8.0)), 6), 3.0), "log of 0": (numbers.log(2, L(0.0)), None),
        "to_days": (dates.to_days(D("2000-07-03")), 730669), "from_days": (dates.from_days(L(730669)), dt.date(2000, 7, 3)), "makedate": (dates.makedate(L(1997), L(1)), dt.date(1997, 1, 1)), "makedate 0": (dates.makedate(L(1997), L(0)), None),
        "period_add": (dates.period_add(L(199801), 2), 199803), "period_diff": (dates.period_diff(L(199802), L(199703)), 11), "dayname": (dates.dayname(D("1997-12-31")), "Wednesday"),
        "format": (dates.date_format(L("1997-12-31 23:59:59").cast("timestamp"), "%d-%m-%y %k:%i"), "31-12-97 23:59"), "format letters": (dates.date_format(D("1997-12-31"), "year %Y"), "year 1997"), "parse": (F.date_format(dates.str_to_date(L("15-01-2001"), "%d-%m-%Y"), "yyyy-MM-dd"), "2001-01-15"),
        "too late": (dates.date_add(D("9999-12-31"), 1, "day"), None), "month end": (F.date_format(dates.date_add(D("2000-01-31"), 1, "month"), "yyyy-MM-dd"), "2000-02-29"),
        "week 0": (dates.week(D("2008-02-20"), 0), 7), "week 1": (dates.week(D("2008-02-20"), 1), 8), "week 53": (dates.week(D("2008-12-31"), 1), 53), "week 0 start": (dates.week(D("2000-01-01"), 0), 0), "week 2": (dates.week(D("2000-01-01"), 2), 52),
        "yearweek": (dates.yearweek(D("1987-01-01"), 0), 198652), "year_month": (dates.extract("year_month", D("1999-07-02")), 199907), "day_minute": (dates.extract("day_minute", L("1999-07-02 01:02:03").cast("timestamp")), 20102),
        "tz": (F.date_format(dates.convert_tz(L("2004-01-01 12:00:00"), "GMT", "Europe/Moscow"), "yyyy-MM-dd HH:mm"), "2004-01-01 15:00"), "timestampdiff": (dates.timestampdiff("month", L("2003-02-01"), L("2003-05-01")), 3),
        "time_format": (dates.time_format(dates.parse_time(L("300:55:50")), "%H:%i:%s"), "300:55:50"), "addtime": (F.date_format(dates.addtime(L("1997-12-31 23:59:59"), 1), "yyyy-MM-dd HH:mm:ss"), "1998-01-01 00:00:00"),
        "time": (dates.time_to_sec(dates.parse_time(L("09:00:00"))), 32400), "time 2": (dates.time_to_sec(dates.parse_time(L("19:38:34"))), 70714), "time digits": (dates.time_to_sec(dates.parse_time(L("101112"))), 36672),
        "time of days": (dates.time_to_sec(dates.parse_time(L("10 22:22"))), 262 * 3600 + 22 * 60), "maketime": (dates.maketime(L(12), L(61), L(0)), None), "sec_to_time": (dates.time_to_sec(dates.sec_to_time(L(9999999))), 838 * 3600 + 59 * 60 + 59),
    }


def test_golden_values(spark):
    found = cases()
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(found.values())]).first()
    wrong = {k: (got, want) for (k, (_, want)), got in zip(found.items(), row, strict=True) if got != want}
    assert not wrong


def test_dialect_text(spark):
    from ashlar import dialect

    out = dialect.translate("SELECT STRAIGHT_JOIN a XOR b, 'LIMIT 1,2 XOR', STD(x) FROM t LIMIT 5, 10 -- LIMIT 1,2")
    assert out.endswith("LIMIT 10 OFFSET 5") and "'LIMIT 1,2 XOR'" in out and "CAST(a AS BOOLEAN) <> CAST(b AS BOOLEAN)" in out and "stddev_pop(x)" in out
    row = dialect.query(spark, "SELECT elt(2, 'a') AS e, sqrt(-1) AS s, quote('it''s') AS q, to_days(DATE'2000-07-03') AS d, strcmp('a', 'b') AS c, makedate(1997, 32) AS m FROM DUAL").first()
    assert (row["e"], row["s"], row["d"], row["c"], str(row["m"])) == (None, None, 730669, -1, "1997-02-01")


@pytest.mark.parametrize(
    "text, want",
    [
        ("SELECT greatest(1, NULL)", None), ("SELECT substring('abc', 0, 2)", ""), ("SELECT 'a' = 'A '", True), ("SELECT BINARY 'a' = 'A'", False), ("SELECT 1/0", None), ("SELECT 7 % 0", None),
        ("SELECT date_format('1997-12-31', '%Y-%m')", "1997-12"), ("SELECT week('2008-02-20', 0)", 7), ("SELECT week('2000-01-01', 2)", 52), ("SELECT 5 > ANY (SELECT 1)", True), ("SELECT 5 > ALL (SELECT 7)", False),
        ("SELECT 1 = 1 XOR 2 = 3", True), ("SELECT 1 XOR NULL", None), ("SELECT NOT 1 = 2 AND 3 BETWEEN 1 AND 5", True), ("SELECT 2 + 3 * 4 - -1", 15), ("SELECT (2 + 3) * 4", 20), ("SELECT 'x ,y' -- a note", "x ,y"),
        ("SELECT 'it''s' 'so'", "it'sso"), ("SELECT CASE WHEN 1 > 2 THEN 'a' ELSE 'b' END", "b"), ("SELECT elt(5, 'a')", None), ("SELECT if(1 < 2, 'y', 'n')", "y"), ("SELECT (1, 2) = (1, 2)", True), ("SELECT (1, 2) <> (1, 3)", True),
        ("SELECT /* LIMIT 1,2 */ coalesce(NULL, 3)", 3), ("SELECT 'Hello' REGEXP '^h[[:alpha:]]+$'", True), ("SELECT 'abc' LIKE 'A%'", True), ("SELECT \"double\"", "double"), ("SELECT 8 << 2", 32), ("SELECT 7 DIV 2", 3),
    ],
)
def test_dialect_values(spark, text, want):
    from ashlar import dialect

    assert dialect.query(spark, text).first()[0] == want


def test_explain_and_create_table(spark):
    from ashlar import dialect

    assert "Physical Plan" in dialect.query(spark, "EXPLAIN EXTENDED SELECT 1 XOR 2").first()[0]
    assert dialect.translate("CREATE TABLE t SELECT a FROM u LIMIT 1, 2") == "CREATE TABLE t USING parquet AS SELECT a FROM u LIMIT 2 OFFSET 1"


def test_single_value_tool(spark, sf_dir):
    from ashlar.__main__ import single_value

    assert single_value(spark, "SELECT count(*) FROM nation WHERE n_name <> 'nation_3'", {"nation": f"{sf_dir}/nation.parquet"}) == 24


def test_years_and_decimals(spark):
    L = F.lit
    got = spark.range(1).select(*[coerce.year(L(x)) for x in ("69", "70", "1900", "2155", "0000", "x")], coerce.decimal(L("12.345x"), 5, 2).cast("string"), coerce.decimal(L("99999"), 5, 2).cast("string"), coerce.decimal(L("none"), 5, 2).cast("string")).first()
    assert tuple(got) == (2069, 1970, None, 2155, 0, None, "12.35", "999.99", "0.00")
