"""Queries in the dialect's own text, each beside its SQL twin: functions by name, operators, clauses, modes."""

from __future__ import annotations

from ashlar import dialect
from ashlar.plans.registry import register, table


def text_query(name: str, text: str, sql: str, *tables: str, modes: frozenset[str] = frozenset()) -> None:
    @register(name, sql)
    def run(spark, d):
        return dialect.query(spark, text, modes=modes, **{t: table(spark, d, t) for t in tables})


text_query(
    "text_numbers",
    """SELECT s_suppkey, round(asin(s_suppkey / 100), 6) AS asin_, round(acos(s_suppkey), 6) AS acos_, round(atan(s_acctbal), 6) AS atan_, round(atan(s_acctbal, 2), 6) AS atan2_, round(cos(s_suppkey), 6) AS cos_,
    round(cot(s_suppkey), 4) AS cot_, round(degrees(s_suppkey), 6) AS deg, round(exp(s_suppkey / 50), 4) AS exp_, round(log2(s_suppkey), 6) AS log2_, round(log(2, s_suppkey), 6) AS log_, round(log(s_suppkey - 5), 6) AS ln_,
    round(tan(s_suppkey / 7), 4) AS tan_, round(pi(), 6) AS pi_, least(s_suppkey, 7) AS least_, least(s_suppkey, NULL) AS least_null, greatest(s_suppkey, NULL) AS great_null, conv(s_suppkey, 10, 16) AS conv_, truncate(s_acctbal, 1) AS trunc_,
    mod(s_suppkey, 5) AS mod_, s_suppkey % 0 AS mod0, s_suppkey / 0 AS div0, s_suppkey DIV 0 AS idiv0, s_suppkey DIV 4 AS idiv, round(s_suppkey / 4, 4) AS div4, crc32('MySQL') AS crc, interval(s_suppkey, 5, 10, 20) AS iv,
    rand(3) < 1 AS rnd, bit_count(7) AS bits, ceiling(s_acctbal) AS ceil_, sign(s_acctbal) AS sign_, power(s_suppkey, 2) AS pow_ FROM supplier""",
    """SELECT s_suppkey, CASE WHEN s_suppkey <= 100 THEN round(asin(s_suppkey / 100), 6) END AS asin_, CASE WHEN s_suppkey <= 1 THEN round(acos(s_suppkey), 6) END AS acos_, round(atan(s_acctbal), 6) AS atan_, round(atan2(s_acctbal, 2), 6) AS atan2_, round(cos(s_suppkey), 6) AS cos_,
    CASE WHEN s_suppkey <> 0 THEN round(1 / tan(s_suppkey), 4) END AS cot_, round(degrees(s_suppkey), 6) AS deg, round(exp(s_suppkey / 50), 4) AS exp_, CASE WHEN s_suppkey > 0 THEN round(log2(s_suppkey), 6) END AS log2_, CASE WHEN s_suppkey > 0 THEN round(log2(s_suppkey), 6) END AS log_,
    CASE WHEN s_suppkey > 5 THEN round(ln(s_suppkey - 5), 6) END AS ln_, round(tan(s_suppkey / 7), 4) AS tan_, round(pi(), 6) AS pi_, least(s_suppkey, 7) AS least_, NULL::BIGINT AS least_null, NULL::BIGINT AS great_null, upper(to_base(s_suppkey, 16)) AS conv_, trunc(s_acctbal::DECIMAL(18,4) * 10)::DOUBLE / 10 AS trunc_,
    s_suppkey % 5 AS mod_, NULL::BIGINT AS mod0, NULL::DOUBLE AS div0, NULL::BIGINT AS idiv0, s_suppkey // 4 AS idiv, round(s_suppkey / 4, 4) AS div4, 3259397556 AS crc, (s_suppkey >= 5)::INT + (s_suppkey >= 10)::INT + (s_suppkey >= 20)::INT AS iv,
    true AS rnd, 3 AS bits, ceil(s_acctbal)::BIGINT AS ceil_, sign(s_acctbal)::DOUBLE AS sign_, power(s_suppkey, 2) AS pow_ FROM supplier""",
    "supplier",
)

text_query(
    "text_strings",
    r"""SELECT n_nationkey, ascii(n_name) AS ascii_, ord(n_name) AS ord_, bit_length(n_name) AS bits, char(77, 121, n_nationkey + 65) AS char_, character_length(n_name) AS chars, length(n_name) AS bytes, octet_length(n_name) AS octets,
    format(n_nationkey * 1234.5, 2) AS format_, position('A' IN n_name) AS pos, locate('A', n_name, 3) AS loc, instr(n_name, 'A') AS ins, mid(n_name, 2, 3) AS mid_, substring(n_name FROM 2 FOR 2) AS sub_, substring(n_name, 0, 2) AS sub0, substr(n_name, -3) AS tail,
    trim(BOTH 'A' FROM n_name) AS trim_, trim(LEADING 'I' FROM n_name) AS lead_, trim(TRAILING 'A' FROM n_name) AS trail_, trim('  x ') AS plain, soundex('Quadratically') AS sdx, 'Smith' SOUNDS LIKE 'Smythe' AS sounds, hex(n_name) AS hx, hex(unhex('4D7953')) AS uh,
    conv('ff', 16, 2) AS cv, uncompress(compress(n_name)) AS packed, uncompressed_length(compress(n_name)) AS packed_length, elt(n_regionkey, 'a', 'b', 'c') AS elt_, elt(0, 'a') AS elt0, field(n_name, 'CHINA', 'INDIA') AS field_, find_in_set('b', 'a,b,c') AS fis,
    make_set(5, 'a', NULL, 'c') AS ms, export_set(9, 'Y', 'N', '-', 5) AS es, insert(n_name, 2, 2, '**') AS ins2, strcmp(n_name, 'FRANCE') AS cmp, quote('Don\'t') AS q, replace(n_name, 'A', 'aa') AS rep, repeat('ab', 3) AS rpt, reverse(n_name) AS rev, space(3) AS sp,
    left(n_name, 2) AS l2, right(n_name, 2) AS r2, lpad(n_name, 10, '.') AS lp, rpad(n_name, 10, '.') AS rp, lcase(n_name) AS lo, ucase('abc') AS up, concat_ws('-', n_name, NULL, 'x') AS ws, substring_index('www.x.org', '.', 2) AS si, bin(n_nationkey) AS bn, oct(n_nationkey) AS oc,
    load_file('/etc/none') IS NULL AS lf, inet_ntoa(inet_aton('209.207.224.40')) AS ip, password('password') AS pw, md5('abc') AS m, sha('abc') AS s, N'wide' AS nat, _utf8'cs' AS intro, hex(x'4142') AS hexed, b'101' + 0 AS bin_lit,
    charset(n_name) AS cs, convert(n_name USING utf8) AS conv_cs, coercibility('abc') AS coer, name_const('n', 14) AS nc, extractvalue('<a><b>x</b><b>y</b></a>', '/a/b') AS xv FROM nation""",
    r"""SELECT n_nationkey, ascii(n_name) AS ascii_, ascii(n_name)::BIGINT AS ord_, bit_length(n_name) AS bits, 'My' || chr((n_nationkey + 65)::INT) AS char_, length(n_name) AS chars, strlen(n_name) AS bytes, strlen(n_name) AS octets,
    format('{:,.2f}', n_nationkey * 1234.5::DOUBLE) AS format_, instr(n_name, 'A') AS pos, CASE WHEN instr(substr(n_name, 3), 'A') > 0 THEN instr(substr(n_name, 3), 'A') + 2 ELSE 0 END AS loc, instr(n_name, 'A') AS ins, substr(n_name, 2, 3) AS mid_, substr(n_name, 2, 2) AS sub_, '' AS sub0, substr(n_name, -3) AS tail,
    trim(n_name, 'A') AS trim_, ltrim(n_name, 'I') AS lead_, rtrim(n_name, 'A') AS trail_, 'x' AS plain, 'Q36324' AS sdx, true AS sounds, hex(n_name) AS hx, '4D7953' AS uh,
    '11111111' AS cv, n_name AS packed, strlen(n_name) AS packed_length, CASE n_regionkey WHEN 1 THEN 'a' WHEN 2 THEN 'b' WHEN 3 THEN 'c' END AS elt_, NULL::VARCHAR AS elt0, CASE n_name WHEN 'CHINA' THEN 1 WHEN 'INDIA' THEN 2 ELSE 0 END AS field_, 2 AS fis,
    'a,c' AS ms, 'Y-N-N-Y-N' AS es, left(n_name, 1) || '**' || substr(n_name, 4) AS ins2, CASE WHEN n_name < 'FRANCE' THEN -1 WHEN n_name > 'FRANCE' THEN 1 ELSE 0 END AS cmp, '''Don\''t''' AS q, replace(n_name, 'A', 'aa') AS rep, 'ababab' AS rpt, reverse(n_name) AS rev, '   ' AS sp,
    left(n_name, 2) AS l2, right(n_name, 2) AS r2, lpad(n_name, 10, '.') AS lp, rpad(n_name, 10, '.') AS rp, lower(n_name) AS lo, 'ABC' AS up, n_name || '-x' AS ws, 'www.x' AS si, bin(n_nationkey) AS bn, to_base(n_nationkey, 8) AS oc,
    true AS lf, '209.207.224.40' AS ip, '*2470C0C06DEE42FD1618BB99005ADCA2EC9D1E19' AS pw, md5('abc') AS m, sha1('abc') AS s, 'wide' AS nat, 'cs' AS intro, '4142' AS hexed, 5 AS bin_lit,
    'utf8' AS cs, n_name AS conv_cs, 4 AS coer, 14 AS nc, 'x y' AS xv FROM nation""",
    "nation",
)

_D = "strftime({}, '%Y-%m-%d %H:%M:%S')"
text_query(
    "text_dates",
    """SELECT o_orderkey, date_format(adddate(o_orderdate, 31), '%Y-%m-%d') AS ad, date_format(adddate(o_orderdate, INTERVAL 1 MONTH), '%Y-%m-%d') AS am, date_format(subdate(o_orderdate, INTERVAL 1 YEAR), '%Y-%m-%d') AS sy,
    date_format(date_add(o_orderdate, INTERVAL 90 SECOND), '%Y-%m-%d %H:%i:%s') AS ds, date_format(date_sub(o_orderdate, INTERVAL 2 HOUR), '%Y-%m-%d %T') AS dh, date_format(o_orderdate + INTERVAL 2 WEEK, '%d.%m.%y') AS dw, date_format(o_orderdate - INTERVAL 1 QUARTER, '%Y/%c/%e') AS dq,
    date_format(addtime(o_orderdate, '10:20:30'), '%H:%i:%s') AS at_, date_format(subtime(o_orderdate, '0:0:1'), '%Y-%m-%d %H:%i:%s') AS st_, time_to_sec(timediff('12:00:00', '10:30:00')) AS td, time_to_sec(maketime(12, 15, 30)) AS mt, maketime(12, 61, 0) IS NULL AS mt0,
    time_to_sec(time('10 11:12:13')) AS tm, time_format('300:05:07', '%H-%i-%s') AS tf, date_format(timestampadd(MINUTE, 5, o_orderdate), '%H:%i') AS ta, timestampdiff(MONTH, TIMESTAMP '1992-01-01 00:00:00', o_orderdate) AS tsd, date_format(convert_tz('2004-01-01 12:00:00', 'GMT', 'Europe/Moscow'), '%H:%i') AS tz,
    from_unixtime(86400 * o_orderkey, '%Y-%m-%d') AS fu, unix_timestamp(o_orderdate) AS ut, hour(o_orderdate) AS h, minute(o_orderdate) AS mi, second(o_orderdate) AS s, microsecond(o_orderdate) AS us, get_format(DATE, 'EUR') AS gf, date_format(o_orderdate, get_format(DATE, 'USA')) AS gu,
    extract(YEAR FROM o_orderdate) AS ey, extract(QUARTER FROM o_orderdate) AS eq, extract(YEAR_MONTH FROM o_orderdate) AS eym, extract(DAY_HOUR FROM o_orderdate) AS edh, extract(HOUR_SECOND FROM o_orderdate) AS ehs, extract(DAY_MINUTE FROM o_orderdate) AS edm, date_format(timestamp(o_orderdate), '%Y') AS ts,
    date_format(str_to_date('15-01-2001', '%d-%m-%Y'), '%Y-%m-%d') AS sd, to_days(date(o_orderdate)) AS tdays, date_format(from_days(730669), '%Y-%m-%d') AS fd, date_format(makedate(year(o_orderdate), 32), '%m-%d') AS md, dayname(o_orderdate) AS dn, monthname(o_orderdate) AS mn,
    period_add(199801, 2) AS pa, period_diff(199802, 199703) AS pd, time_to_sec(sec_to_time(9999999)) AS longest, datediff(o_orderdate, DATE '1995-06-17') AS dd, date_format(last_day(o_orderdate), '%d') AS ld, dayofweek(o_orderdate) AS dow, weekday(o_orderdate) AS wd, dayofyear(o_orderdate) AS doy,
    DATE '9999-12-31' + INTERVAL 1 DAY IS NULL AS late FROM orders""",
    f"""SELECT o_orderkey, strftime(o_orderdate + INTERVAL 31 DAY, '%Y-%m-%d') AS ad, strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d') AS am, strftime(o_orderdate - INTERVAL 1 YEAR, '%Y-%m-%d') AS sy,
    {_D.format("o_orderdate + INTERVAL 90 SECOND")} AS ds, {_D.format("o_orderdate - INTERVAL 2 HOUR")} AS dh, strftime(o_orderdate + INTERVAL 14 DAY, '%d.%m.%y') AS dw, strftime(o_orderdate - INTERVAL 3 MONTH, '%Y/%-m/%-d') AS dq,
    strftime(o_orderdate + INTERVAL '10:20:30', '%H:%M:%S') AS at_, {_D.format("o_orderdate - INTERVAL 1 SECOND")} AS st_, 5400 AS td, 44130 AS mt, true AS mt0,
    10 * 86400 + 11 * 3600 + 12 * 60 + 13 AS tm, '300-05-07' AS tf, strftime(o_orderdate + INTERVAL 5 MINUTE, '%H:%M') AS ta, datesub('month', TIMESTAMP '1992-01-01 00:00:00', o_orderdate) AS tsd, '15:00' AS tz,
    strftime(DATE '1970-01-01' + o_orderkey::INT, '%Y-%m-%d') AS fu, epoch(o_orderdate)::BIGINT AS ut, hour(o_orderdate) AS h, minute(o_orderdate) AS mi, second(o_orderdate) AS s, epoch_us(o_orderdate) % 1000000 AS us, '%d.%m.%Y' AS gf, strftime(o_orderdate, '%m.%d.%Y') AS gu,
    year(o_orderdate) AS ey, quarter(o_orderdate) AS eq, year(o_orderdate) * 100 + month(o_orderdate) AS eym, day(o_orderdate) * 100 + hour(o_orderdate) AS edh, hour(o_orderdate) * 10000 + minute(o_orderdate) * 100 + second(o_orderdate) AS ehs, day(o_orderdate) * 10000 + hour(o_orderdate) * 100 + minute(o_orderdate) AS edm, strftime(o_orderdate, '%Y') AS ts,
    '2001-01-15' AS sd, datediff('day', DATE '0001-01-01', o_orderdate::DATE) + 366 AS tdays, '2000-07-03' AS fd, '02-01' AS md, dayname(o_orderdate) AS dn, monthname(o_orderdate) AS mn,
    199803 AS pa, 11 AS pd, 838 * 3600 + 59 * 60 + 59 AS longest, datediff('day', DATE '1995-06-17', o_orderdate::DATE) AS dd, strftime(last_day(o_orderdate), '%d') AS ld, dayofweek(o_orderdate) + 1 AS dow, isodow(o_orderdate) - 1 AS wd, dayofyear(o_orderdate) AS doy,
    true AS late FROM orders""",
    "orders",
)

_WED = "(d - dayofweek(d)::INT + 3)"  # of the week that begins on a Sunday
text_query(
    "text_weeks",
    "SELECT DISTINCT date_format(o_orderdate, '%Y-%m-%d') AS d, week(o_orderdate) AS w0, week(o_orderdate, 1) AS w1, week(o_orderdate, 2) AS w2, week(o_orderdate, 3) AS w3, week(o_orderdate, 4) AS w4, week(o_orderdate, 5) AS w5, week(o_orderdate, 6) AS w6, week(o_orderdate, 7) AS w7, weekofyear(o_orderdate) AS woy, yearweek(o_orderdate, 3) AS yw3, yearweek(o_orderdate, 6) AS yw6 FROM orders",
    f"""WITH o AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders), w AS (SELECT d, {_WED} AS wed, (year(d) - 1)::INT AS py FROM o)
    SELECT strftime(d, '%Y-%m-%d') AS d, strftime(d, '%U')::INT AS w0, CASE WHEN isoyear(d) < year(d) THEN 0 WHEN isoyear(d) > year(d) THEN weekofyear(d - 7) + 1 ELSE weekofyear(d) END AS w1,
    CASE WHEN strftime(d, '%U') = '00' THEN strftime(make_date(py, 12, 31), '%U')::INT ELSE strftime(d, '%U')::INT END AS w2, weekofyear(d) AS w3,
    CASE WHEN year(wed) < year(d) THEN 0 WHEN year(wed) > year(d) THEN (dayofyear(wed - 7) - 1) // 7 + 2 ELSE (dayofyear(wed) - 1) // 7 + 1 END AS w4, strftime(d, '%W')::INT AS w5, (dayofyear(wed) - 1) // 7 + 1 AS w6,
    CASE WHEN strftime(d, '%W') = '00' THEN strftime(make_date(py, 12, 31), '%W')::INT ELSE strftime(d, '%W')::INT END AS w7, weekofyear(d) AS woy, yearweek(d) AS yw3, year(wed) * 100 + (dayofyear(wed) - 1) // 7 + 1 AS yw6 FROM w""",
    "orders",
)

text_query(
    "text_clock",
    """SELECT curdate() = date(now()) AS a, current_date = curdate() AS b, current_timestamp <= sysdate() AS c, time_to_sec(curtime()) BETWEEN 0 AND 86399 AS d, time_to_sec(current_time) >= 0 AS e, utc_date() <= current_date + INTERVAL 1 DAY AS f, utc_timestamp() IS NOT NULL AS g,
    time_to_sec(utc_time()) BETWEEN 0 AND 86399 AS h, unix_timestamp() > 1500000000 AS i, localtime = now() AS j, localtimestamp() = now() AS k, char_length(uuid()) AS l, version() IS NOT NULL AS m, database() = schema() AS n, user() = current_user AS o, session_user() = user() AS p, rand() < 1 AS q FROM DUAL""",
    "SELECT true AS a, true AS b, true AS c, true AS d, true AS e, true AS f, true AS g, true AS h, true AS i, true AS j, true AS k, 36 AS l, true AS m, true AS n, true AS o, true AS p, true AS q",
)

text_query(
    "text_quantified",
    """SELECT n_nationkey, n_regionkey = ANY (SELECT r_regionkey FROM region WHERE r_regionkey < 2) AS eq_any, n_regionkey <> ALL (SELECT r_regionkey FROM region WHERE r_regionkey < 2) AS ne_all, n_nationkey > ANY (SELECT r_regionkey + 3 FROM region) AS gt_any, n_nationkey <= SOME (SELECT r_regionkey FROM region) AS le_some,
    n_nationkey >= ALL (SELECT r_regionkey * 3 FROM region) AS ge_all, n_nationkey < ALL (SELECT r_regionkey FROM region WHERE r_regionkey > 9) AS none_all, n_nationkey > ANY (SELECT nullif(r_regionkey, 0) FROM region) AS gt_any_null, n_nationkey > ALL (SELECT nullif(r_regionkey, 4) FROM region) AS gt_all_null, n_regionkey = ALL (SELECT 1) AS eq_all, n_regionkey <> ANY (SELECT 1) AS ne_any, 5 > ANY (SELECT 1) AS lit FROM nation""",
    """SELECT n_nationkey, n_regionkey < 2 AS eq_any, n_regionkey >= 2 AS ne_all, n_nationkey > 3 AS gt_any, n_nationkey <= 4 AS le_some, n_nationkey >= 12 AS ge_all, true AS none_all, CASE WHEN n_nationkey > 1 THEN true END AS gt_any_null, CASE WHEN n_nationkey <= 3 THEN false END AS gt_all_null, n_regionkey = 1 AS eq_all, n_regionkey <> 1 AS ne_any, true AS lit FROM nation""",
    "nation", "region",
)

text_query(
    "text_xor",
    "SELECT n_nationkey FROM nation WHERE n_regionkey = 1 XOR n_nationkey > 10 AND n_nationkey < 20 XOR NOT n_name LIKE 'nation_1%' OR n_nationkey = 3 && n_regionkey = 1",
    "SELECT n_nationkey FROM nation WHERE (((n_regionkey = 1) <> (n_nationkey > 10 AND n_nationkey < 20)) <> (NOT n_name ILIKE 'nation_1%')) OR (n_nationkey = 3 AND n_regionkey = 1)",
    "nation",
)

text_query(
    "text_group_concat",
    "SELECT n_regionkey, group_concat(n_name ORDER BY n_name DESC SEPARATOR '; ') AS names, group_concat(DISTINCT left(n_name, 1) ORDER BY left(n_name, 1)) AS letters, std(n_nationkey) > 0 AS s, variance(n_nationkey) > 0 AS v, bit_or(n_nationkey) AS o, bit_and(n_nationkey) AS a, bit_xor(n_nationkey) AS x, count(DISTINCT n_name, n_regionkey) AS n FROM nation GROUP BY n_regionkey HAVING n > 1",
    "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name DESC) AS names, string_agg(DISTINCT left(n_name, 1), ',' ORDER BY left(n_name, 1)) AS letters, true AS s, true AS v, bit_or(n_nationkey) AS o, bit_and(n_nationkey) AS a, bit_xor(n_nationkey) AS x, count(DISTINCT n_name) AS n FROM nation GROUP BY n_regionkey",
    "nation",
)

text_query(
    "text_collation",
    """SELECT n_nationkey, n_name = 'nation_3  ' AS blind, BINARY n_name = 'nation_3' AS exact_no, n_name COLLATE utf8_bin = 'NATION_3' AS exact, 'a' = 'A ' AS literals, n_name IN ('nation_1', 'Nation_2') AS in_, n_name LIKE 'nation_1%' AS like_, n_name LIKE BINARY 'nation%' AS like_bin, n_name REGEXP '^[[:alpha:]]+_1[[:digit:]]*$' AS re, n_name NOT RLIKE 'n_2' AS nre, n_name < 'nation_2' AS lt FROM nation WHERE n_name <> 'nation_5'""",
    """SELECT n_nationkey, n_name = 'NATION_3' AS blind, false AS exact_no, n_name = 'NATION_3' AS exact, true AS literals, n_name IN ('NATION_1', 'NATION_2') AS in_, n_name LIKE 'NATION_1%' AS like_, false AS like_bin, regexp_matches(n_name, '^[A-Z]+_1[0-9]*$') AS re, NOT regexp_matches(n_name, 'N_2') AS nre, n_name < 'NATION_2' AS lt FROM nation WHERE n_name <> 'NATION_5'""",
    "nation",
)

text_query(
    "text_casts",
    """SELECT s_suppkey, cast(concat(s_suppkey, 'abc') AS SIGNED) AS prefix, cast('x' AS SIGNED) AS none, cast(-1 AS UNSIGNED) AS uns, cast(s_name AS CHAR(4)) AS c4, date_format(cast('1997-12-31' AS DATE), '%d.%m.%Y') AS d, cast('1997-02-30' AS DATE) IS NULL AS bad, time_to_sec(cast('12:30:00' AS TIME)) AS t, date_format(cast('1997-12-31 23:59:59' AS DATETIME), '%H:%i:%s') AS dt,
    hex(cast('ab' AS BINARY)) AS b, cast(s_acctbal AS DECIMAL(12,1)) AS dec1, convert(s_suppkey, CHAR) AS conv_char, convert('12', SIGNED) AS conv_int, if(s_suppkey > 3, 'y', 'n') AS if_, ifnull(NULL, 'z') AS ifn, nullif(s_suppkey, 1) AS nif, isnull(NULL) AS isn, coalesce(NULL, 3) AS co, CASE s_suppkey WHEN 1 THEN 'one' ELSE 'more' END AS c, (s_suppkey, 1) IN ((1, 1), (2, 1)) AS row_in FROM supplier""",
    """SELECT s_suppkey, s_suppkey::BIGINT AS prefix, 0 AS none, 18446744073709551615 AS uns, left(s_name, 4) AS c4, '31.12.1997' AS d, true AS bad, 45000 AS t, '23:59:59' AS dt, '6162' AS b, s_acctbal::DECIMAL(12,1) AS dec1, s_suppkey::VARCHAR AS conv_char, 12 AS conv_int, CASE WHEN s_suppkey > 3 THEN 'y' ELSE 'n' END AS if_, 'z' AS ifn, nullif(s_suppkey, 1) AS nif,
    true AS isn, 3 AS co, CASE s_suppkey WHEN 1 THEN 'one' ELSE 'more' END AS c, s_suppkey IN (1, 2) AS row_in FROM supplier""",
    "supplier",
)

text_query("text_modes", 'SELECT n_nationkey AS "key", n_name || \'-\' || n_regionkey AS joined FROM nation', "SELECT n_nationkey AS key, n_name || '-' || n_regionkey AS joined FROM nation", "nation", modes=frozenset({"PIPES_AS_CONCAT", "ANSI_QUOTES"}))
text_query("text_rollup", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey WITH ROLLUP", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY ROLLUP (n_regionkey)", "nation")
text_query("text_straight_join", "SELECT STRAIGHT_JOIN n_name, r_name FROM region STRAIGHT_JOIN nation ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'", "SELECT n_name, r_name FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'", "nation", "region")


@register("text_variables", "SELECT n_nationkey, n_nationkey + 7 AS plus, 12 AS assigned, 13 AS used FROM nation WHERE n_regionkey = 2")
def text_variables(spark, d):
    dialect.query(spark, "SET @base = 3 + 4")
    dialect.query(spark, "SET @region := 2")
    return dialect.query(spark, "SELECT n_nationkey, n_nationkey + @base AS plus, @twelve := 12 AS assigned, @twelve + 1 AS used FROM nation WHERE n_regionkey = @region", nation=table(spark, d, "nation"))


@register("text_parameters", "SELECT o_orderkey FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 5 OFFSET 2")
def text_parameters(spark, d):
    text = "SELECT o_orderkey FROM orders WHERE o_totalprice > ? AND BINARY o_orderstatus = ? ORDER BY o_orderkey LIMIT 2, 5"
    return dialect.query(spark, text, [200000, "F"], orders=table(spark, d, "orders"))


@register("text_update_xml", "SELECT n_nationkey, '<a><b>new</b><c>' || n_name || '</c></a>' AS changed FROM nation")
def text_update_xml(spark, d):
    from pyspark.sql import functions as F

    from ashlar.functions import xml

    doc = F.concat(F.lit("<a><b>old</b><c>"), F.col("n_name"), F.lit("</c></a>"))
    return table(spark, d, "nation").select("n_nationkey", xml.update_xml(doc, "/a/b", "<b>new</b>").alias("changed"))
