"""String functions with the dialect's NULL and position rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def length(s: Column) -> Column:
    """Bytes."""
    return F.octet_length(s)


char_length, octet_length, bit_length = F.char_length, F.octet_length, F.bit_length
concat, lower, upper, reverse, left, right, replace = F.concat, F.lower, F.upper, F.reverse, F.left, F.right, F.replace
lpad, rpad, ltrim, rtrim, instr, hex_, unhex, ascii_ = F.lpad, F.rpad, F.ltrim, F.rtrim, F.instr, F.hex, F.unhex, F.ascii


def concat_ws(sep: str, *parts: Column) -> Column:
    return F.concat_ws(sep, *[p.cast("string") for p in parts])


def ord_(s: Column) -> Column:
    """The code of the first character's bytes, high byte first."""
    first = F.hex(F.encode(F.left(s, F.lit(1)), "UTF-8"))
    return F.conv(first, 16, 10).cast("long")


def char_(*codes: Column) -> Column:
    return F.concat(*[F.when(c.isNotNull(), F.chr(c)).otherwise("") for c in codes])


def elt(n: Column, *items: Column) -> Column:
    """The n-th item; NULL out of range."""
    return F.get(F.array(*items), n.cast("int") - 1)


def field(x: Column, *items: Column) -> Column:
    """The place of x among the items; 0 if it isn't there or is NULL."""
    return F.coalesce(F.array_position(F.array(*items), x), F.lit(0)).cast("int")


def find_in_set(x: Column, items: Column) -> Column:
    return F.when(F.octet_length(items) == 0, F.when(x.isNotNull(), F.lit(0))).otherwise(F.find_in_set(x, items))


def make_set(bits: Column, *items: Column) -> Column:
    """The items whose bit is set, comma-joined; NULL items are left out."""
    chosen = [F.when(F.shiftright(bits.cast("long"), i).bitwiseAND(F.lit(1)) == 1, item) for i, item in enumerate(items)]
    return F.when(bits.isNotNull(), F.concat_ws(",", *chosen))


def export_set(bits: Column, on: str, off: str, sep: str = ",", n: int = 64) -> Column:
    return F.concat_ws(sep, *[F.when(F.shiftright(bits.cast("long"), i).bitwiseAND(F.lit(1)) == 1, on).otherwise(off) for i in range(n)])


def insert(s: Column, at: int, n: int, new: Column) -> Column:
    """``s`` with n characters from ``at`` replaced; unchanged if ``at`` lies outside it."""
    inside = (F.lit(at) >= 1) & (F.lit(at) <= F.char_length(s))
    rest = F.lit("") if n < 0 else F.substring(s, at + n, 1 << 30)
    return F.when(inside, F.concat(F.substring(s, 1, at - 1), new, rest)).otherwise(s)


def substring(s: Column, at: int, n: int | None = None) -> Column:
    """From 1, or from the end if negative; empty at 0 and before the start."""
    if at == 0 or (n is not None and n <= 0):
        return F.when(s.isNotNull(), F.lit(""))
    piece = F.substring(s, at, 1 << 30 if n is None else n)
    return piece if at > 0 else F.when(F.char_length(s) < -at, F.lit("")).otherwise(piece)


def substring_index(s: Column, sep: str, n: int) -> Column:
    return F.substring_index(s, sep, n)


def locate(sub: Column, s: Column, at: int = 1) -> Column:
    return F.position(sub, s, F.lit(at))


def trim(s: Column, what: str = " ", where: str = "both") -> Column:
    """Strips whole repeats of ``what``, not single characters of it."""
    import re

    quoted = re.escape(what)
    if where in ("both", "leading"):
        s = F.regexp_replace(s, f"^(?:{quoted})+", "")
    if where in ("both", "trailing"):
        s = F.regexp_replace(s, f"(?:{quoted})+$", "")
    return s


def repeat(s: Column, n: int) -> Column:
    return F.repeat(s, n)


def space(n: int) -> Column:
    return F.lit(" " * max(n, 0))


def strcmp(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def quote(s: Column) -> Column:
    escaped = F.regexp_replace(s, r"([\\'])", r"\\$1")
    return F.coalesce(F.concat(F.lit("'"), escaped, F.lit("'")), F.lit("NULL"))


def format_(x: Column, digits: int) -> Column:
    return F.format_number(x, digits)


def bin_(x: Column) -> Column:
    return F.bin(x.cast("long"))


def oct_(x: Column) -> Column:
    return F.conv(x.cast("string"), 10, 8)


def soundex(s: Column) -> Column:
    """Of any length, at least four characters: vowels dropped, equal neighbours merged."""
    letters = F.regexp_replace(F.upper(s), "[^A-Z]", "")
    codes = F.translate(letters, "BFPVCGJKQSXZDTLMNRAEIOUYHW", "11112222222233455600000000")
    merged = F.regexp_replace(codes, r"0", "")
    first = F.translate(F.left(letters, F.lit(1)), "BFPVCGJKQSXZDTLMNR", "111122222222334556")
    merged = F.regexp_replace(merged, r"(.)\1+", "$1")
    tail = F.when(F.left(merged, F.lit(1)) == first, F.substring(merged, 2, 1 << 30)).otherwise(merged)
    out = F.concat(F.left(letters, F.lit(1)), tail)
    return F.when(F.char_length(letters) == 0, "").when(F.char_length(out) < 4, F.rpad(out, 4, "0")).otherwise(out)


def regexp(s: Column, pattern: str) -> Column:
    """REGEXP: found anywhere, case-blind, with POSIX classes."""
    names = {"alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "space": r"\s", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "punct": r"\p{Punct}", "xdigit": r"\p{XDigit}"}
    for name, java in names.items():
        pattern = pattern.replace(f"[:{name}:]", java)
    return s.rlike(f"(?i){pattern.replace('[[:<:]]', chr(92) + 'b').replace('[[:>:]]', chr(92) + 'b')}")


def like(s: Column, pattern: str, escape: str = "\\") -> Column:
    """LIKE, blind to case."""
    return F.ilike(s, F.lit(pattern), F.lit(escape))


def inet_aton(s: Column) -> Column:
    p = F.split(s, r"\.")
    part = lambda i: F.get(p, F.lit(i)).try_cast("long")
    return F.when((F.size(p) == 4), part(0) * (1 << 24) + part(1) * (1 << 16) + part(2) * (1 << 8) + part(3))


def dotted(n: Column) -> Column:
    """Four parts with dots: the last three have eight bits each, the first has what is left, also beyond 255."""
    n = n.cast("long")
    parts = [F.shiftright(n, 24), *[F.shiftright(n, s).bitwiseAND(F.lit(255)) for s in (16, 8, 0)]]
    return F.when(n.isNotNull(), F.concat_ws(".", *[p.cast("string") for p in parts]))


def inet_ntoa(n: Column) -> Column:
    """NULL for a number that is no address of 32 bits."""
    return F.when(n.cast("long").between(0, (1 << 32) - 1), dotted(n))


def password(s: Column) -> Column:
    return F.when(F.octet_length(s) == 0, "").otherwise(F.concat(F.lit("*"), F.upper(F.sha1(F.unhex(F.sha1(s.cast("binary")))))))


def compress_udf():
    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        import struct
        import zlib

        return texts.map(lambda t: None if t is None else b"" if not t else struct.pack("<I", len(b := t.encode())) + zlib.compress(b))

    return run


def uncompress_udf():
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        import zlib

        def one(v):
            try:
                return None if v is None else "" if not v else zlib.decompress(bytes(v)[4:]).decode()
            except (zlib.error, UnicodeDecodeError):
                return None

        return values.map(one)

    return run


def compress(s: Column) -> Column:
    """Length in four bytes, low byte first, then zlib; needs Python (Arrow batches)."""
    return compress_udf()(s)


def uncompress(b: Column) -> Column:
    """NULL for what isn't compressed text."""
    return uncompress_udf()(b)


def uncompressed_length(b: Column) -> Column:
    low_first = F.concat(*[F.hex(F.substring(b, i, 1)) for i in (4, 3, 2, 1)])
    return F.when(F.octet_length(b) == 0, F.lit(0).cast("long")).otherwise(F.conv(low_first, 16, 10).cast("long"))
