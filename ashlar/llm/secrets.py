"""Secret scans over a trigram inverted index, in DataFrame and SQL functions only.

1. Each rule's regular expression gives a Boolean query of trigrams (:mod:`regex_trigrams`): ways, each of which asks for all of its trigrams.
2. The index holds the postings (trigram, text) of the trigrams asked for, sorted by trigram, so that reading some of them skips the rest.
   It is written once and serves any rules whose trigrams it has.  Texts are known by (id, 64-bit hash of the text), so that rows that repeat are one.
3. Postings are intersected by joins, the rarest trigram of a way first, by the index's own counts: its texts alone are
   looked up in the postings of the others, but for those more than ``LONGER`` times as long.
4. Candidates' texts are verified by the rule's own expression.  A rule without mandatory
   trigrams (``hex``) is run over every text.
5. Positions come from ``split`` and ``regexp_extract_all``, whose pieces alternate: a match starts
   after all pieces and matches before it.  These are laid out as rows and summed up by window functions, so that
   a text with many matches takes no more time for each.  ``length`` counts code points.

Defined results: a null text is an empty one and has no spans; texts of any length are scanned
whole; rows that repeat each give their row; no rows give no rows; other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ashlar.llm.common import stored, table
from ashlar.llm.regex_trigrams import check, trigram_query


@dataclass(frozen=True)
class Rule:
    """``least`` characters in ``group`` are asked of a match; failing matches are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1

    def __post_init__(self):
        check(self.pattern)


def _either(word: str) -> str:
    return "".join(f"[{x.upper()}{x}]" if x.isalpha() else x for x in word)


ASSIGN = "|".join(_either(x) for x in ("password", "passwd", "secret", "token")) + f"|{_either('api')}_?{_either('key')}"
BASE = (
    Rule("assign", rf"""({ASSIGN})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    # a run of 16 or more: the same as the runs of [0-9a-f]+ that have 16 characters
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Spans that the method adds: rules with mandatory trigrams.
ADDED = (
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
RULES = BASE + ADDED
#: Trigrams of one way that are asked for: the bits of a long.
MOST_GRAMS = 62
LONGER = 8
SPANS = "array<struct<start:bigint,kind:int,end:bigint,before:bigint>>"


def postings(texts: DataFrame, grams: list[str]) -> DataFrame:
    """The index: (id, h, lower) -> (gram, id, h) for the given trigrams, sorted by trigram in each file."""
    there = [F.when(F.contains("lower", F.lit(g)), F.lit(g)) for g in grams]
    found = texts.select("id", "h", F.explode(F.array_compact(F.array(*there))).alias("gram"))
    return stored(found.select("gram", "id", "h").sortWithinPartitions("gram"), "secret-postings")


def candidates(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(id, h, kinds): the texts that meet the trigram query of at least one rule."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    grams = sorted({g for q in queries.values() for way in q for g in way})
    if not grams:
        return texts.select("id", "h", F.array(F.lit("")).alias("kinds")).where("false")
    index = postings(texts, grams)
    # one number for each trigram that the rules name
    often = {r["gram"]: r["n"] for r in index.groupBy("gram").agg(F.count("*").alias("n")).collect()}
    rows, kinds = [], []
    for kind, q in queries.items():
        for asked in q:
            asked = sorted(asked, key=lambda g: (often.get(g, 0), g))
            # lists far longer than the rarest's rule little out: the expression decides in any case
            asked = [g for g in asked if often.get(g, 0) <= LONGER * often.get(asked[0], 0)][:MOST_GRAMS]
            rows += [(len(kinds), g, 1 << i, i == 0) for i, g in enumerate(asked)]
            kinds.append((len(kinds), kind, (1 << len(asked)) - 1))
    # a row for each trigram of each way of the rules, and one for each way
    ways = F.broadcast(index.sparkSession.createDataFrame(rows, "way int, gram string, bit long, rarest boolean"))
    kinds = F.broadcast(index.sparkSession.createDataFrame(kinds, "way int, kind string, full long"))
    listed = index.join(ways, "gram").select("way", "bit", "rarest", "id", "h")
    first, others = listed.where("rarest").drop("rarest"), listed.where("NOT rarest").drop("rarest")
    both = first.unionByName(others.join(first.select("way", "id", "h").distinct(), ["way", "id", "h"], "left_semi"))
    met = both.groupBy("way", "id", "h").agg(F.bit_or("bit").alias("held")).join(kinds, "way").where("held = full")
    return met.groupBy("id", "h").agg(F.collect_set("kind").alias("kinds"))


def matches_of(text: Column, rule: Rule) -> Column:
    """An array of (gap, size, long): characters since the match before, those of the match, and whether it counts; NULL for none."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = whole if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    pieces = F.split(text, rule.pattern, -1)
    steps = F.arrays_zip(whole.alias("m"), tested.alias("g"), F.slice(pieces, F.lit(1), F.size(whole)).alias("p"))
    found = F.transform(steps, lambda x: F.struct(F.length(x["p"]).alias("gap"), F.length(x["m"]).alias("size"), (F.length(x["g"]) >= rule.least).alias("long")))
    return F.when(F.regexp_like(text, pattern), found)


def _laid_out(texts: DataFrame, rules: list[tuple[int, Rule]], asked=lambda rule: F.lit(True)) -> DataFrame:
    """(id, h, text) -> (id, h, kind, pos, gap, size, long), a row for each match."""
    per_rule = [F.when(asked(r), F.struct(F.lit(i).alias("kind"), matches_of(F.col("text"), r).alias("found"))) for i, r in rules]
    some = texts.select("id", "h", F.explode(F.filter(F.array(*per_rule), lambda x: x["found"].isNotNull())).alias("x"))
    return some.select("id", "h", "x.kind", F.posexplode("x.found").alias("pos", "m")).select("id", "h", "kind", "pos", "m.gap", "m.size", "m.long")


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rules: tuple[Rule, ...] = RULES, keep: list[str] | None = None) -> DataFrame:
    """Every row of ``docs``, its columns ``keep`` (all by default) as struct ``row``, with ``spans``: an array of (start, kind, end, before).

    ``kind`` is the rule's place in ``rules``, ``before`` the greatest end of the spans that come before.
    """
    base = docs.select(
        F.struct(*(["*"] if keep is None else [F.col(f"`{c}`") for c in keep])).alias("row"),
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).withColumn("h", F.xxhash64("text"))
    full = [(i, r) for i, r in enumerate(rules) if trigram_query(r.pattern) is None]
    indexed = [(i, r) for i, r in enumerate(rules) if (i, r) not in full]
    texts = base.select("id", "h", "text")

    parts = []
    if indexed:
        found = stored(candidates(texts.select("id", "h", F.lower("text").alias("lower")), tuple(r for _, r in indexed)), "secret-candidates")
        # only the candidates' texts are verified; the planner broadcasts the candidates where their written size allows
        parts.append(_laid_out(texts.join(found, ["id", "h"]), indexed, lambda r: F.array_contains("kinds", r.kind)))
    if full:
        parts.append(_laid_out(texts, full))
    matches = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # rows that repeat give the same matches; what is sorted together is one text's
    matches = matches.distinct().repartition("id", "h")
    upto = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("id", "h", "kind").orderBy("pos"))
    spans = matches.withColumn("end", upto).where("long").select("id", "h", (F.col("end") - F.col("size")).alias("start"), "kind", "end")
    earlier = Window.partitionBy("id", "h").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("before", F.coalesce(F.max("end").over(earlier), F.lit(0)))
    spans = spans.groupBy("id", "h").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "before"))).alias("spans"))
    b, v = base.select("row", "id", "h").alias("b"), stored(spans, "secret-spans").alias("v")
    both = b.join(v, (F.col("b.id") == F.col("v.id")) & (F.col("b.h") == F.col("v.h")), "left")
    return both.select("b.row", F.coalesce("v.spans", F.array().cast(SPANS)).alias("spans"))


def as_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def redact(text: Column, spans: Column, mask: str = "*") -> Column:
    """The text with every code point of the spans masked.

    Pieces are cut from the text in four bytes a character, where a place is found at once; a mark of the byte order
    stands before each, so that a text's own is kept.
    """
    cut = lambda raw, at, n: F.decode(F.concat(F.lit(bytes([0, 0, 0xFE, 0xFF])), F.substring(raw, (at * 4 + 1).cast("int"), (n * 4).cast("int"))), "UTF-32")

    def masked(raw: Column) -> Column:
        piece = lambda x: F.concat(
            cut(raw, x["before"], F.greatest(x["start"] - x["before"], F.lit(0))),
            F.repeat(F.lit(mask), (x["end"] - F.greatest(x["start"], x["before"])).cast("int")),
        )
        pieces = F.transform(F.filter(spans, lambda x: x["end"] > x["before"]), piece)
        last = F.array_max(F.transform(spans, lambda x: x["end"]))
        return F.concat(F.array_join(pieces, ""), cut(raw, last, F.octet_length(raw) / 4 - last))

    return F.when(F.size(spans) > 0, _let(F.encode(text, "UTF-32"), masked)).otherwise(text)


def op4_trigram_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the texts don't travel: ids and hashes alone meet the spans
    found = scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    n = lambda i: F.size(F.filter("spans", lambda x: x["kind"] == i)).cast("long")
    base = as_text(F.filter("spans", lambda x: x["kind"] < len(BASE)))
    return found.select(
        "row.doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"),
    )


def _sql() -> str:
    parts = []
    for i, r in enumerate(RULES):
        pattern = r.pattern.replace("'", "''")
        parts.append(
            f"""SELECT n, {i} AS kind, '{r.kind}' AS name, unnest(regexp_extract_all(text, '{pattern}', 0)) AS m,
                unnest(regexp_extract_all(text, '{pattern}', {r.group})) AS g,
                unnest(string_split_regex(text, '{pattern}')[:len(regexp_extract_all(text, '{pattern}', 0))]) AS p,
                unnest(range(len(regexp_extract_all(text, '{pattern}', 0)))) AS i, {r.least} AS least FROM d"""
        )
    return f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(parts)}),
s AS (
  SELECT *, sum(length(p) + length(m)) OVER (PARTITION BY n, kind ORDER BY i) AS e FROM m),
k AS (SELECT n, kind, name, (e - length(m))::BIGINT AS s, e::BIGINT AS e, name || ':' || (e - length(m))::BIGINT || ':' || e::BIGINT AS t FROM s WHERE length(g) >= least),
a AS (
  SELECT n, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         coalesce(string_agg(t, ',' ORDER BY s, kind) FILTER (kind < {len(BASE)}), '') AS base, string_agg(t, ',' ORDER BY s, kind) AS spans
  FROM k GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (n)
"""


QUERIES = {"op4_trigram_index": op4_trigram_index}
ORACLES = {"op4_trigram_index": _sql()}
