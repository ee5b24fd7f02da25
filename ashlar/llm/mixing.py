"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target of words (:func:`source_targets`).  Within a source a document of
``b`` binary digits in its size has the expected number of copies ``q = min(cap, c * b)``: longer
documents are worth more copies, and ``c`` is solved so that ``sum(q * size)`` is the target.
``floor(q)`` copies are certain.  For the rest the document has the inclusion probability
``p = q - floor(q)``, and documents are ranked by Pareto's ratio ``(u / (1 - u)) / (p / (1 - p))``
with a uniform ``u`` from a hash of the id; they are taken in that order up to the number of
words still wanted (the order's prefix whose sum is nearest to it), so that the sample's size is
fixed, not random.

Everything is DataFrame code.  Sizes are written once, with what ranks a document, and the decisions are made from them.
A source may hold any share of all rows: sums are first taken by
(source, digits) or by (source, slice of the ranking), both of a fixed number of groups a source,
and only the one slice in which the order is cut is ranked.  What comes of it is one row for each
source and number of digits, which the documents meet in a last pass that moves no text.

Defined results: a null or blank text has size 0 and is never taken; a null source is a source
of its own; rows that repeat an id, null ids included, have ranks of their own, from the id, a hash
of the text and a number among the rows equal in these and the source (the SQL twin, which ranks
by id alone, says the same only where ids differ); no rows give no rows; other columns, whatever their names, pass through inside ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ashlar.llm.common import stored, table

WORD = r"[^\x20\x09-\x0D]+"
CAP = 3
SLICES = 4096
SALTS = 256
#: A table of decisions is broadcast up to so many rows (about 100 bytes each).
BROADCAST_ROWS = 200_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _name(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit("null"))


def uniform(doc_id: Column, seed: int) -> Column:
    """A number strictly between 0 and 1 with 52 random bits, the same in every run."""
    digest = F.md5(F.concat(_name(doc_id), F.lit(f":{seed}")).cast("binary"))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, cap: float = CAP) -> DataFrame:
    """Rows (source, source_size) -> the same with ``target``.

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share the sum of all sizes by
    weight; no target passes ``cap`` times its source's size, the excess going to the others by
    weight.  Sources that are capped are those with the least ``cap * size / weight``, so the share
    for one unit of weight comes from running sums in that order.  One row a source is sorted here.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ratio = F.col("most") / F.col("weight")
    order = Window.orderBy(ratio.asc(), F.col("weight").asc(), F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1).withColumn("most", F.col("source_size") * F.lit(cap))
    ranked = (
        ranked.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("all_weight", F.sum("weight").over(Window.partitionBy()))
        .withColumn("before", F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("share", (F.col("total") - F.col("before")).cast("double") / (F.col("all_weight") - F.col("weight_before")).cast("double"))
        # the first source, in the order of their ratios, that its share does not fill
        .withColumn("fits", F.col("share") * F.col("weight") <= F.col("most"))
    )
    last = ranked.withColumn("unit", F.min_by("share", ratio).over(Window.partitionBy("fits"))).withColumn(
        "unit", F.max(F.when(F.col("fits"), F.col("unit"))).over(Window.partitionBy())
    )
    target = F.when(F.col("unit").isNull(), F.col("most").cast("double")).otherwise(F.least(F.col("unit") * F.col("weight"), F.col("most").cast("double")))
    return last.select("source", "source_size", target.alias("target"))


def _decisions(slim: DataFrame, cap: int, seed: int) -> DataFrame:
    """Rows (name, source, size, digits) -> a row for each source and number of digits: what to do with such documents."""
    levels = stored(slim.groupBy("source", "digits").agg(F.sum("size").alias("words")), "mix-levels")
    targets = source_targets(levels.groupBy("source").agg(F.sum("words").alias("source_size")), cap)

    # documents of the most digits reach the cap first
    down = Window.partitionBy("source").orderBy(F.col("digits").desc())
    capped = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = F.sum(F.col("words") * F.col("digits")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    l, t = levels.withColumn("capped", capped).withColumn("open", open_).alias("l"), targets.alias("t")
    lv = l.join(t, F.col("l.source").eqNullSafe(F.col("t.source"))).select("t.source", "source_size", "target", "digits", "words", "capped", "open")
    lv = lv.withColumn("c", (F.col("target") - cap * F.col("capped")) / F.when(F.col("open") > 0, F.col("open").cast("double")))
    fits = F.col("c") * F.col("digits") <= cap
    lv = lv.withColumn("unit", F.max_by(F.when(fits, F.col("c")), F.when(fits, F.col("digits"))).over(Window.partitionBy("source")))
    q = F.coalesce(F.least(F.lit(float(cap)), F.greatest(F.lit(0.0), F.col("unit") * F.col("digits"))), F.lit(float(cap)))
    lv = lv.withColumn("q", q).withColumn("whole", F.floor("q")).withColumn("p", F.col("q") - F.col("whole"))
    rest = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(Window.partitionBy("source"))
    return stored(lv.select("source", "source_size", "target", "digits", "whole", "p", rest.alias("rest")), "mix-decisions")


def _joined(docs: DataFrame, few: DataFrame, *keys: str) -> DataFrame:
    """``docs`` with the columns of ``few`` (at most a few rows a source), broadcast if these are few indeed."""
    d, f = docs.alias("d"), few.alias("f")
    on = [F.col(f"d.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    f = F.broadcast(f) if few.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else f
    out = d.join(f, on, "left")
    return out.select("d.*", *[f"f.{c}" for c in few.columns if c not in keys])


def _named(base: DataFrame, text: Column) -> DataFrame:
    """``base`` with ``name``, of which the rank is a hash: the id, or for rows that repeat one what tells them apart.

    Rows that repeat an id are written once, so that each keeps its number; their numbers are
    counted within slices, so that no task holds all rows of an id.
    """
    ids = stored(base.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(True).alias("again")), "mix-repeated-ids")
    if ids.isEmpty():
        return base.withColumn("name", _name(F.col("id")))
    marked = _joined(base, ids, "id")
    once = marked.where("again IS NULL").drop("again").withColumn("name", _name(F.col("id")))
    again = marked.where("again").drop("again").withColumn("h", F.xxhash64(text)).withColumn("at", F.monotonically_increasing_id())
    again = stored(again, "mix-repeated").withColumn("salt", F.pmod(F.xxhash64("at"), F.lit(SALTS)))
    equal = ["source", "id", "h"]
    counts = again.groupBy(*equal, "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*equal).orderBy("salt")) - F.col("n")
    before = stored(counts.withColumn("before", before).where("before > 0").drop("n"), "mix-numbers")
    within = F.row_number().over(Window.partitionBy(*equal, "salt").orderBy("at"))
    again = _joined(again.withColumn("within", within), before, *equal, "salt")
    number = F.coalesce("before", F.lit(0)) + F.col("within")
    name = F.concat_ws(":", _name(F.col("id")), F.col("h").cast("string"), number.cast("string"))
    return once.unionByName(stored(again.withColumn("name", name).select(*once.columns), "mix-named"))


def _ranked(slim: DataFrame, seed: int) -> DataFrame:
    u = uniform(F.col("name"), seed)
    xi = F.when((F.col("p") > 0) & (F.col("size") > 0), (u / (1 - u)) * ((1 - F.col("p")) / F.col("p")))
    return slim.withColumn("xi", xi)


def _cuts(ranked: DataFrame) -> DataFrame:
    """(source, cut): documents whose ratio is at most ``cut`` are taken once more."""
    ranked = ranked.where("xi IS NOT NULL").withColumn("slice", F.floor(F.col("xi") / (1 + F.col("xi")) * SLICES))
    slices = stored(ranked.groupBy("source", "slice").agg(F.sum("size").alias("words"), F.first("rest").alias("rest")), "mix-slices")
    run = F.sum("words").over(Window.partitionBy("source").orderBy("slice"))
    slices = slices.withColumn("before", run - F.col("words"))
    at = F.max_by(F.struct("slice", "before"), F.when((F.col("before") < F.col("rest")) | (F.col("before") == 0), F.col("slice")))
    found = stored(slices.groupBy("source").agg(at.alias("at")).select("source", F.col("at.slice").alias("at"), "at.before"), "mix-at")
    peers = _joined(ranked, found, "source").where("slice = at").groupBy("source", "xi").agg(
        F.sum("size").alias("words"), F.first("before").alias("before"), F.first("rest").alias("rest")
    )
    upto = F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("xi"))
    # the last one taken is the one whose middle lies within the words wanted
    inside = peers.withColumn("taken", upto - F.col("words") / 2 <= F.col("rest"))
    last = inside.groupBy("source").agg(F.max(F.when(F.col("taken"), F.col("xi"))).alias("last"))
    # if none of that slice is taken, all of the slices before it are
    edge = F.col("at") / F.lit(float(SLICES))
    below = found.select("source", (edge / (1 - edge) * (1 - 1e-12)).alias("edge"))
    l, b = last.alias("l"), below.alias("b")
    return l.join(b, F.col("l.source").eqNullSafe(F.col("b.source"))).select("l.source", F.coalesce("last", "edge").alias("cut"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", cap: int = CAP, seed: int = 17) -> DataFrame:
    """Every row of ``docs`` as struct ``row``, with size, source_size, target, copies and taken.

    ``copies`` is how often the mix takes the document, ``taken`` its words, repeats counted.
    """
    base = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"))
    base = base.withColumn("digits", F.length(F.bin("size")))
    base = _named(base, F.col("row").getField(text))
    # words are counted twice in all: here, for all decisions, and where the documents meet them
    slim = stored(base.select("name", "source", "size", "digits"), "mix-sizes")
    decisions = _decisions(slim, cap, seed)
    ranked = _ranked(_joined(slim, decisions, "source", "digits"), seed)
    cuts = stored(_cuts(ranked), "mix-cuts")
    out = _ranked(_joined(_joined(base, decisions, "source", "digits"), cuts, "source"), seed)
    extra = F.coalesce(F.col("xi") <= F.col("cut"), F.lit(False)).cast("long")
    copies = F.when(F.col("size") > 0, F.col("whole").cast("long") + extra).otherwise(F.lit(0).cast("long"))
    return out.select("row", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op9_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("row.doc_id", "size", "source_size", "target", "copies", "taken")


SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
e AS (SELECT *, length(bin(size)) AS digits FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM e GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1 AS weight, source_size * {CAP} AS most FROM s),
r AS (
  SELECT *, most / weight AS ratio, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight,
         coalesce(sum(most) OVER o, 0) AS gone, coalesce(sum(weight) OVER o, 0) AS weight_gone FROM w
  WINDOW o AS (ORDER BY most / weight, weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (total - gone)::DOUBLE / (all_weight - weight_gone)::DOUBLE AS share FROM r),
c AS (SELECT min_by(share, ratio) AS unit FROM f WHERE share * weight <= most),
t AS (SELECT source, source_size, CASE WHEN unit IS NULL THEN most::DOUBLE ELSE least(unit * weight, most::DOUBLE) END AS target FROM f, c),
l AS (SELECT source, digits, sum(size) AS words FROM e GROUP BY ALL),
m AS (
  SELECT l.*, t.source_size, t.target,
         coalesce(sum(words) OVER (PARTITION BY l.source ORDER BY digits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(words * digits) OVER (PARTITION BY l.source ORDER BY digits DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM l JOIN t ON l.source IS NOT DISTINCT FROM t.source),
n AS (SELECT *, (target - {CAP} * capped) / nullif(open, 0)::DOUBLE AS c FROM m),
u AS (SELECT source, max_by(c, digits) AS unit FROM n WHERE c * digits <= {CAP} GROUP BY source),
q AS (
  SELECT n.*, coalesce(least({CAP}::DOUBLE, greatest(0::DOUBLE, u.unit * digits)), {CAP}) AS q
  FROM n LEFT JOIN u ON n.source IS NOT DISTINCT FROM u.source),
p AS (SELECT *, floor(q) AS whole, q - floor(q) AS p, target - sum(floor(q) * words) OVER (PARTITION BY source) AS rest FROM q),
x AS (
  SELECT e.*, p.source_size, p.target, p.whole, p.p, p.rest,
         ((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':17'), 1, 13))::UBIGINT)::DOUBLE + 0.5) / 4503599627370496::DOUBLE AS u
  FROM e JOIN p ON e.source IS NOT DISTINCT FROM p.source AND e.digits = p.digits),
y AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) * ((1 - p) / p) END AS xi FROM x),
z AS (SELECT source, xi, sum(size) AS words, any_value(rest) AS rest FROM y WHERE xi IS NOT NULL GROUP BY source, xi),
g AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY xi) AS upto FROM z),
k AS (SELECT source, max(xi) AS cut FROM g WHERE upto - words / 2 <= rest GROUP BY source)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM (
  SELECT y.*, CASE WHEN size > 0 THEN whole::BIGINT + (coalesce(xi <= cut, false))::BIGINT ELSE 0 END AS copies
  FROM y LEFT JOIN k ON y.source IS NOT DISTINCT FROM k.source)
"""
QUERIES = {"op9_pareto_mix": op9_pareto_mix}
ORACLES = {"op9_pareto_mix": SQL}
