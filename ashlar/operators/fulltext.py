"""MATCH .. AGAINST: natural language scores and Boolean mode, as DataFrame operations.

A word's weight in a row is ``log(tf) + 1``; a row's weights are divided by their mean for its
number of distinct words and by the pivot ``1 + 0.0115 * distinct words``; a query word counts
``log((N - df) / df)`` in the whole collection, and not at all where more than half of the rows
have it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_']+"
LEAST, MOST = 4, 84
PIVOT = 0.0115


def words(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.filter(found, lambda w: F.char_length(w).between(least, most))


def log_weights(held: Column) -> Column:
    """The sum of ``log(tf) + 1`` over the distinct words of an array, by sorting it and measuring runs: each word is looked at once."""

    def over_runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return F.get(F.transform(F.array(starts), lambda b: _logs_of(b, F.size(s))), 0)

    # an array of one element binds the sorted words, so that they are sorted once
    return F.when(F.size(held) == 0, F.lit(0.0)).otherwise(F.get(F.transform(F.array(F.array_sort(held)), over_runs), 0))


def _logs_of(starts: Column, n: Column) -> Column:
    runs = F.zip_with(starts, F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(n)), lambda a, b: b - a)
    return F.aggregate(runs, F.lit(0.0), lambda total, tf: total + F.log(tf.cast("double")) + 1)


def match_natural(df: DataFrame, key: str, text: str, query: str, stopwords: frozenset[str] = frozenset(), parser=words) -> DataFrame:
    """(key, score) of rows with a score above 0.  ``parser`` makes the array of words of a text: the parser plug-in.

    Only the query's words are exploded, so that what is shuffled is a few rows for each row that
    has them; statistics are over all rows.
    """
    wanted = sorted({w for w in re.findall(r"[\w']+", query.lower()) if LEAST <= len(w) <= MOST} - stopwords)
    rows = df.select(F.col(key).alias("key"), parser(F.col(text)).alias("w"))
    distinct = F.array_distinct("w")
    counts = lambda x: F.size(F.filter(F.col("w"), lambda y: y == x))
    if not wanted:
        return rows.select(F.col("key").alias(key), F.lit(0.0).alias("score")).where("false")
    shaped = rows.withColumn("u", distinct).withColumn("n", F.size("u")).withColumn("hits", F.array_intersect("u", F.array(*map(F.lit, wanted))))
    shaped = shaped.withColumn("logs", F.when(F.size("hits") > 0, log_weights(F.col("w"))))
    hits = shaped.where(F.size("hits") > 0).select("key", "n", "logs", F.explode(F.transform("hits", lambda x: F.struct(x.alias("word"), counts(x).alias("tf")))).alias("h"))
    hits = hits.select("key", "h.word", ((F.log(F.col("h.tf").cast("double")) + 1) / F.col("logs") * F.col("n") / (1 + PIVOT * F.col("n"))).alias("weight"))
    df_ = hits.groupBy("word").agg(F.count("*").alias("df"))  # a row for each query word
    total = df.agg(F.count("*").alias("total"))
    idf = df_.crossJoin(total).where(F.col("df") * 2 <= F.col("total")).select("word", F.log((F.col("total") - F.col("df")) / F.col("df")).alias("idf"))
    scored = hits.join(F.broadcast(idf), "word").groupBy("key").agg(F.sum(F.col("weight") * F.col("idf")).alias("score"))
    return scored.where("score > 0").select(F.col("key").alias(key), "score")


def _begins(held: Column, prefix: str) -> Column:
    return F.exists(held, lambda w: F.startswith(w, F.lit(prefix)))


def boolean_condition(text: Column, query: str) -> Column:
    """Boolean mode: ``+must -not word* "a phrase" (group)``; ``> < ~`` only change the rank and are read over here, and counted by :func:`boolean_score`."""
    low = F.lower(F.coalesce(text, F.lit("")))
    held = words(text, least=1)
    tokens = re.findall(r'\s*([+\-~<>]*)(?:"([^"]*)"|\(([^)]*)\)|([^\s()"]+))', query.lower())
    must, may, never = [], [], []
    for sign, phrase, group, word in tokens:
        if phrase:
            part = F.regexp_like(low, F.lit(r"(?<![\p{L}\p{N}_'])" + r"[^\p{L}\p{N}_']+".join(map(re.escape, phrase.split())) + r"(?![\p{L}\p{N}_'])"))
        elif group:
            part = boolean_condition(text, group)
        elif word.endswith("*"):
            part = _begins(held, word[:-1])
        else:
            part = F.array_contains(held, word)
        (must if "+" in sign else never if "-" in sign else may).append(part)
    out = F.lit(True)
    for c in must:
        out = out & c
    for c in never:
        out = out & ~c
    if may and not must:
        some = may[0]
        for c in may[1:]:
            some = some | c
        out = out & some
    return out if must or may else F.lit(False)


#: What a word counts that is raised by ``>`` or lowered by ``<`` once.
RAISED, LOWERED, NEGATED = 1.5, 0.66666666666667, -0.5


def boolean_score(text: Column, query: str) -> Column:
    """The rank of a row that meets ``query`` in Boolean mode, 0 for others.

    Every word found counts 1, ``>`` and ``<`` make that more or less, ``~`` takes some off; the weights of words that must be
    there are divided by their number.  Parts in parentheses count as the sum of their words.
    """
    held = words(text, least=1)
    tokens = re.findall(r'\s*([+\-~<>]*)(?:"([^"]*)"|\(([^)]*)\)|([^\s()"]+))', query.lower())
    musts = max(sum("+" in sign for sign, *_ in tokens), 1)
    total = F.lit(0.0)
    for sign, phrase, group, word in tokens:
        if "-" in sign:
            continue
        weight = (NEGATED if "~" in sign else 1.0) * RAISED ** sign.count(">") * LOWERED ** sign.count("<") / (musts if "+" in sign else 1)
        if group:
            total = total + boolean_score(text, group) * weight
        else:
            part = boolean_condition(text, f'"{phrase}"') if phrase else _begins(held, word[:-1]) if word.endswith("*") else F.array_contains(held, word)
            total = total + F.when(part, F.lit(weight)).otherwise(F.lit(0.0))
    return F.when(boolean_condition(text, query), total).otherwise(F.lit(0.0))
