"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

The features of a text: densities of a lexicon (whole words, and word stems of four to six
letters, which catch inflected and compounded forms), how near second-person words stand to its
hits, capitals, exclamation and other marks, and rates of obfuscation (letters mixed with digits
or marks, and lexicon hits once these are undone).

A small fixed lexicon is extended with the model: words and stems that toxic labelled texts use and
others do not.  Scores are calibrated on folds that took no part in learning the lexicon and trees they are scored with.
Lexicon and trees are fitted on at most ``SAMPLE`` labelled rows that are not held out
(a documented bound); every text is scored whole.

Defined results: null and empty texts are scored as texts without words; without labelled rows
of both kinds all scores are the share of toxic ones, or 0.5 if there are none at all; such scores tell no texts apart, as
those from under 20 labelled rows, and :func:`keep_clean` keeps all rows then.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ashlar.llm.boosting import Calibrated
from ashlar.llm.common import give_back, held_out, labelled_sample, stored, table

SAMPLE = 12_000
STEMS = (4, 5, 6)
NEAR = 6
LEXICON = 4_000
FOLDS = 4
FEATURES = 15
#: Least log-likelihood ratio of a term's counts, so that terms are not learnt by chance out of some 100,000.
SURPRISE = 22.0
THRESHOLD = 0.5
CACHE_WORDS = 150_000

WORDS = re.compile(r"[^\W\d_]+")
MIXED = re.compile(r"(?<![^\s])(?=[^\s]*[0-9@$!*#])[^\W\d_]+[0-9@$!*#]+[^\W_][^\s]*")
# Second-person words of the four languages, and what marks stand for.
SECOND_PERSON = frozenset(
    "you your yours yourself u du dich dir dein deine deinen euch ihr tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split()
)
# Words that the lexicon has from the start.
SEED = tuple(
    "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown dumb fool imbecile pig bastard vermin filth "
    "dummkopf trottel abschaum dreckskerl vollidiot imbécile crétin connard ordure abruti imbécil estúpido basura escoria cretino".split()
)
SEED_ODDS = 4.0
UNMASK = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", "#": ""})


class Lexicon(dict):
    """Word -> (log odds, 2 for a whole word or 1 for a stem), (0, 0) if it is not in the lexicon; known words are kept, within a bound."""

    def __init__(self, odds: dict[str, float]):
        super().__init__()
        self.odds = {k: v for k, v in odds.items() if not k.startswith("^")}
        self.stems = {k[1:]: v for k, v in odds.items() if k.startswith("^")}

    def __missing__(self, word: str) -> tuple[float, int]:
        out = (0.0, 0)
        if word in self.odds:
            out = (self.odds[word], 2)
        elif len(word) >= STEMS[0]:
            best = max((self.stems.get(word[:n], 0.0) for n in STEMS), default=0.0)
            out = (best, 1) if best else out
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = out
        return out


def terms(text: str) -> set[str]:
    """Words and, marked by ^, stems of a text."""
    words = set(WORDS.findall(text.lower()))
    return words | {f"^{w[:n]}" for w in words for n in STEMS if len(w) >= n}


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    text = text or ""
    words = WORDS.findall(text.lower())
    n, chars = max(len(words), 1), max(len(text), 1)
    found = list(map(lexicon.__getitem__, words))
    hits = [i for i, x in enumerate(found) if x[1]]
    whole = sum(1 for i in hits if found[i][1] == 2)
    near = sum(1 for i in hits if not SECOND_PERSON.isdisjoint(words[max(0, i - NEAR) : i + NEAR + 1]))
    odds = [found[i][0] for i in hits]
    mixed = MIXED.findall(text) if any(c in text for c in "0123456789@$!*#") else []
    masked = sum(1 for w in mixed if any(lexicon[x][1] for x in WORDS.findall(w.lower().translate(UNMASK))))
    capitals = sum(map(str.isupper, text)) if not text.isascii() else len(text) - len(text.translate(_NO_CAPITALS))
    return [
        whole / n, np.log1p(whole), (len(hits) - whole) / n, np.log1p(len(hits) - whole), sum(odds) / n, max(odds, default=0.0), sum(odds),
        near / max(len(hits), 1), near / n, capitals / chars, text.count("!") / chars, sum(map(text.count, "?%&$#*|")) / chars,
        len(mixed) / n, np.log1p(masked), np.log1p(len(words)),
    ]


_NO_CAPITALS = {c: None for c in range(ord("A"), ord("Z") + 1)}


def learn_lexicons(sample: DataFrame, seed: tuple[str, ...] = SEED) -> list[dict[str, float]]:
    """Terms with the log odds of toxic against other texts, counted by text: without each of ``FOLDS`` folds, then over all.

    Each has at most ``LEXICON`` terms besides ``seed``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts: dict[tuple[int, int], Counter] = {}
            for text, y, k in zip(b["text"], b["y"], b["fold"], strict=True):
                counts.setdefault((int(y > 0), int(k)), Counter()).update(terms(text))
            yield pd.DataFrame([(w, y, k, c) for (y, k), x in counts.items() for w, c in x.items()], columns=["term", "y", "fold", "n"])
            counts.clear()
        give_back()

    sizes = {(int(r["y"]), r["fold"]): r["n"] for r in sample.groupBy((F.col("y") > 0).cast("int").alias("y"), "fold").agg(F.count("*").alias("n")).collect()}
    found = sample.mapInPandas(run, "term string, y int, fold int, n long")
    part = lambda y, k: F.sum(F.when((F.col("y") == y) & (F.col("fold") != k), F.col("n")).otherwise(0))
    counted = found.groupBy("term").agg(*[part(y, k).alias(f"{'ct'[y]}{k}") for y in (0, 1) for k in range(FOLDS + 1)]).where(f"t{FOLDS} >= 3")
    counted = stored(counted, "toxic-terms")
    out = []
    for k in range(FOLDS + 1):  # no row is in the last fold: it leaves none out
        toxic, other = (sum(n for (y, f), n in sizes.items() if y == label and f != k) for label in (1, 0))
        learnt: dict[str, float] = {}
        if toxic and other:
            t, c = F.col(f"t{k}"), F.col(f"c{k}")
            expected = lambda n, share: F.when(n > 0, n * F.log(n / ((t + c) * F.lit(share)))).otherwise(0.0)  # noqa: B023, E731
            surprise = 2 * (expected(t, toxic / (toxic + other)) + expected(c, other / (toxic + other)))
            odds = F.log((t + 0.5) / (toxic + 1)) - F.log((c + 0.5) / (other + 1))
            kept = counted.where(t >= 3).withColumn("odds", odds).where((F.col("odds") >= 3) & (surprise >= SURPRISE)).orderBy(F.desc("odds"), "term").limit(LEXICON)
            learnt = {r["term"]: float(r["odds"]) for r in kept.select("term", "odds").collect()}
        out.append(dict.fromkeys(seed, SEED_ODDS) | learnt)
    return out


class Model:
    def __init__(self, odds: dict[str, float], trees: Calibrated):
        self.odds, self.trees = odds, trees

    def scores(self, texts, lexicon: Lexicon) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        return self.trees.score(np.array([features(t, lexicon) for t in texts], dtype=float))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, seed: tuple[str, ...] = SEED) -> Model:
    """Lexicon and trees over all of the sample; the calibration is learnt on folds that neither lexicon nor trees have seen."""
    sample = labelled_sample(docs, labels, "toxic", rows, "toxic-sample").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(FOLDS)).cast("int"))
    lexicons = learn_lexicons(sample, seed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [Lexicon(odds) for odds in lexicons]
        for b in batches:
            found = []
            for lexicon in held:  # one after the other, so that one alone has its known words in memory
                found.append(np.array([features(t, lexicon) for t in b["text"]], dtype=float).reshape(len(b), FEATURES))
                lexicon.clear()
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": (b["y"] > 0).astype(int), "fold": b["fold"], "x": list(np.concatenate(found, axis=1))})
        give_back()

    # at most ``rows`` rows of 15 numbers for each lexicon
    got = sample.mapInPandas(run, "doc_id long, y int, fold int, x array<double>").toPandas().sort_values("doc_id")
    x = np.array(got["x"].tolist(), dtype=float).reshape(len(got), FOLDS + 1, FEATURES)
    trees = Calibrated(folds=FOLDS).fit(x[:, FOLDS], got["y"].to_numpy(dtype=float), got["fold"].to_numpy(), [x[:, k] for k in range(FOLDS)])
    return Model(lexicons[FOLDS], trees)


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, toxicity) for every row of ``docs``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(model.odds)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "toxicity": model.scores(b["text"], lexicon)})
        lexicon.clear()
        give_back()

    return docs.selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text").mapInPandas(run, "doc_id long, toxicity double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with its columns, whose score is below ``threshold``; all of them if no trees could be fitted."""
    if model.trees.trees is None:
        return docs

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = Lexicon(model.odds)
        for texts in batches:
            yield pd.Series(model.scores(texts, lexicon))
        lexicon.clear()
        give_back()

    return docs.where(toxicity(F.col(text)) < threshold)


def op10_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs, fit(docs, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted")
    )


QUERIES = {"op10_boosted_toxicity": op10_boosted_toxicity}
