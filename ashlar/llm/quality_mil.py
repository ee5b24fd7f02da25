"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of some 400 bytes, all of it, cut at white space.  A passage is
described by the densities of classes of characters in it, of repeats and of changes between
classes, and by how much of it repeats lines and words that came before.  An encoder (one layer,
tanh) makes a vector of it, gated attention ``softmax(w . (tanh(V h) * sigmoid(U h)))`` weighs
the document's passages, and a logistic unit scores the weighted vector.  All weights are learnt
together, from document labels alone, by Adam over whole bags; Platt's two parameters, fitted on
a fifth of the sample that was kept back, calibrate the score.

The model is fitted on at most ``SAMPLE`` labelled rows that are not held out, and on at most ``FIT_PASSAGES`` passages of
each (documented bounds); every text is scored whole.

Defined results: null and empty texts are one empty passage; without labelled rows of both kinds
all scores are the share of label 1, or 0.5 if there are none at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ashlar.llm.common import held_out, labelled_sample, table

SAMPLE = 6_000
#: Passages of one document that the model is fitted on: those whose numbers have the least hashes.  All are scored.
FIT_PASSAGES = 64
PASSAGE = 400
THRESHOLD = 0.3

#: Classes of bytes: each of these marks has its own, then letters, digits, white space, others.
MARKS = ".,;:!?|%&$#*/\\<>=_-+@'\"()[]{}"


def _classes() -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[ord("a") : ord("z") + 1], out[ord("A") : ord("Z") + 1], out[ord("0") : ord("9") + 1] = 1, 2, 3
    out[ord(" ")], out[ord("\n")], out[0x80:0xC0], out[0xC0:0x100] = 4, 5, 6, 7
    for i, m in enumerate(MARKS):
        out[ord(m)] = 8 + i
    return out


CLASS = _classes()
CLASSES = 8 + len(MARKS)
FEATURES = CLASSES + 9


def passages(text: str | None) -> np.ndarray:
    """A row of ``FEATURES`` numbers for each passage."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)
    n = len(raw)
    if n == 0:
        return np.zeros((1, FEATURES))
    kind = CLASS[raw]
    space = (kind == 4) | (kind == 5)
    # cut at the first white space after each multiple of PASSAGE, or there itself, between characters, if the next blank is far
    at, goal = np.flatnonzero(space), np.arange(PASSAGE, n, PASSAGE)
    cuts = np.concatenate((at, [n]))[np.searchsorted(at, goal)]
    far = cuts - goal > PASSAGE
    for _ in range(3):
        goal = goal + ((raw[np.minimum(goal, n - 1)] & 0xC0) == 0x80)
    cuts = np.unique(np.where(far, goal, cuts))
    cuts = cuts[cuts < n]
    starts = np.concatenate(([0], cuts)).astype(np.int64)
    size = np.diff(np.concatenate((starts, [n])))
    which = np.repeat(np.arange(len(starts)), size)
    share = np.bincount(which * CLASSES + kind, minlength=len(starts) * CLASSES).reshape(-1, CLASSES) / size[:, None]
    per = lambda flags: np.add.reduceat(flags.astype(np.float64), starts) / size
    before = np.concatenate(([0], kind[:-1]))
    same = np.concatenate(([False], raw[1:] == raw[:-1]))
    begins = np.concatenate(([True], space[:-1])) & ~space
    # words as 64-bit hashes: how many came before
    first = np.flatnonzero(begins)
    fresh = np.zeros(n)
    seen_lines = np.zeros(n)
    twice = np.zeros(n)
    if len(first):
        ends = np.flatnonzero(np.concatenate((~space[:-1] & space[1:], [~space[-1]]))) + 1
        mixed = (raw.astype(np.uint64) + np.uint64(1)) * _powers(n)
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mixed, dtype=np.uint64)))
        words = (total[ends] - total[first]) * _inverse(n)[first]
        _, index = np.unique(words, return_index=True)
        fresh[first[index]] = 1
        twice[first[1:][words[1:] == words[:-1]]] = 1
        stops = np.flatnonzero(kind == 5)
        heads, tails = np.concatenate(([0], stops + 1)), np.concatenate((stops, [n]))
        real = tails > heads
        heads, tails = heads[real], tails[real]
        lines = (total[tails] - total[heads]) * _inverse(n)[heads]
        _, index = np.unique(lines, return_index=True)
        again = np.setdiff1d(np.arange(len(heads)), index)
        seen_lines[heads[again]] = (tails - heads)[again]
    more = np.stack(
        [
            per(same), per(begins), np.add.reduceat(twice, starts) / np.maximum(np.add.reduceat(begins.astype(np.float64), starts), 1),
            np.add.reduceat(fresh, starts) / np.maximum(np.add.reduceat(begins.astype(np.float64), starts), 1),
            np.minimum(np.add.reduceat(seen_lines, starts) / size, 4), per((kind == 2) & (before == 2)), per((kind >= 8) & (before >= 8)),
            per((kind >= 8) & (before == 1)), np.full(len(starts), np.log1p(n) / 10),
        ],
        axis=1,
    )
    return np.concatenate((share, more), axis=1)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_TABLES: dict[str, np.ndarray] = {}
KEPT = 1 << 22


def _power_table(name: str, base: np.uint64, n: int) -> np.ndarray:
    if name not in _TABLES or len(_TABLES[name]) < n + 1:
        size = 1 << max(16, (n + 1).bit_length())
        step = np.full(size, base, dtype=np.uint64)
        step[0] = 1
        table = np.multiply.accumulate(step)
        if size > KEPT:  # a very long text's table is let go with the text
            return table
        _TABLES[name] = table
    return _TABLES[name]


def _powers(n: int) -> np.ndarray:
    """base^0 .. base^(n-1), modulo 2^64."""
    return _power_table("up", _BASE, n)[:n]


def _inverse(n: int) -> np.ndarray:
    """Powers of the base's inverse, which bring sums that begin anywhere to one footing."""
    return _power_table("down", np.uint64(pow(int(_BASE), -1, 1 << 64)), n)


class AttentionMIL:
    def __init__(self, hidden: int = 24, attention: int = 12, epochs: int = 250, rate: float = 0.02, decay: float = 1e-4, seed: int = 5):
        self.hidden, self.attention, self.epochs, self.rate, self.decay, self.seed = hidden, attention, epochs, rate, decay, seed

    def fit(self, bags: list[np.ndarray], y: np.ndarray) -> AttentionMIL:
        self.constant = float(y.mean()) if len(y) else 0.5
        self.p = None
        if len(y) < 20 or y.min() == y.max():
            return self
        rng = np.random.default_rng(self.seed)
        x = np.concatenate(bags)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        d, h, a = x.shape[1], self.hidden, self.attention
        self.p = {
            "W": rng.normal(0, d**-0.5, (d, h)), "b": np.zeros(h), "V": rng.normal(0, h**-0.5, (h, a)), "U": rng.normal(0, h**-0.5, (h, a)),
            "w": rng.normal(0, a**-0.5, a), "c": rng.normal(0, h**-0.5, h), "e": np.array([np.log(self.constant / (1 - self.constant))]),
        }
        fold = np.arange(len(y)) % 5 == 0
        self._train([b for b, f in zip(bags, fold, strict=True) if not f], y[~fold])
        kept = self._margins([b for b, f in zip(bags, fold, strict=True) if f])
        self.platt = _platt(kept, y[fold])
        return self

    def _forward(self, x: np.ndarray, starts: np.ndarray, which: np.ndarray):
        p = self.p
        hid = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(hid @ p["V"]), 1 / (1 + np.exp(-(hid @ p["U"])))
        s = (t * g) @ p["w"]
        s = np.exp(s - np.maximum.reduceat(s, starts)[which])
        att = s / np.add.reduceat(s, starts)[which]
        z = np.add.reduceat(att[:, None] * hid, starts)
        return hid, t, g, att, z, z @ p["c"] + p["e"][0]

    def _gradient(self, x: np.ndarray, starts: np.ndarray, which: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss over the bags, by every weight."""
        p = self.p
        hid, t, g, att, z, margin = self._forward(x, starts, which)
        dm = (1 / (1 + np.exp(-margin)) - y) / len(y)
        dz = dm[:, None] * p["c"]
        datt = (hid * dz[which]).sum(1)
        ds = att * (datt - np.add.reduceat(att * datt, starts)[which])
        dt, dg = ds[:, None] * p["w"] * g * (1 - t * t), ds[:, None] * p["w"] * t * g * (1 - g)
        dh = (att[:, None] * dz[which] + dt @ p["V"].T + dg @ p["U"].T) * (1 - hid * hid)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": hid.T @ dt, "U": hid.T @ dg, "w": ((t * g) * ds[:, None]).sum(0), "c": z.T @ dm, "e": np.array([dm.sum()])}

    def _train(self, bags: list[np.ndarray], y: np.ndarray) -> None:
        x, starts, which = self._bags(bags)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        p = self.p
        for step in range(1, self.epochs + 1):
            grad = self._gradient(x, starts, which, y)
            for k in p:
                gk = grad[k] + self.decay * p[k]
                m[k] = 0.9 * m[k] + 0.1 * gk
                v2[k] = 0.99 * v2[k] + 0.01 * gk * gk
                p[k] = p[k] - self.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)

    def _bags(self, bags: list[np.ndarray]):
        n = np.array([len(b) for b in bags])
        starts = np.concatenate(([0], np.cumsum(n)[:-1]))
        return (np.concatenate(bags) - self.mean) / self.scale, starts, np.repeat(np.arange(len(bags)), n)

    def _margins(self, bags: list[np.ndarray]) -> np.ndarray:
        return self._forward(*self._bags(bags))[-1]

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if not bags:
            return np.zeros(0)
        if self.p is None:
            return np.full(len(bags), self.constant)
        a, b = self.platt
        return 1 / (1 + np.exp(-np.clip(a * self._margins(bags) + b, -30, 30)))


def _platt(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept by Newton's method, with Platt's softened labels."""
    up, down = y.sum(), len(y) - y.sum()
    soft = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        w = q * (1 - q)
        g = np.array([((q - soft) * margin).sum() + 0.01 * (a - 1), (q - soft).sum()])
        h = np.array([[(w * margin * margin).sum() + 0.01, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return max(float(a), 0.05), float(b)


def fitted_on(bag: np.ndarray) -> np.ndarray:
    """The passages of a bag that the model is fitted on."""
    if len(bag) <= FIT_PASSAGES:
        return bag
    number = np.arange(len(bag), dtype=np.uint64)
    mixed = (number + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    return bag[np.sort(np.argsort(mixed ^ (mixed >> np.uint64(29)), kind="stable")[:FIT_PASSAGES])]


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> AttentionMIL:
    sample = labelled_sample(docs, labels, "quality", rows, "quality-sample")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bags = [fitted_on(passages(t)) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": (b["y"] > 0).astype(int), "n": [len(x) for x in bags], "x": [x.astype("<f4").tobytes() for x in bags]})

    # FIT_PASSAGES passages, of 184 bytes each, of at most ``rows`` documents
    got = sample.mapInPandas(run, "doc_id long, y int, n int, x binary").toPandas().sort_values("doc_id")
    bags = [np.frombuffer(x, dtype="<f4").reshape(n, FEATURES).astype(float) for x, n in zip(got["x"], got["n"], strict=True)]
    return AttentionMIL().fit(bags, got["y"].to_numpy(dtype=float))


def score(docs: DataFrame, model: AttentionMIL, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, quality) for every row of ``docs``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, bags, held = [], [], 0
            for t in b["text"]:
                bags.append(passages(t))
                held += len(bags[-1])
                if held > 20_000:
                    out.append(model.score(bags))
                    bags, held = [], 0
            out.append(model.score(bags))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "quality": np.concatenate(out)})

    return docs.selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text").mapInPandas(run, "doc_id long, quality double")


def op1_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs, fit(docs, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= THRESHOLD).cast("int").alias("predicted")
    )


QUERIES = {"op1_attention_mil": op1_attention_mil}
