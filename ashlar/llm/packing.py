"""Packing documents into sequences by non-negative least squares over length combinations.

A document is its token ids and one end id.  Whole windows are cut off its front; what remains
is shorter than a window.  The remains' lengths make a histogram of at most ``window`` bins.

1. Shallow combinations that fill a window exactly are enumerated: all pairs of lengths, and
   triples out of the most frequent lengths.
2. Non-negative least squares (coordinate descent) solves how often each is used, so that the
   lengths used come to the histogram.
3. The solution is rounded down, within what is there.
4. The residuals are packed greedily: laid end to end in a fixed order and cut at each window's
   end.  The one sequence that is left over at the very end is split into powers of two.

The plan is a table of at most a few thousand rows, whatever the input's size.  A document finds
its place by its rank among those of its length: ranks come from counts by (length, shard), so
that no length, however frequent, is ranked in one task.

Defined results: a null or empty text is the end id alone; repeated rows are packed each for
itself; no rows give no pieces; other columns play no part.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ashlar.llm.common import stored, table

WINDOW = 2048
END_ID = 1
TRIPLES_OF = 48
SHARDS = 64
CACHE_WORDS = 400_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder(dict):
    """Ids of texts as little-endian 16-bit numbers, word by word.

    The tokenizer drops white space and its pieces never cross it, so that a text's ids are those
    of its words; words' ids are kept in a bounded dictionary.  Words of letters alone, with or
    without a full stop or comma at the end, go straight to the model, others through the whole
    tokenizer.  Texts for which words don't stand alone (compositions, unusual separators, special
    tokens, final sigma) are encoded whole.
    """

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tk = Tokenizer.from_file(model)
        self.bpe = self.tk.model
        if self.tk.get_vocab_size() > 65536:
            raise ValueError("ids have more than 16 bits")
        # the printable stand-ins that byte-level models have for bytes
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = iter(range(256, 512))
        self.stand_in = {b: chr(b) if b in plain else chr(next(other)) for b in range(256)}
        self.marks = {m: self._through(m) for m in ".,"}

    def _through(self, word: str) -> bytes:
        return np.array(self.tk.encode(word, add_special_tokens=False).ids, dtype="<u2").tobytes()

    def _letters(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode("utf-8").decode("latin-1").translate(self.stand_in)
        return np.array([t.id for t in self.bpe.tokenize(word)], dtype="<u2").tobytes()

    def __missing__(self, word: str) -> bytes:
        if word.isalpha():
            ids = self._letters(word)
        elif word[-1] in self.marks and word[:-1].isalpha():
            ids = self[word[:-1]] + self.marks[word[-1]]
        else:
            ids = self._through(word)
        self[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        import unicodedata

        if not text:
            return b""
        low = text.lower()
        if "<|" in low or not text.isascii() and ("Σ" in text or not unicodedata.is_normalized("NFC", text) or not unicodedata.is_normalized("NFC", low)):
            return self._through(text)
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self._through(text)
        if len(self) > CACHE_WORDS:
            self.clear()
        return b"".join(map(self.__getitem__, low.split()))


@lru_cache(maxsize=2)
def encoder(model: str) -> WordEncoder:
    return WordEncoder(model)


def encode_documents(docs: DataFrame, text: str, doc_id: str, model: str) -> DataFrame:
    """(doc_id, n, ids): ids as 16-bit numbers with the end id, ``n`` of them."""
    end = np.array([END_ID], dtype="<u2").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(model)
        for b in batches:
            ids = [enc.encode(t) + end for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "n": [len(x) // 2 for x in ids], "ids": ids})

    return docs.selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text").mapInPandas(run, "doc_id long, n long, ids binary")


def combinations(hist: np.ndarray, window: int = WINDOW, triples_of: int = TRIPLES_OF) -> list[tuple[int, ...]]:
    """Pairs and triples of lengths present in ``hist`` that fill the window exactly."""
    there = np.flatnonzero(hist[:window])
    out = [(int(a), window - int(a)) for a in there if a <= window - a and hist[window - a]]
    top = sorted(there[np.argsort(-hist[there], kind="stable")][:triples_of].tolist())
    seen = set(out)
    for i, a in enumerate(top):
        for b in top[i:]:
            c = window - a - b
            if c > 0 and hist[c] and (t := tuple(sorted((a, b, c)))) not in seen:
                seen.add(t)
                out.append(t)
    return out


def nnls(combos: list[tuple[int, ...]], hist: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Non-negative repeats x that bring the lengths used near the histogram: cyclic coordinate descent."""
    columns = [np.unique(np.array(c), return_counts=True) for c in combos]
    norms = [float((k * k).sum()) for _, k in columns]
    x, rest = np.zeros(len(combos)), hist.astype(float).copy()
    for _ in range(sweeps):
        moved = 0.0
        for j, (bins, k) in enumerate(columns):
            step = max(float((rest[bins] * k).sum()) / norms[j], -x[j])
            if step:
                x[j] += step
                rest[bins] -= step * k
                moved = max(moved, abs(step))
        if moved < 0.25:
            break
    return x


def plan(hist: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(combination, repeats), rounded down within what the histogram has."""
    combos = combinations(hist, window)
    x = nnls(combos, hist)
    left, out = hist.astype(np.int64).copy(), []
    for j in np.argsort(-x, kind="stable"):
        bins, k = np.unique(np.array(combos[j]), return_counts=True)
        times = min(int(x[j] + 1e-6), int((left[bins] // k).min()))
        if times > 0:
            left[bins] -= times * k
            out.append((combos[j], times))
    # what rounding left over in pairs that still fit
    for c in combos:
        bins, k = np.unique(np.array(c), return_counts=True)
        if (times := int((left[bins] // k).min())) > 0:
            left[bins] -= times * k
            out.append((c, times))
    return out


def _slots(steps: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset): where the remains of a length go by their rank."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for combo, times in steps:
        at = 0
        for length in combo:
            out.append((length, used.get(length, 0), times, sequence, at))
            used[length] = used.get(length, 0) + times
            at += length
        sequence += times
    return out


def _powers(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", model: str | None = None, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """One row for each piece: its document, place there, length, checksum, sequence and offset, and ``ids`` (little-endian 32-bit) if asked for."""
    spark = docs.sparkSession
    encoded = encode_documents(docs, text, doc_id, model or default_model()).withColumn("k", F.monotonically_increasing_id())
    encoded = stored(encoded, "pack-ids")  # from here on k is a fixed key
    slim = encoded.select("k", "n", (F.col("n") % window).alias("rem"), F.floor(F.col("n") / window).alias("full"), F.pmod(F.xxhash64("k"), F.lit(SHARDS)).alias("shard"))

    # counts by (length, shard): window * SHARDS rows at most
    cells = stored(slim.groupBy("rem", "shard").agg(F.count("*").alias("docs"), F.sum("full").alias("full")), "pack-cells")
    counted = cells.groupBy("rem").agg(F.sum("docs").alias("docs"), F.sum("full").alias("full")).collect()
    hist = np.zeros(window + 1, dtype=np.int64)
    for r in counted:
        hist[r["rem"]] = r["docs"]
    hist[0] = 0
    total_full = sum(r["full"] for r in counted)
    steps = plan(hist, window)
    slots = _slots(steps)
    placed = sum(t for _, t in steps)

    by_rem = Window.partitionBy("rem").orderBy("shard")
    cells = cells.withColumn("docs_before", F.sum("docs").over(by_rem) - F.col("docs"))
    # whole windows are numbered by (length, shard) too: a running sum over the cells
    cells = cells.withColumn("full_before", F.sum("full").over(Window.orderBy("rem", "shard")) - F.col("full"))
    ordered = Window.partitionBy("rem", "shard").orderBy("k")
    ranked = slim.join(F.broadcast(cells.select("rem", "shard", "docs_before", "full_before")), ["rem", "shard"])
    ranked = ranked.withColumn("rank", F.row_number().over(ordered) - 1 + F.col("docs_before")).withColumn(
        "full_at", F.sum("full").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("full") + F.col("full_before")
    )

    # ranks beyond the plan are residuals; where one lies in their line follows from its length and rank
    schema = "rem long, first long, times long, sequence long, at long"
    slot_rows = spark.createDataFrame(slots or [(0, 0, 0, 0, 0)], schema)
    by_length = slot_rows.groupBy("rem").agg(F.array_sort(F.collect_list(F.struct("first", "times", "sequence", "at"))).alias("slots"))
    used: dict[int, int] = {}
    for length, _, times, _, _ in slots:
        used[length] = used.get(length, 0) + times
    line, lines = 0, []
    for length in np.flatnonzero(hist).tolist():
        over = int(hist[length]) - used.get(length, 0)
        lines.append((length, used.get(length, 0), line))
        line += over * length
    lines_df = spark.createDataFrame(lines or [(0, 0, 0)], "rem long, used long, line long")
    lookup = lines_df.join(by_length, "rem", "left")
    ranked = ranked.join(F.broadcast(lookup), "rem", "left")
    slot = F.get(F.filter("slots", lambda s: (s["first"] <= F.col("rank")) & (F.col("rank") < s["first"] + s["times"])), F.lit(0))
    ranked = ranked.withColumn("slot", slot)
    on_line = F.when((F.col("rem") > 0) & F.col("slot").isNull(), F.col("line") + (F.col("rank") - F.col("used")) * F.col("rem"))
    placed_docs = ranked.select(
        "k", "full", "rem", (F.col("full_at") + placed).alias("full_sequence"),
        (F.col("slot.sequence") + F.col("rank") - F.col("slot.first")).alias("sequence"), F.col("slot.at").alias("at"), on_line.alias("line"),
    )
    first_line = placed + total_full
    whole, last = divmod(line, window)
    tails, at = [], 0
    for p in _powers(last):
        tails.append((at, p))
        at += p
    # places 0..2^b of the last, short window: sequences of their own, each a power of two
    tail_starts = [whole * window + a for a, _ in tails]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, n, ids, full, rem, fs, seq, at, ln in zip(
                b["doc_id"], b["n"], b["ids"], b["full"], b["rem"], b["full_sequence"], b["sequence"], b["at"], b["line"], strict=True
            ):
                wide = np.frombuffer(ids, dtype="<u2").astype("<u4")
                full, rem = int(full), int(rem)
                pieces = [(i * window, window, int(fs) + i, 0) for i in range(full)]
                if rem and ln == ln and ln is not None and not pd.isna(ln):
                    start, at_line, left = full * window, int(ln), rem
                    while left:
                        w, o = divmod(at_line, window)
                        if w < whole:
                            take, piece = min(left, window - o), (first_line + w, o)
                        else:
                            t = max(i for i, s in enumerate(tail_starts) if s <= at_line)
                            o = at_line - tail_starts[t]
                            take, piece = min(left, tails[t][1] - o), (first_line + whole + t, o)
                        pieces.append((start, take, *piece))
                        start, at_line, left = start + take, at_line + take, left - take
                elif rem:
                    pieces.append((full * window, rem, int(seq), int(at)))
                for start, length, s, o in pieces:
                    part = wide[start : start + length].tobytes()
                    rows.append((doc, start, length, zlib.crc32(part), int(n), s, o, *([part] if with_ids else [])))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    joined = encoded.select("k", "doc_id", "n", "ids").join(placed_docs, "k").drop("k")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return joined.mapInPandas(run, schema)


def pieces(docs: DataFrame) -> DataFrame:
    return pack(docs, with_ids=False)


def op6_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(table(spark, sf_dir, "documents"))


QUERIES = {"op6_nnls_packing": op6_nnls_packing}
