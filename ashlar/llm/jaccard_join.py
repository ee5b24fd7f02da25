"""Similarity join of texts by the Jaccard coefficient of their five-word shingles.

Words are runs of letters and digits in lower case; a text of one to four words has one shingle,
all of them; a text of none has no shingle.

1. Rows whose shingle sets are equal make a *class*; from here on a class is one node.
2. Banded MinHash (``BANDS`` of ``ROWS`` values) finds candidates: nodes that share a band.  A
   pair at the threshold is missed with a probability of ``(1 - 0.8^5)^32 = 3e-6``.
3. Candidates are gathered into components of shared bands, and these dealt into tiles: a
   component of any size is cut into blocks of about ``BLOCK`` nodes or ``BLOCK_CHARS`` characters, each pair of blocks being a
   tile, so that every pair meets once and a task holds two blocks.
4. Within a tile, pairs that share no band are left out and the others' MinHash values are
   compared incrementally, 16 at a time.  With a uniform prior the similarity's posterior after m
   of n matches is Beta(m + 1, n - m + 1); a pair is dropped when the probability of reaching the
   threshold falls below ``TOLERANCE``.  The rest are verified exactly on their shingle sets.
5. A tile gives, for each node, how many rows it links to, and a spanning forest of its links:
   never the pairs themselves.  Components of the forests are the classes of near duplicates.

Defined results: null texts are empty ones; texts without words equal each other and nothing
else; repeated rows are copies like any others; no rows give no rows; other columns play no part.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ashlar.llm.common import forget, give_back, join_hot, stored, table
from ashlar.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 5
STEP = 16
TOLERANCE = 1e-7
BLOCK = 256
BLOCK_CHARS = 8_000_000
CACHE_WORDS = 150_000
#: Documents that are signed at once.
DOCS = 1_024
#: Shingle columns that a dense comparison holds at once.
COLUMNS = 16_384

WORD = re.compile(r"[^\W_]+")
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, known: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles."""
    words = WORD.findall((text or "").lower())
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(size, len(h))
    acc = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        acc = _mix(acc * _M1 + h[i : len(h) - n + 1 + i])
    return np.unique(acc)


class MinHash:
    def __init__(self, count: int = BANDS * ROWS, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 1 << 32, count, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, count, dtype=np.uint32)

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row of 32-bit minima for each set; none may be empty."""
        out = np.empty((len(sets), len(self.a)), dtype=np.uint32)
        at = 0
        while at < len(sets):
            # some 64,000 shingles at a time stay in the processor's cache
            end, total = at, 0
            while end < len(sets) and (end == at or total + len(sets[end]) <= 65_536):
                total += len(sets[end])
                end += 1
            out[at:end] = self.minima(np.concatenate(sets[at:end]), np.cumsum([0] + [len(s) for s in sets[at : end - 1]]))
            at = end
        return out

    def minima(self, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The same for sets laid end to end, each beginning at one of ``starts``."""
        out = np.empty((len(starts), len(self.a)), dtype=np.uint32)
        x = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
        for k in range(len(self.a)):
            y = x * self.a[k]
            y ^= y >> np.uint32(15)
            y += self.b[k]
            out[:, k] = np.minimum.reduceat(y, starts)
        return out


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band, the band's number mixed in."""
    s = signatures.reshape(len(signatures), bands, rows).astype(np.uint64)
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), s.shape[:2]).copy()
    for r in range(rows):
        acc = _mix(acc * _M2 + s[:, :, r])
    return acc.view(np.int64)


def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The fewest matches of n that leave a probability of ``tolerance`` of reaching the threshold.

    With a uniform prior, P(J >= t | m of n) is the probability that a binomial variable of n + 1
    trials at t is at most m.
    """
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


_LEAST = {n: least_matches(n) for n in range(STEP, BANDS * ROWS + 1, STEP)}


def prune(sig: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which of the pairs (left, right), rows of ``sig``, survive incremental comparison."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), dtype=np.int32)
    for n, least in _LEAST.items():
        if n > sig.shape[1]:
            break
        part = sig[:, n - STEP : n]
        for lo in range(0, len(alive), 65_536):
            some = alive[lo : lo + 65_536]
            matches[some] += (part[left[some]] == part[right[some]]).sum(1, dtype=np.int32)
        alive = alive[matches[alive] >= least]
        if not len(alive):
            break
    return alive


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of the pairs' sets."""
    if len(left) <= 2 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left, right, strict=True)], dtype=np.int64)
    used = np.unique(np.concatenate((left, right)))
    row = np.full(len(sets), -1)
    row[used] = np.arange(len(used))
    owner = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    _, column, count = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(used), len(used)), dtype=np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, width, COLUMNS):
        a, b = np.searchsorted(column, (lo, lo + COLUMNS))
        block = np.zeros((len(used), min(COLUMNS, width - lo)), dtype=np.float32)
        block[owner[a:b], column[a:b] - lo] = 1
        total += block @ block.T
    return total[row[left], row[right]].astype(np.int64)


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(left.tolist(), right.tolist(), strict=True):
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def tile_links(b: pd.DataFrame, threshold: float, bands: int = BANDS, rows_in_band: int = ROWS) -> pd.DataFrame:
    """Links within a tile: rows (node, links) and, as (node, other), a spanning forest."""
    known = WordHashes()
    b = b.sort_values("node").reset_index(drop=True)
    block, node, rows = b["block"].to_numpy(), b["node"].to_numpy(), b["rows"].to_numpy()
    sets = [shingles(t, known) for t in b["text"]]
    sig = np.stack([np.frombuffer(s, dtype="<u4") for s in b["sig"]])
    keys = band_keys(sig, bands, rows_in_band)
    size = np.array([len(s) for s in sets])
    i, j = int(b["i"].iloc[0]), int(b["j"].iloc[0])
    if i == j:
        pairs = [(i, np.arange(i + 1, len(b))) for i in range(len(b))]
    else:
        other = np.flatnonzero(block == j)
        pairs = [(x, other) for x in np.flatnonzero(block == i)]
    links, lefts, rights = np.zeros(len(b), dtype=np.int64), [], []
    for i, js in pairs:
        # sizes alone may rule the threshold out
        js = js[np.minimum(size[js], size[i]) >= threshold * np.maximum(size[js], size[i]) - 1e-9]
        js = js[(keys[js] == keys[i]).any(1)] if len(js) else js
        lefts.append(np.full(len(js), i))
        rights.append(js)
    left, right = np.concatenate([*lefts, np.empty(0, dtype=np.int64)]).astype(np.int64), np.concatenate([*rights, np.empty(0, dtype=np.int64)]).astype(np.int64)
    alive = prune(sig, left, right)
    left, right = left[alive], right[alive]
    if len(left):
        both = intersections(sets, left, right)
        near = both / (size[left] + size[right] - both) >= threshold
        left, right = left[near], right[near]
    np.add.at(links, left, rows[right])
    np.add.at(links, right, rows[left])
    del known, sets
    give_back()
    met = np.flatnonzero(links)
    forest = _forest(len(b), left, right)
    out = pd.DataFrame(
        {
            "node": np.concatenate((node[met], node[[i for i, _ in forest]] if forest else node[:0])),
            "other": pd.array([None] * len(met) + [int(node[j]) for _, j in forest], dtype="Int64"),
            "links": np.concatenate((links[met], np.zeros(len(forest), dtype=np.int64))),
        }
    )
    return out


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """Every row of ``docs`` as (doc_id, h, row_id, root, class_id, n_links).

    ``class_id`` is the least id in the row's component of links, ``n_links`` how many other rows
    have a similarity of ``threshold`` or more with it.  ``h`` is the text's hash; ``row_id`` and
    ``root`` tell rows and components apart where ids repeat.
    """
    if threshold != THRESHOLD:
        raise ValueError("bands and the pruning table are made for a threshold of 0.8")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("chars", F.length("text").cast("long"))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, hashes = WordHashes(), MinHash()
        for whole in batches:
            for lo in range(0, len(whole), DOCS):
                b = whole.iloc[lo : lo + DOCS]
                sets = [shingles(t, known) for t in b["text"]]
                full = [s for s in sets if len(s)]
                sigs = iter(hashes.signatures(full)) if full else iter(())
                yield pd.DataFrame(
                    {
                        "doc_id": b["doc_id"].astype("Int64"), "h": b["h"], "chars": b["chars"], "cls": [blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                        "sig": [next(sigs).astype("<u4").tobytes() if len(s) else None for s in sets],
                    }
                )
        known.clear()
        give_back()

    signed = rows.mapInPandas(sign, "doc_id long, h long, chars long, cls binary, sig binary").withColumn("row_id", F.monotonically_increasing_id())
    signed = stored(signed, "jaccard-signed")
    # a class's node is its least row; text and signature are the same whichever row they come from
    classes = signed.groupBy("cls").agg(
        F.min(F.struct("row_id", "h", "doc_id", "chars")).alias("first"), F.count("*").alias("rows"), F.min("doc_id").alias("least_id")
    ).select("cls", F.col("first.row_id").alias("node"), F.col("first.h").alias("h"), F.col("first.doc_id").alias("doc_id"), F.col("first.chars").alias("chars"), "rows", "least_id")
    classes = stored(classes, "jaccard-classes")
    nodes = classes.select("node", "rows").join(signed.where("sig IS NOT NULL").select(F.col("row_id").alias("node"), "sig"), "node")

    @F.pandas_udf("array<long>")
    def keys(sigs: pd.Series) -> pd.Series:
        return pd.Series(list(band_keys(np.stack([np.frombuffer(s, dtype="<u4") for s in sigs])))) if len(sigs) else pd.Series([], dtype=object)

    banded = stored(nodes.select("node", F.explode(keys("sig")).alias("key")), "jaccard-banded")
    least = stored(banded.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1"), "jaccard-bands")
    edges = join_hot(banded, least, "key", "n").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    near = components(edges)
    forget(banded)
    forget(least)

    near = near.join(classes.select("node", "h", "doc_id", "chars"), "node")
    sizes = near.groupBy("root").agg(F.count("*").alias("size"), F.sum("chars").alias("all_chars"))
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("all_chars") / BLOCK_CHARS)).cast("int")
    sizes = stored(sizes.select("root", "size", F.greatest(blocks, F.lit(1)).alias("blocks")), "jaccard-sizes")
    dealt = join_hot(near, sizes, "root", "size").withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    members = dealt.join(nodes, "node")
    # candidates' texts: each by (id, hash of text), whichever of the rows that repeat
    wanted = members.select("doc_id", "h").distinct()
    r, w = rows.alias("r"), wanted.alias("w")
    same = F.col("r.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("r.h") == F.col("w.h"))
    texts = r.join(w, same, "left_semi").dropDuplicates(["doc_id", "h"])
    m, t = members.alias("m"), texts.alias("t")
    members = m.join(t, F.col("m.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("m.h") == F.col("t.h"))).select("m.*", "t.text")
    tiles = members.select(
        "root", "node", "rows", "sig", "text", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with")
    ).select("*", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
    found = tiles.groupBy("root", "i", "j").applyInPandas(lambda b: tile_links(b, threshold), "node long, other long, links long")
    found = stored(found, "jaccard-links")
    forget(sizes)

    links = found.where("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    labelled = classes.select("cls", "node", "rows", "least_id").join(links, "node", "left").join(roots, "node", "left")
    labelled = labelled.withColumn("root", F.coalesce("root", "node"))
    labelled = stored(labelled, "jaccard-labelled")
    least_ids = stored(labelled.groupBy("root").agg(F.min("least_id").alias("class_id"), F.count("*").alias("n")), "jaccard-ids")
    per_class = join_hot(labelled, least_ids, "root", "n").select("cls", "rows", "root", "class_id", (F.col("rows") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    per_class = stored(per_class, "jaccard-per-class")
    forget(labelled)
    return join_hot(signed.select("doc_id", "h", "row_id", "cls"), per_class, "cls", "rows").select("doc_id", "h", "row_id", "root", "class_id", "n_links")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, with its columns, that have the least id of their class of near duplicates: one for each class."""
    found = near_duplicates(docs, text, doc_id)
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    keepers = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id", "h")).alias("k"))
    keepers = keepers.select(key("k.doc_id").alias("id"), F.col("k.h").alias("h"))
    rows = docs.select(F.struct("*").alias("row"), key(doc_id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"))
    # rows that repeat both id and text are of one class: one of them stays
    return rows.join(keepers, ["id", "h"], "left_semi").dropDuplicates(["id", "h"]).select("row.*")


def op5_bayes_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
s AS (
  SELECT DISTINCT n, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
c AS (SELECT n, count(*) AS c FROM s GROUP BY n),
i AS (SELECT a.n AS a, b.n AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.n <> b.n GROUP BY ALL),
p AS (
  SELECT a, b FROM i JOIN c x ON x.n = a JOIN c y ON y.n = b WHERE i::DOUBLE / (x.c + y.c - i) >= 0.8::DOUBLE
  UNION ALL SELECT a.n, b.n FROM w a JOIN w b ON len(a.w) = 0 AND len(b.w) = 0 AND a.n <> b.n),
r AS (SELECT n AS a, n AS b FROM w UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT w.doc_id, (SELECT min(o.doc_id) FROM r JOIN w o ON o.n = r.b WHERE r.a = w.n) AS class_id, (SELECT count(*) FROM p WHERE p.a = w.n) AS n_links FROM w
"""

QUERIES = {"op5_bayes_jaccard": op5_bayes_jaccard}
ORACLES = {"op5_bayes_jaccard": SQL}
