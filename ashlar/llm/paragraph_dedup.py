"""Repeated passages by MinHash banding of paragraphs, long and short.

A document's *paragraphs* are some 40 to 150 words long: it is cut after the word that is the best
place to cut among the ``SPREAD`` words on either side, where an end of a line is better than an end of a sentence
and this better than any other word, and the hash of the words there decides among equals.  So a
cut depends on the words around it alone, paragraphs begin and end alike wherever a passage
stands, and no word is left out.  *Windows* are short paragraphs, of ``PIECE`` words in a row: of
any ``PICK`` neighbouring windows the one of the least hash is taken, which is MinHash with a
single value over such stretches.  A run of ``PIECE + PICK - 1`` words that two documents share
gives both an equal window, except that equal windows side by side, as in a run of one word, are thinned.

1. Paragraphs with equal words in equal order make a class (a 64-bit hash of them).
2. Paragraphs have ``BANDS`` bands of ``ROWS`` values, tuned for recall (:func:`tune`): a pair at
   0.8 is missed once in 550 times, and one at 0.2 collides once in 50.
3. Classes that share a band are gathered into components and verified exactly, by Jaccard on
   their shingle sets, in tiles of bounded size.  Their words are cut from the texts a second time, so
   that no text is carried along with the bands.
4. Components of verified links, and classes that occur more than once, are clusters of repeated
   paragraphs, if they meet in two documents or more.  The first occurrence of a cluster (least id) stays, the others are removals.
5. Repeated paragraphs of a document with at most ``GAP`` words between them make one passage;
   passages of ``LEAST_PASSAGE`` repeated words or more are given.  The bound lies under 50
   because a passage begins and ends within windows that it shares with what stands around it.
   Words that several paragraphs of a passage hold are counted once.

Words are runs of letters and digits; each character of a script that is written without blanks
is a word.

Defined results: null and empty texts, and those of fewer than ``LEAST_WORDS`` words, have no paragraphs; repeated rows are documents like any
others; whole texts are read; no rows give no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ashlar.llm.common import forget, give_back, join_hot, stored, table
from ashlar.llm.components import components
from ashlar.llm.jaccard_join import BLOCK, SHINGLE, THRESHOLD, MinHash, WordHashes, band_keys, shingles
from ashlar.llm.jaccard_join import _mix as mix64
from ashlar.llm.quality_mil import _inverse, _powers

LEAST_WORDS = 7
SPREAD = 40
PIECE = 20
PICK = 24
LEAST_PASSAGE = 20
GAP = 40
RECALL = 0.998
MOST_BANDS = 12
#: Words that are signed at once, unless one text has more.
BATCH_WORDS = 400_000
#: Classes whose words a task remembers to have given, before it forgets them all.
SEEN = 200_000

_ODD = np.uint64(0xD6E8FEB86659FD93)


def tune(threshold: float = THRESHOLD, recall: float = RECALL, most_bands: int = MOST_BANDS) -> tuple[int, int]:
    """(bands, rows): the most rows in a band, and then the fewest bands, that find a pair at the threshold with that probability."""
    for rows in range(8, 0, -1):
        for bands in range(1, most_bands + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                return bands, rows
    return most_bands, 1


BANDS, ROWS = tune()


def _bytes(members: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(members)] = True
    return out


_LETTER = _bytes(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" + bytes(range(128, 256)))
#: First bytes of the scripts that are written without blanks.
_SOLO = _bytes(bytes([0xE0, 0xE1, *range(0xE3, 0xEA), 0xF0]))
_STOP, _BLANK = _bytes(b".!?"), _bytes(b" \t\r\n")
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begins, ends) of the words, in bytes."""
    letter = np.concatenate(([False], _LETTER[raw], [False]))
    if not _SOLO[raw].any():
        edge = np.flatnonzero(np.diff(letter.view(np.int8)))
        return edge[0::2], edge[1::2]
    b1, b2 = (np.concatenate((raw[k:], np.zeros(k, dtype=np.uint8)))[: len(raw)] for k in (1, 2))
    # ideographs, kana and the like; Thai and Lao; Burmese; Khmer; rarer ideographs
    solo = ((raw >= 0xE3) & (raw <= 0xE9)) | ((raw == 0xE0) & (b1 >= 0xB8) & (b1 <= 0xBB)) | ((raw == 0xE1) & np.isin(b1, (0x80, 0x81, 0x82, 0x9E, 0x9F)))
    solo |= (raw == 0xF0) & (b1 >= 0xA0)
    blank = np.flatnonzero((raw == 0xE3) & (b1 == 0x80) & ((b2 <= 0x83) | ((b2 >= 0x88) & (b2 <= 0x91))))  # their blank, full stop, comma and brackets
    for k in range(3):
        letter[1 + blank + k] = False
    starts = np.flatnonzero(solo)
    new = np.zeros(len(raw) + 1, dtype=bool)
    new[starts] = True
    new[np.minimum(starts + np.where(raw[starts] == 0xF0, 4, 3), len(raw))] = True
    before, here = letter[:-1], letter[1:]
    return np.flatnonzero(here & (new | ~before)), np.flatnonzero(before & (new | ~here))


def _least(a: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    done = 1
    while done < width:
        step = min(done, width - done)
        a, done = np.minimum(a[:-step], a[step:]), done + step
    return a


def windows(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, 64-bit hash) of the windows of ``PIECE`` words that are taken, out of the hashes of a text's words."""
    n = len(h) - PIECE + 1
    if n < 1:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(h * _powers(len(h)), dtype=np.uint64)))
    g = mix64((total[PIECE:] - total[:-PIECE]) * _inverse(len(h))[:n])
    width = min(PICK, n)
    edge = np.zeros(width - 1, dtype=np.uint64)
    # a window is taken if it is the least of some ``width`` neighbours
    at = np.flatnonzero(g == ~_least(~np.concatenate((edge, _least(g, width), edge)), width))
    alone = np.concatenate(([True], g[at[1:]] != g[at[:-1]]))
    begin = np.maximum.accumulate(np.where(alone, np.arange(len(at)), 0))
    step = (at - at[begin]) // (PICK // 2)
    at = at[alone | np.concatenate(([True], step[1:] != step[:-1]))]
    return at, g[at].view(np.int64)


def cuts(h: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The words after which a text is cut, out of the hashes of its words and how they end: 0 a line, 1 a sentence, 2 neither."""
    n = len(h)
    if n <= SPREAD:
        return np.empty(0, dtype=np.int64)
    # the less, the better; the next word's hash counts too, so that a common word is no place to cut by itself
    place = (mix64(h ^ mix64(np.concatenate((h[1:], h[:1])))) >> np.uint64(2)) | (stop.astype(np.uint64) << np.uint64(62))
    edge = np.full(SPREAD, ~np.uint64(0))
    least = _least(np.concatenate((edge, place, edge)), SPREAD)
    # less than all before it and not more than any after it: of equal ones side by side the first
    at = np.flatnonzero((place < least[:n]) & (place <= least[SPREAD + 1 : SPREAD + 1 + n]))
    return at[(at + 1 >= LEAST_WORDS) & (n - 1 - at >= LEAST_WORDS)]


class Layout:
    """The words of a text, where they stand, their hashes, and its paragraphs as ranges (first, last) of them.

    Words are runs of letters, digits and bytes outside ASCII, but for scripts without blanks; capitals of ASCII count as
    small.  A text of fewer than ``LEAST_WORDS`` words has no paragraph.
    """

    def __init__(self, text: str | None):
        self.raw = raw = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)
        self.begins, self.ends = begins, ends = _words(raw)
        self.first = self.last = np.empty(0, dtype=np.int64)
        self.h = np.empty(0, dtype=np.uint64)
        if len(begins) < LEAST_WORDS:
            return
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((_LOWER[raw] + np.uint64(1)) * _powers(len(raw)), dtype=np.uint64)))
        self.h = mix64((total[ends] - total[begins]) * _inverse(len(raw))[begins])
        # a word ends a sentence if one mark and a blank follow it, and a line if a line end comes before the next word
        after = np.minimum(ends + 1, len(raw) - 1)
        lines = np.concatenate(([0], np.cumsum(raw == 10)))
        mark = _STOP[raw[np.minimum(ends, len(raw) - 1)]] & _BLANK[raw[after]] & (ends + 1 < len(raw))
        stop = np.where(mark, 1, 2)
        stop[:-1][lines[begins[1:]] > lines[ends[:-1]]] = 0
        at = cuts(self.h, stop)
        self.first, self.last = np.concatenate(([0], at + 1)), np.concatenate((at, [len(self.h) - 1]))

    def chars(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) in code points of ranges of words."""
        upto = np.cumsum((self.raw & 0xC0) != 0x80)
        return upto[self.begins[first]] - 1, upto[self.ends[last] - 1]

    def text(self, i: int) -> str:
        """The words of paragraph ``i`` and what stands between them."""
        return self.raw[self.begins[self.first[i]] : self.ends[self.last[i]]].tobytes().decode("utf-8", "replace")


def classes(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the words, in order, of paragraphs of ``n`` words that make up ``h``."""
    starts = np.cumsum(n) - n
    place = np.arange(len(h)) - np.repeat(starts, n)
    return mix64(np.add.reduceat(mix64(h ^ mix64(place.astype(np.uint64) + np.uint64(1))), starts) + n.astype(np.uint64)).view(np.int64)


def sign(h: np.ndarray, n: np.ndarray, hashes: MinHash) -> np.ndarray:
    """The MinHash values of the shingles of such paragraphs, all of which have ``SHINGLE`` words or more.

    All paragraphs are worked on at once; repeats among a paragraph's shingles don't change minima.
    """
    place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    acc = np.full(len(h) - SHINGLE + 1, SHINGLE, dtype=np.uint64)
    for i in range(SHINGLE):
        acc = mix64(acc * _ODD + h[i : len(h) - SHINGLE + 1 + i])
    inside = (place + SHINGLE <= np.repeat(n, n))[: len(acc)]
    counts = n - SHINGLE + 1
    return hashes.minima(acc[inside], np.cumsum(counts) - counts)


def cut_up(rows: DataFrame) -> DataFrame:
    """(row_id, doc_id, text) -> (row_id, doc_id, at, start, end, words, wide, cls, keys) for every paragraph and (``wide``) window.

    ``at`` is the number of its first word, ``start`` and ``end`` are in code points, ``keys`` a paragraph's bands.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = MinHash(BANDS * ROWS)

        def given(held: list) -> pd.DataFrame:
            ids, docs, layouts = zip(*held, strict=True)
            heads = [windows(x.h) for x in layouts]
            n = np.array([[len(x.first), len(w)] for x, (w, _) in zip(layouts, heads, strict=True)]).ravel()
            size = np.concatenate([x.last - x.first + 1 for x in layouts])
            h = np.concatenate([x.h for x in layouts])
            cls, keys = classes(h, size), band_keys(sign(h, size, hashes), BANDS, ROWS)
            parts, upto = [], 0
            for x, (w, g) in zip(layouts, heads, strict=True):
                m = len(x.first)
                parts.append((x.first, *x.chars(x.first, x.last), x.last - x.first + 1, cls[upto : upto + m]))
                parts.append((w, *x.chars(w, w + PIECE - 1), np.full(len(w), PIECE), g))
                upto += m
            at, start, end, words, cls = (np.concatenate([p[k] for p in parts]) for k in range(5))
            wide = np.repeat(np.arange(len(n)) % 2 == 1, n)
            bands = np.full(len(wide), None, dtype=object)
            bands[~wide] = pd.Series(list(keys), dtype=object)
            doc = pd.array(docs, dtype="Int64").repeat(n[0::2] + n[1::2])
            return pd.DataFrame(
                {"row_id": np.repeat(ids, n[0::2] + n[1::2]), "doc_id": doc, "at": at, "start": start, "end": end, "words": words, "wide": wide, "cls": cls, "keys": bands}
            )

        for b in batches:
            held, words = [], 0
            for i, d, t in zip(b["row_id"], b["doc_id"].astype("Int64"), b["text"], strict=True):
                x = Layout(t)
                if not len(x.first):
                    continue
                if held and words + len(x.h) > BATCH_WORDS:
                    yield given(held)
                    held, words = [], 0
                held.append((i, d, x))
                words += len(x.h)
            if held:
                yield given(held)
        give_back()

    return rows.mapInPandas(run, "row_id long, doc_id long, at int, start int, end int, words int, wide boolean, cls long, keys array<long>")


def wordings(rows: DataFrame) -> DataFrame:
    """(cls, text) of the paragraphs of ``rows``; of one class that is common a task gives few."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for b in batches:
            cls, text = [], []
            for t in b["text"]:
                x = Layout(t)
                if not len(x.first):
                    continue
                for i, c in enumerate(classes(x.h, x.last - x.first + 1).tolist()):
                    if c not in seen:
                        seen.add(c)
                        cls.append(c)
                        text.append(x.text(i))
                if len(seen) > SEEN:
                    seen.clear()
            yield pd.DataFrame({"cls": np.array(cls, dtype=np.int64), "text": pd.Series(text, dtype=object)})
        give_back()

    return rows.select("text").mapInPandas(run, "cls long, text string")


def tile_edges(b: pd.DataFrame) -> pd.DataFrame:
    """(node, other): a spanning forest of the links between the nodes of a tile that are of one component.

    A tile of two blocks compares one with the other only.  Intersections are counted from lists of the nodes that have a shingle.
    """
    b = b.sort_values("node").reset_index(drop=True)
    node, root, block = b["node"].to_numpy(), b["root"].to_numpy(), b["block"].to_numpy()
    known = WordHashes()
    sets = [shingles(t, known) for t in b["text"]]
    size = np.array([len(s) for s in sets])
    value = np.concatenate(sets)
    owner = np.repeat(np.arange(len(b)), size)
    _, value = np.unique(value, return_inverse=True)
    order = np.argsort(value, kind="stable")
    posted, begins = owner[order], np.searchsorted(value[order], np.arange(len(order) + 1))
    upto = np.cumsum(size)
    up = list(range(len(b)))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    across = b["i"].iloc[0] != b["j"].iloc[0]
    out = []
    for i in range(len(b)):
        mine = value[upto[i] - size[i] : upto[i]]
        both = np.bincount(np.concatenate([posted[begins[v] : begins[v + 1]] for v in mine]), minlength=len(b))
        near = (both >= THRESHOLD * (size + size[i] - both) - 1e-9) & (both / (size + size[i] - both) >= THRESHOLD) & (root == root[i])
        near[: i + 1] = False
        if across:
            near &= block != block[i]
        for j in np.flatnonzero(near).tolist():
            x, y = find(i), find(j)
            if x != y:
                up[max(x, y)] = min(x, y)
                out.append((node[i], node[j]))
    return pd.DataFrame(out, columns=["node", "other"], dtype=np.int64)


def near_links(units: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, root): classes of paragraphs that are near others, by components of verified links."""
    banded = units.select(F.col("cls").alias("node"), F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("n")).where("least < most").drop("most")
    shared = stored(shared, "paragraph-bands")
    near = components(join_hot(banded, shared, "key", "n").select(F.col("node").alias("a"), F.col("least").alias("b")))
    forget(shared)

    sizes = stored(near.groupBy("root").agg(F.count("*").alias("size")).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")), "paragraph-sizes")
    # small components share tiles; nodes of different ones are not compared
    packs = max(1, (sizes.where("blocks = 1").agg(F.sum("size").alias("n")).first()["n"] or 0) * 2 // BLOCK)
    dealt = join_hot(near, sizes, "root", "size").withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    alone = F.col("blocks") > 1
    dealt = dealt.withColumn("alone", alone).withColumn("tile", F.when(alone, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(packs))))
    texts = wordings(rows).withColumnRenamed("cls", "node")
    members = stored(texts.join(dealt, "node").dropDuplicates(["node"]), "paragraph-candidates")
    tiles = members.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("alone", "tile", "root", "node", "text", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
    found = stored(tiles.groupBy("alone", "tile", "i", "j").applyInPandas(tile_edges, "node long, other long"), "paragraph-links")
    forget(members)
    forget(sizes)
    links = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    forget(found)
    return links


def repeated_paragraphs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(row_id, doc_id, at, start, end, words, wide, cluster, keep) for every paragraph or (``wide``) window that another document has, exactly or nearly.

    ``at`` is the number of its first word.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    pieces = stored(cut_up(rows.withColumn("row_id", F.monotonically_increasing_id())), "paragraphs")
    links = near_links(pieces.where("NOT wide"), rows)

    # classes that two documents have, and those with a link
    exact = pieces.groupBy("cls").agg(F.min("row_id").alias("least"), F.max("row_id").alias("most"), F.count("*").alias("n")).where("least < most")
    clusters = exact.select("cls", "n").join(links.withColumnRenamed("node", "cls"), "cls", "full")
    clusters = stored(clusters.select("cls", F.coalesce("root", "cls").alias("cluster"), F.coalesce("n", F.lit(1)).alias("n")), "paragraph-clusters")
    again = stored(join_hot(pieces.drop("keys"), clusters, "cls", "n").drop("cls"), "paragraphs-repeated")
    forget(pieces)
    forget(clusters)
    kept = again.groupBy("cluster").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id", "at")).alias("k"), (F.min("row_id") < F.max("row_id")).alias("across"), F.count("*").alias("n")
    ).where("across")  # a document that repeats itself alone is left as it is
    kept = stored(kept.select("cluster", F.col("k.row_id").alias("k_row"), F.col("k.at").alias("k_at"), "n"), "paragraph-keepers")
    # equal windows of one document may lie within each other: they stay together
    keep = (F.col("k_row") == F.col("row_id")) & (F.col("wide") | (F.col("k_at") == F.col("at")))
    return join_hot(again, kept, "cluster", "n").select("row_id", "doc_id", "at", "start", "end", "words", "wide", "cluster", keep.alias("keep"))


def passages(found: DataFrame, least: int = LEAST_PASSAGE, gap_chars: int = 8 * GAP) -> DataFrame:
    """(doc_id, start, end, words, cluster, removed) of each passage: neighbouring repeated paragraphs of a document put together.

    ``cluster`` is that of its longest paragraph, or the least of its windows if it has none; ``removed`` is false where all of its paragraphs are the ones that stay.
    A group that is sorted here is a single document's.
    """
    order = Window.partitionBy("row_id").orderBy("start", "end", "wide", "at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto, words = F.max("end").over(before), F.max(F.col("at") + F.col("words")).over(before)
    fresh = F.greatest(F.col("at") + F.col("words") - F.greatest(F.col("at"), F.coalesce(words, F.lit(0))), F.lit(0))
    laid = found.withColumn("fresh", fresh).withColumn("new", F.coalesce(F.col("start") - upto > gap_chars, F.lit(True)).cast("int"))
    laid = laid.withColumn("run", F.sum("new").over(order))
    longest = F.struct("wide", -F.col("words"), F.when(F.col("wide"), F.col("cluster")).otherwise(F.col("start").cast("long")))
    out = laid.groupBy("row_id", "run").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"), F.sum("fresh").alias("words"),
        F.min_by("cluster", longest).alias("cluster"), (~F.bool_and("keep")).alias("removed"),
    )
    return out.where(F.col("words") >= least).select("doc_id", "start", "end", "words", "cluster", "removed")


def op7_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(repeated_paragraphs(table(spark, sf_dir, "documents")))


QUERIES = {"op7_paragraph_minhash": op7_paragraph_minhash}
