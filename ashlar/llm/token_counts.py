"""Token counts of huge documents by overlap resynchronisation.

A text longer than ``chunk`` characters is encoded in chunks that overlap.  Each chunk's tokens
are laid over the text with their offsets, and neighbouring chunks are spliced at a position in
their overlap that is a token boundary in both and is *proven* stable: no piece of the vocabulary
holds, side by side, the two characters that meet there.  Merges only ever make pieces of the
vocabulary, so no merge in any encoding of the text can cross such a position, and what lies left
and right of it is encoded independently.  Where an overlap has no such position it is widened,
doubling up to the rest of the text, which amounts to encoding it whole.

Defined results: a null or empty text has 0 tokens; special strings inside texts are ordinary
text, as the library has it; lone surrogates become U+FFFD.  One text at a time is in memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ashlar.llm.common import table

CHUNK = 32_768
OVERLAP = 256
LIMIT = 4096
SPACE = "▁"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Counter:
    def __init__(self, model: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.chunk, self.overlap = chunk, overlap
        n = self.sp.get_piece_size()
        self.byte = np.array([self.sp.is_byte(i) for i in range(n)])
        pieces = [self.sp.id_to_piece(i) for i in range(n)]
        plain = [p for i, p in enumerate(pieces) if not self.byte[i] and not self.sp.is_control(i) and not self.sp.is_unknown(i)]
        self.inner = {p[i : i + 2] for p in plain for i in range(len(p) - 1)}
        self.chars = {c for p in plain for c in p}
        self.widened = 0

    def stable(self, text: str, at: int) -> bool:
        """Whether no merge can cross ``at``."""
        return (text[at - 1] + text[at]).replace(" ", SPACE) not in self.inner

    def offsets(self, text: str, ids: list[int]) -> list[int]:
        """The characters of ``text`` before each token; the model puts one space before the text."""
        out, at, left = [], -1, 0
        for i in ids:
            out.append(max(at, 0))
            if self.byte[i]:
                # a character outside the vocabulary is one token for each of its bytes
                if left == 0:
                    left = len(text[at].encode("utf-8"))
                left -= 1
                at += left == 0
            else:
                at += len(self.sp.id_to_piece(i))
        if at != len(text):
            raise ValueError("tokens do not cover the text")
        return out

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not text.isascii():
            text = text.encode("utf-8", "replace" if _has_surrogates(text) else "strict").decode("utf-8")
        if len(text) <= self.chunk or "\0" in text or SPACE in text:
            return len(self.sp.encode(text))
        return sum(hi - lo for _, lo, hi in self.spans(text))

    def spans(self, text: str) -> Iterator[tuple[list[int], int, int]]:
        """Runs ``ids[lo:hi]`` of tokens that make up the whole text, a chunk at a time."""
        start, end = 0, self.chunk
        ids = self.sp.encode(text[start:end])
        lo = 0
        while end < len(text):
            offs = self.offsets(text[start:end], ids)
            overlap = self.overlap
            while True:
                # the next chunk begins inside this one; an overlap that reaches back to this one's start is the same as a longer chunk
                nxt = max(end - overlap, start)
                nxt_end = min(nxt + self.chunk + overlap, len(text))
                ids2 = self.sp.encode(text[nxt:nxt_end])
                offs2 = self.offsets(text[nxt:nxt_end], ids2)
                cut = self._common(text, {start + o: k for k, o in enumerate(offs) if k >= lo and start + o > nxt}, {nxt + o: k for k, o in enumerate(offs2)})
                if cut is not None:
                    yield ids, lo, cut[0]
                    start, end, ids, lo = nxt, nxt_end, ids2, cut[1]
                    break
                self.widened += 1
                if nxt == start:
                    # nothing stable in the whole chunk: lengthen it
                    end = min(end + (end - start), len(text))
                    ids, before = self.sp.encode(text[start:end]), offs[lo]
                    offs = self.offsets(text[start:end], ids)
                    lo = offs.index(before)
                    if end == len(text):
                        break
                    overlap = self.overlap
                else:
                    overlap *= 2
        yield ids, lo, len(ids)

    def _common(self, text: str, a: dict[int, int], b: dict[int, int]) -> tuple[int, int] | None:
        """The last boundary but those near the first chunk's end that both have and that is stable."""
        for at in sorted(a.keys() & b.keys(), reverse=True):
            if 0 < at < len(text) and self.stable(text, at):
                return a[at], b[at]
        return None


def _has_surrogates(text: str) -> bool:
    return any("\ud800" <= c <= "\udfff" for c in text)


@lru_cache(maxsize=4)
def counter(model: str, chunk: int, overlap: int) -> Counter:
    return Counter(model, chunk, overlap)


def token_counts(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", model: str | None = None, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``; ``model`` is a path that every executor can read."""
    model = model or default_model()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = counter(model, chunk, overlap)
        for b in batches:
            n = [tokens.count(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "n_bytes": b["n_bytes"], "n_tokens": n, "over_limit": [x > limit for x in n]})

    rows = docs.selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text", f"cast(coalesce(octet_length(`{text}`), 0) AS long) AS n_bytes")
    return rows.mapInPandas(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op3_overlap_resync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


QUERIES = {"op3_overlap_resync": op3_overlap_resync}
