"""The queries ``opN_<name>`` and their SQL twins, gathered from the operator modules."""

from __future__ import annotations

from ashlar.llm import jaccard_join, mixing, mpeg, packing, paragraph_dedup, quality_mil, secrets, spann, token_counts, toxicity

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (quality_mil, mpeg, token_counts, secrets, jaccard_join, packing, paragraph_dedup, spann, mixing, toxicity):
    QUERIES |= _module.QUERIES
    ORACLES |= getattr(_module, "ORACLES", {})
