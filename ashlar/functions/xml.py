"""ExtractValue and UpdateXML."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def extract_value(xml: Column, path: str) -> Column:
    """The text of all nodes that match, blank-joined; empty for none."""
    text = path if path.endswith("text()") or "@" in path.rsplit("/", 1)[-1] else f"{path}/text()"
    return F.when(xml.isNotNull(), F.array_join(F.xpath(xml, F.lit(text)), " "))


def update_xml(xml: Column, path: str, new: str) -> Column:
    """``xml`` with the one node at ``path`` replaced; unchanged unless exactly one matches.  Needs Python (Arrow batches)."""
    import xml.etree.ElementTree as tree

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        def one(v):
            if v is None:
                return None
            try:
                root = tree.fromstring(v)
            except tree.ParseError:
                return None
            inner = path.strip("/").split("/", 1)
            if inner[0] != root.tag:
                return v
            if len(inner) == 1:
                return new
            found = root.findall(inner[1])
            if len(found) != 1:
                return v
            parent = next(p for p in root.iter() if found[0] in list(p))
            at = list(parent).index(found[0])
            fresh = tree.fromstring(new)
            fresh.tail = found[0].tail
            parent.remove(found[0])
            parent.insert(at, fresh)
            return tree.tostring(root, encoding="unicode")

        return values.map(one)

    return run(xml)
