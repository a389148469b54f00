"""Texts to word lists, as all counting and distance features take them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stem import stem_lists
from ..functions.text import tokens, without


def preprocess(df: DataFrame, fields: list[str], *, stop: list[str] = (), stem: bool = True, stop_first: bool = False) -> DataFrame:
    """`df` with <field>_tokens for each text field: its words, stemmed, then without those of a stop list.

    The list is held against stems, so a stop word whose stem is another word
    ("this") stays unless the list has that stem; with `stop_first`, as for
    weighted terms, it is held against the words before they are stemmed.  A
    null or empty text has no words.
    """
    names = [f"{f}_tokens" for f in fields]
    out = df.withColumns({n: tokens(F.col(f)) for n, f in zip(names, fields, strict=True)})
    kept = {n: without(F.col(n), list(stop)) for n in names}
    if not stem:
        return out.withColumns(kept)
    if stop_first:
        return stem_lists(out.withColumns(kept), names)
    return stem_lists(out, names).withColumns(kept)
