"""Compatibility folding of text (the NFKC form)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F


def fold_compatible(c: Column) -> Column:
    """Ligatures, circled and wide forms, half-width kana and the like as plain characters; null stays null.

    No built-in folds text and a table of some five thousand forms looked up for
    each character is far slower, so whole batches go through the standard
    library. Texts of ASCII alone stay on the JVM.
    """

    @F.pandas_udf("string")
    def folded(texts: pd.Series) -> pd.Series:
        from unicodedata import normalize

        return texts.map(lambda t: normalize("NFKC", t), na_action="ignore")

    return F.coalesce(folded(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)
