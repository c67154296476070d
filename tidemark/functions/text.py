"""Unicode folding, which Spark has no function for: Arrow batches through a vectorised function, one pass over a column."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Katakana to hiragana: each letter of the first block lies 96 code points above its twin.
_KANA = {k: k - 96 for k in range(0x30A1, 0x30F7)}


def normalized(text: Column) -> Column:
    """NFKC, with runs of white space as one space and none around."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()))

    return F.pandas_udf(run, "string")(text)


def folded(text: Column) -> Column:
    """NFKC in lower case without punctuation, symbols and white space; katakana as hiragana."""

    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None:
                return None
            kept = (c for c in unicodedata.normalize("NFKC", t).lower() if unicodedata.category(c)[0] not in "PSZC")
            return "".join(kept).translate(_KANA)

        return texts.map(one)

    return F.pandas_udf(run, "string")(text)
