"""Unicode forms, for which Spark has no function of its own: Arrow batches through the standard library."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition, without soft hyphens; null stays null."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t).replace("\u00ad", ""), na_action="ignore")


@F.pandas_udf(T.StringType())
def duplicate_key(text: pd.Series) -> pd.Series:
    """Canonical composition, full case folding, and all white space as single blanks."""
    return text.map(lambda t: " ".join(unicodedata.normalize("NFC", t).casefold().split()), na_action="ignore")


@F.pandas_udf(T.StringType())
def compat_fold(text: pd.Series) -> pd.Series:
    """Compatibility composition and full case folding; null stays null. Plain ASCII takes the short way."""
    return text.map(lambda t: t.lower() if t.isascii() else unicodedata.normalize("NFKC", t).casefold(), na_action="ignore")


# Typographic hyphens and quotes, and what stands for them.
TYPOGRAPHY = {"‐": "-", "‑": "-", "‘": "'", "’": "'", "“": '"', "”": '"'}


@F.pandas_udf(T.StringType())
def quote_key(text: pd.Series) -> pd.Series:
    """Canonical composition, plain quotes and hyphens, single blanks."""
    plain = str.maketrans(TYPOGRAPHY)
    return text.map(lambda t: " ".join(unicodedata.normalize("NFC", t).translate(plain).split()), na_action="ignore")
