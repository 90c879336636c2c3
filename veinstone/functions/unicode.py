"""The one text function that Spark lacks: Unicode normalisation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql.functions import pandas_udf


@pandas_udf("string")
def nfc(text: pd.Series) -> pd.Series:
    """NFC form of a text; Arrow batches, as no built-in function does it."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))
