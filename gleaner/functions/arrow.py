"""The few functions Spark lacks, over Arrow batches."""

from __future__ import annotations

import unicodedata

import pandas as pd
import xxhash
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


@pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility-normalised text with single spaces; nothing left is null."""

    def one(x):
        return (" ".join(unicodedata.normalize("NFKC", x).split()) or None) if isinstance(x, str) else None

    return s.map(one)


@pandas_udf(StringType())
def xxhash_hex(s: pd.Series) -> pd.Series:
    """xxHash64 with seed 0 in hex."""
    return s.map(lambda x: xxhash.xxh64(x.encode()).hexdigest() if isinstance(x, str) else None)
