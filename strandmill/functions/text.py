"""Numbers as text, exactly as their binary values round: by Arrow batches, since the engine's own formats round ties otherwise."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _fixed(x: pd.Series, digits: pd.Series) -> pd.Series:
    return pd.Series([None if v is None or v != v else f"{v:.{d}f}" for v, d in zip(x, digits, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def _power(x: pd.Series, digits: pd.Series) -> pd.Series:
    out = []
    for v, d in zip(x, digits, strict=True):
        if v is None or v != v:
            out.append(None)
            continue
        mantissa, exponent = f"{v:.{d}e}".split("e")
        out.append(f"{mantissa}e{int(exponent)}")
    return pd.Series(out, dtype=object)


def fixed(x: Column, digits: int = 4) -> Column:
    """Frequencies and the like: digits behind the point; null stays null."""
    return _fixed(x.cast("double"), F.lit(digits))


def power(x: Column, digits: int = 3) -> Column:
    """p-values: mantissa and a bare exponent, such as 1.250e-3."""
    return _power(x.cast("double"), F.lit(digits))
