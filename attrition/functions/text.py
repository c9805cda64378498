"""Number-to-text formatting with Python's rounding.

Report tables print metrics as ``%.3f``.  Spark's ``format_string`` rounds the
decimal representation half-up (0.0625 -> "0.063") while the report rounds the
exact binary value half-to-even ("0.062"), so formatting runs as a small
Arrow-batched pandas UDF.  It is only applied to report-sized tables.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


@pandas_udf(StringType())
def _fixed3(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if pd.isna(v) else f"{float(v):.3f}")


@pandas_udf(StringType())
def _fixed2(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if pd.isna(v) else f"{float(v):.2f}")


@pandas_udf(StringType())
def _percent1(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if pd.isna(v) else f"{float(v):.1%}")


def fixed(col: Column | str, digits: int = 3) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    if digits == 3:
        return _fixed3(col.cast("double"))
    if digits == 2:
        return _fixed2(col.cast("double"))
    raise ValueError("digits must be 2 or 3")


def percent(col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return _percent1(col.cast("double"))


def markdown_row(*cols: Column | str) -> Column:
    """'| a | b | c |' for one table row (values already text)."""

    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("nan")) for c in cols]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *parts), F.lit(" |"))
