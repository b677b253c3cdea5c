"""A fixed-size filter that spares joins most of the rows that have no partner."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter: 8 MB, whatever the number of values. With more values it lets more rows through, and loses none.
BITS = 1 << 26
_PAGE = 32768


def likely_in(values: DataFrame, column: str) -> Callable[[Column], Column]:
    """A test that holds for every value of values[column] and for few others; null fails it."""
    place = lambda x: F.pmod(F.xxhash64(x), F.lit(BITS))
    at = values.where(F.col(column).isNotNull()).select(place(F.col(column)).alias("p"))
    pages = at.groupBy(F.expr(f"p div {_PAGE}").alias("page")).agg(F.bitmap_construct_agg(F.col("p") % _PAGE).alias("bits"))
    bits = np.zeros(BITS // 8, np.uint8)
    for row in pages.toLocalIterator():
        start = row["page"] * _PAGE // 8
        bits[start : start + _PAGE // 8] = np.frombuffer(row["bits"], np.uint8)
    shared = values.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def holds(p: pd.Series) -> pd.Series:
        p = p.to_numpy(np.int64)
        return pd.Series((shared.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0)

    return lambda x: x.isNotNull() & holds(place(x))
