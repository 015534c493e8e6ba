"""Named user functions for SQL: the hook for site-specific image and table steps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def hamming_bits(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(np.bitwise_count((a.astype("int64") ^ b.astype("int64")).to_numpy().view("uint64")).astype("int64"))


class Ramp:
    """Table function: one row per level of an exposure ramp."""

    def eval(self, start: float, step: float, n: int):
        for i in range(n):
            yield i, start + i * step


class Plugins:
    """Register vectorised functions (Arrow batches) and table functions by name."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.names: list[str] = []

    def scalar(self, name: str, fn, returns: str) -> None:
        """``fn`` maps pandas Series to a Series; annotate its arguments."""
        self.spark.udf.register(name, F.pandas_udf(fn, returns))
        self.names.append(name)

    def table(self, name: str, cls, returns: str) -> None:
        self.spark.udtf.register(name, F.udtf(cls, returnType=returns))
        self.names.append(name)
