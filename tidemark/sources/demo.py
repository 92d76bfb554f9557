"""A seeded table of bars to try things on."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import keyed_rng


def demo_bars(spark: SparkSession, symbols: tuple[str, ...] = ("AAA", "BBB", "CCC"), n: int = 285, seed: int = 7) -> DataFrame:
    """n business days a symbol with drifts that change every 40 bars; a symbol's bars depend on (seed, symbol) alone."""

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        symbol = pdf["symbol"].iloc[0]
        rng = keyed_rng(seed, symbol)
        drift = np.repeat(rng.normal(0, 0.006, n // 40 + 1), 40)[:n]
        close = 50 * np.exp(np.cumsum(drift + rng.normal(0, 0.012, n)))
        open_ = np.r_[close[0], close[:-1]] * np.exp(rng.normal(0, 0.003, n))
        wide = np.exp(np.abs(rng.normal(0, 0.006, n)))
        return pd.DataFrame({"symbol": symbol, "timestamp": pd.bdate_range("2022-01-03", periods=n), "open": open_, "high": np.maximum(open_, close) * wide, "low": np.minimum(open_, close) / wide, "close": close, "volume": rng.uniform(1e5, 9e5, n).round()})

    names = spark.createDataFrame([(s,) for s in symbols], "symbol string")
    out = names.groupBy("symbol").applyInPandas(make, "symbol string, timestamp timestamp, open double, high double, low double, close double, volume double")
    return out.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
