"""Indicators over bars as windows; only Wilder's recursion is a grouped kernel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.numeric import clip, ratio, safe_ln
from .bars import numbered


def by_symbol():
    return Window.partitionBy("symbol").orderBy("timestamp")


def true_range(bars: DataFrame, name: str = "true_range") -> DataFrame:
    before = F.lag("close").over(by_symbol())
    return bars.withColumn(name, F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def atr(bars: DataFrame, period: int = 14) -> DataFrame:
    """(symbol, timestamp, atr): Wilder's average of the true range over the whole history of a symbol."""
    rows = true_range(bars).select("symbol", "timestamp", "true_range")

    def run(pdf):
        pdf = pdf.sort_values("timestamp")
        return pdf.assign(atr=kernels.wilder(pdf["true_range"].to_numpy(float), period))[["symbol", "timestamp", "atr"]]

    return rows.groupBy("symbol").applyInPandas(run, "symbol string, timestamp timestamp_ntz, atr double")


def returns(bars: DataFrame, span: int = 20) -> DataFrame:
    """Bars with one-bar and span-bar returns and the sample deviation of the last span one-bar returns, if all are there."""
    out = bars.withColumn("return_1", ratio("close", F.lag("close").over(by_symbol())) - 1).withColumn(f"return_{span}", ratio("close", F.lag("close", span).over(by_symbol())) - 1)
    w = by_symbol().rowsBetween(1 - span, 0)
    return out.withColumn(f"volatility_{span}", F.when(F.count("return_1").over(w) == span, F.stddev_samp("return_1").over(w)))


def fractal_pivots(bars: DataFrame, window: int = 2, least: float = 0.35, period: int = 14) -> DataFrame:
    """(symbol, idx, prominence, probability): local highs and lows that stand out by `least` average true ranges."""
    before, after = by_symbol().rowsBetween(-window, -1), by_symbol().rowsBetween(1, window)
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    rows = numbered(bars).join(atr(bars, period), ["symbol", "timestamp"]).withColumn("n", n)
    unit = F.greatest("atr", F.lit(1e-12))
    peak = (F.col("high") - F.greatest(F.max("high").over(before), F.max("high").over(after))) / unit
    trough = (F.least(F.min("low").over(before), F.min("low").over(after)) - F.col("low")) / unit
    rows = rows.withColumn("prominence", F.greatest(peak, trough)).where(f"idx >= {window} AND idx < n - {window} AND prominence >= {least}D")
    return rows.select("symbol", "idx", "prominence", clip(F.lit(0.38) + F.lit(0.18) * F.col("prominence"), 0.40, 0.82).alias("probability"))


def structure_scores(bars: DataFrame, min_bars: int = 4) -> DataFrame:
    """(symbol, idx, score): the largest shift between the means of the span before and after a bar, in robust units, of
    return, its size, relative range and log volume. The span, of the root of a symbol's length, differs by symbol, so
    window means are differences of running sums."""
    rows = numbered(bars).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    rows = rows.withColumn("span", F.greatest(F.lit(min_bars), F.floor(F.sqrt("n")).cast("int"))).where("n >= 2 * span + 1")
    change = F.coalesce(safe_ln("close") - F.lag(safe_ln("close")).over(by_symbol()), F.lit(0.0))
    rows = rows.withColumns({"s0": change, "s2": F.coalesce(ratio(F.col("high") - F.col("low"), "close"), F.lit(0.0)), "s3": F.log1p(F.greatest("volume", F.lit(0.0)))}).withColumn("s1", F.abs("s0"))
    names = ("s0", "s1", "s2", "s3")
    middle = rows.groupBy("symbol").agg(*[F.median(s).alias(f"m_{s}") for s in names])
    rows = rows.join(middle, "symbol")
    spread = rows.groupBy("symbol").agg(*[(F.median(F.abs(F.col(s) - F.col(f"m_{s}"))) * 1.4826 + 1e-9).alias(f"d_{s}") for s in names])
    so_far = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(spread, "symbol").withColumns({f"c_{s}": F.sum(s).over(so_far) for s in names})
    # a bar's running sums are wanted by four other bars of its symbol: they are sent there, in the partitioning of the windows
    i, k = F.col("idx"), F.col("span")
    sums = F.struct(*[F.col(f"c_{s}").alias(s) for s in names])
    sent = F.array(*[F.struct(at.cast("int").alias("idx"), F.lit(role).alias("role")) for role, at in (("own", i), ("ahead", i - k), ("last", i + 1), ("far", i + k + 1))])
    sent = rows.select("symbol", "n", "span", *[f"d_{s}" for s in names], sums.alias("c"), F.explode(sent).alias("to")).where("to.idx >= 0 AND to.idx < n")
    met = sent.groupBy("symbol", F.col("to.idx").alias("idx")).agg(F.first("n").alias("n"), F.first("span").alias("span"), *[F.first(f"d_{s}").alias(f"d_{s}") for s in names], *[F.max(F.when(F.col("to.role") == r, F.col("c"))).alias(r) for r in ("own", "ahead", "last", "far")])
    at = lambda role, s: F.coalesce(F.col(f"{role}.{s}"), F.lit(0.0))
    shift = lambda s: F.abs(((at("ahead", s) - at("own", s)) - (at("last", s) - at("far", s))) / k) / F.col(f"d_{s}")
    inside = (i >= k) & (i < F.col("n") - k)
    return met.select("symbol", "idx", F.when(inside, F.greatest(*[shift(s) for s in names])).otherwise(F.lit(0.0)).alias("score"))


def market_regimes(bars: DataFrame, window: int = 20, threshold: float = 0.05) -> DataFrame:
    """A row a date: the median one-bar return of all symbols, its trailing product and volatility, and a regime; before a
    full window UNKNOWN. One row a date is ordered in one task."""
    if window < 2 or threshold < 0:
        raise ValueError("window must be at least 2 and threshold not negative")
    daily = bars.withColumn("r", ratio("close", F.lag("close").over(by_symbol())) - 1).groupBy("timestamp").agg(F.median("r").alias("sample_market_return"))
    w = Window.orderBy("timestamp").rowsBetween(1 - window, 0)
    full = F.count(F.lit(1)).over(w) == window
    r = F.col("sample_market_return")
    out = daily.where(r.isNotNull()).withColumns({
        "market_proxy_trailing_return": F.when(full, F.product(1 + r).over(w) - 1),
        "market_proxy_trailing_volatility": F.when(full, F.stddev_samp(r).over(w) * F.sqrt(F.lit(252.0))),
    })
    t = F.col("market_proxy_trailing_return")
    return out.withColumn("market_proxy_regime", F.when(t.isNull(), "UNKNOWN").when(t > threshold, "BULL_PROXY").when(t < -threshold, "BEAR_PROXY").otherwise("SIDEWAYS_PROXY"))
