"""Feature rows of segments: one range join within a symbol, windows within a segment, one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import pearson, ratio, safe_ln
from .indicators import atr
from .segments import with_bars

CONTEXT = ("market_", "sector_", "multitf_")
FEATURES = (
    "direction", "cumulative_return", "log_price_slope", "amplitude", "max_drawdown", "duration_bars", "duration_days", "return_volatility", "atr_mean",
    "atr_pct_mean", "volume_mean", "volume_median", "volume_cv", "volume_trend", "price_volume_corr", "up_volume_ratio", "body_ratio_mean",
    "upper_shadow_ratio_mean", "lower_shadow_ratio_mean", "doji_ratio", "bullish_candle_ratio", "gap_ratio", "realized_range_mean",
)
#: Features that causal discovery runs on (fixed values).
CAUSAL_FEATURES = (
    "cumulative_return", "log_price_slope", "amplitude", "max_drawdown", "duration_bars", "return_volatility", "atr_pct_mean", "volume_cv", "up_volume_ratio",
    "body_ratio_mean", "upper_shadow_ratio_mean", "lower_shadow_ratio_mean", "boundary_uncertainty",
)


def segment_features(segments: DataFrame, bars: DataFrame) -> DataFrame:
    """(segment_id, features...). The average true range is of the default period over a symbol's whole history; returns,
    gaps and volume changes are within the segment, so its first bar has none."""
    context = [c for c in bars.columns if c.startswith(CONTEXT)]
    rows = with_bars(segments, bars.join(atr(bars), ["symbol", "timestamp"]), [])
    rows = rows.select("segment_id", "idx", "timestamp", "open", "high", "low", "close", "volume", "atr", *context)
    w = Window.partitionBy("segment_id").orderBy("idx")
    before, volume_before = F.lag("close").over(w), F.lag("volume").over(w)
    o, h, lo, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    span = F.nullif(h - lo, F.lit(0.0))
    rows = rows.withColumns({
        "ret": ratio(c, before) - 1, "fall": ratio(c, F.max("close").over(w.rowsBetween(Window.unboundedPreceding, 0))) - 1,
        # a change from volume 0 to more is infinite and leaves no correlation
        "vol_change": ratio(v, volume_before) - 1, "broken": F.coalesce((volume_before == 0) & (v > 0), F.lit(False)), "rise": F.coalesce(c > before, F.lit(False)),
        "body": F.abs(c - o) / span, "upper": (h - F.greatest(o, c)) / span, "lower": (F.least(o, c) - lo) / span, "gap": F.abs(ratio(o, before) - 1),
    })
    first, last = F.min_by("close", "idx"), F.max_by("close", "idx")
    ret = last / F.nullif(first, F.lit(0.0)) - 1
    slope = lambda y: F.coalesce(F.regr_slope(y, F.col("idx").cast("double")), F.lit(0.0))
    pairs = F.col("ret").isNotNull() & F.col("vol_change").isNotNull()
    correlation = F.when((F.count(F.when(pairs, 1)) >= 3) & ~F.bool_or("broken"), pearson("ret", "vol_change"))
    share = lambda x: F.avg(F.coalesce(x, F.lit(False)).cast("double"))
    values = {
        "direction": F.when(ret > 0.002, "up").when(ret < -0.002, "down").otherwise("flat"), "cumulative_return": ret, "log_price_slope": slope(safe_ln("close")),
        "amplitude": F.max("high") / F.nullif(F.min("low"), F.lit(0.0)) - 1, "max_drawdown": F.min("fall"), "duration_bars": F.count(F.lit(1)),
        "duration_days": F.floor((F.unix_timestamp(F.max("timestamp").cast("timestamp")) - F.unix_timestamp(F.min("timestamp").cast("timestamp"))) / 86400),
        "return_volatility": F.stddev_pop("ret"), "atr_mean": F.avg("atr"), "atr_pct_mean": F.avg(ratio("atr", "close")), "volume_mean": F.avg("volume"),
        "volume_median": F.median("volume"), "volume_cv": F.stddev_pop("volume") / F.nullif(F.avg("volume"), F.lit(0.0)), "volume_trend": slope(F.log1p(F.greatest(v, F.lit(0.0)))),
        "price_volume_corr": correlation, "up_volume_ratio": F.sum(F.when(F.col("rise"), v).otherwise(0.0)) / F.nullif(F.sum("volume"), F.lit(0.0)),
        "body_ratio_mean": F.avg("body"), "upper_shadow_ratio_mean": F.avg("upper"), "lower_shadow_ratio_mean": F.avg("lower"), "doji_ratio": share(F.col("body") < 0.1),
        "bullish_candle_ratio": share(c > o), "gap_ratio": F.avg("gap"), "realized_range_mean": F.avg(ratio(h - lo, c)),
    }
    out = [x.alias(n) for n, x in values.items()]
    for name in context:
        if isinstance(bars.schema[name].dataType, T.NumericType):
            out += [F.avg(name).alias(f"{name}_mean"), F.max_by(name, "idx").alias(f"{name}_end")]
        else:
            out.append(F.max_by(name, F.when(F.col(name).isNotNull(), F.col("idx"))).alias(f"{name}_end"))
    return rows.groupBy("segment_id").agg(*out)
