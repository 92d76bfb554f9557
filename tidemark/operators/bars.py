"""Bars: normalising, resampling, price adjustment, calendars and universes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.checks import require

#: Vendor names (fixed values).
ALIASES = {"ts_code": "symbol", "trade_date": "timestamp", "vol": "volume"}
PRICES = ("open", "high", "low", "close")
NUMERIC = (*PRICES, "volume")
BAR = ("symbol", "timestamp", *NUMERIC)


def as_timestamp(df: DataFrame, name: str) -> F.Column:
    """timestamp_ntz of a text, date, timestamp or yyyymmdd whole number; null if it is none."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.IntegralType):
        c, kind = c.cast("string"), T.StringType()
    if isinstance(kind, T.StringType):
        plain = F.when(c.rlike("^[0-9]{8}$"), F.try_to_timestamp(c, F.lit("yyyyMMdd"))).otherwise(F.try_to_timestamp(c))
        return plain.cast("timestamp_ntz")
    return c.cast("timestamp_ntz")


def normalize(df: DataFrame, ordinal: str | None = None) -> DataFrame:
    """Bars with vendor names resolved, types coerced, incomplete keys and prices dropped, the last of equal (symbol,
    timestamp) kept by ordinal (order of arrival; Spark rows have none of their own), values carried forward in a symbol,
    and missing volume 0. Other columns stay."""
    df = df.withColumnsRenamed({k: v for k, v in ALIASES.items() if k in df.columns})
    require(df, BAR, "bars")
    df = df.withColumns({"timestamp": as_timestamp(df, "timestamp"), **{c: F.expr(f"try_cast({c} AS double)") for c in NUMERIC}})
    df = df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in NUMERIC})
    df = df.dropna(subset=["symbol", "timestamp", *PRICES])
    arrival = F.col(ordinal) if ordinal else F.monotonically_increasing_id()
    last = Window.partitionBy("symbol", "timestamp").orderBy(F.desc("_arrival"))
    df = df.withColumn("_arrival", arrival).withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_arrival")
    so_far = Window.partitionBy("symbol").orderBy("timestamp").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("volume", F.coalesce(F.last("volume", ignorenulls=True).over(so_far), F.lit(0.0)))


def numbered(bars: DataFrame, name: str = "idx") -> DataFrame:
    """Bars with their 0-based position in their symbol."""
    return bars.withColumn(name, (F.row_number().over(Window.partitionBy("symbol").orderBy("timestamp")) - 1).cast("int"))


def resample(bars: DataFrame, unit: str = "day") -> DataFrame:
    return bars.groupBy("symbol", F.date_trunc(unit, "timestamp").cast("timestamp_ntz").alias("timestamp")).agg(
        F.min_by("open", "timestamp").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "timestamp").alias("close"), F.sum("volume").alias("volume")
    )


def adjust(df: DataFrame, mode: str, anchors: DataFrame | float | None = None, *, columns=(*PRICES, "pre_close")) -> DataFrame:
    """raw: unchanged; hfq: price x factor; qfq: that over the anchor's factor, one number or a table (ts_code, anchor)."""
    if mode == "raw":
        return df
    if mode not in ("hfq", "qfq"):
        raise ValueError(f"unknown adjustment {mode!r}")
    by = F.col("adj_factor")
    if mode == "qfq":
        if anchors is None:
            raise ValueError("qfq needs an anchor")
        if isinstance(anchors, DataFrame):
            df = df.join(anchors.select("ts_code", F.col("anchor").alias("_anchor")), "ts_code", "left")
            by = by / F.nullif(F.col("_anchor"), F.lit(0.0))
        else:
            by = by / F.lit(float(anchors))
    return df.withColumns({c: F.col(c) * by for c in columns if c in df.columns}).drop("_anchor")


def anchor_factors(df: DataFrame, anchor_date) -> DataFrame:
    """(ts_code, anchor): the last known factor of each code up to the anchor date."""
    known = df.where((F.col("timestamp") <= F.lit(anchor_date)) & F.col("adj_factor").isNotNull())
    return known.groupBy("ts_code").agg(F.max_by("adj_factor", "timestamp").alias("anchor"))


def segmentation_prices(df: DataFrame, mode: str, anchor_date=None) -> DataFrame:
    """Prices segments may be cut on: hfq, or qfq from the anchor date on for codes with a bar on that date."""
    if mode == "hfq":
        return adjust(df, "hfq")
    on_day = df.where((F.col("timestamp") == F.lit(anchor_date)) & F.col("adj_factor").isNotNull()).select("ts_code", F.col("adj_factor").alias("anchor"))
    return adjust(df.where(F.col("timestamp") >= F.lit(anchor_date)).join(on_day.select("ts_code"), "ts_code", "left_semi"), "qfq", on_day)


def trade_calendar(calendar: DataFrame) -> DataFrame:
    return calendar.where(F.col("is_open").cast("string") == "1").select("cal_date").distinct()


def date_chunks(spark, start: str, end: str, months: int) -> DataFrame:
    """Inclusive pieces of [start, end] that do not overlap."""
    if months < 1:
        raise ValueError("months must be positive")
    days = spark.range(1).select(F.explode(F.expr(f"sequence(DATE '{start}', DATE '{end}', INTERVAL {months} MONTH)")).alias("chunk_start"))
    return days.withColumn("chunk_end", F.least(F.expr(f"date_sub(add_months(chunk_start, {months}), 1)"), F.lit(end).cast("date")))


def universe(master: DataFrame, start, end) -> DataFrame:
    """Codes listed on any day of [start, end]."""
    return master.where((F.col("list_date") <= F.lit(end).cast("date")) & (F.col("delist_date").isNull() | (F.col("delist_date") >= F.lit(start).cast("date"))))


def listed_on_day(bars: DataFrame, master: DataFrame) -> DataFrame:
    """Bars of codes listed on their day; the delisting day counts."""
    m = master.select(F.col("ts_code").alias("_code"), "list_date", "delist_date")
    day = F.col("timestamp").cast("date")
    listed = (F.col("list_date") <= day) & (F.col("delist_date").isNull() | (F.col("delist_date") >= day))
    return bars.join(m, (bars["ts_code"] == m["_code"]) & listed, "left_semi")
