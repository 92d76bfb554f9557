"""Point-in-time joins: as-of by union and window, interval membership, announcement alignment, exact-day metadata.

The as-of join is one exchange on the key, one sort and a running last value; it never pairs rows with each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import unique_rows
from ..functions.numeric import close_to


def asof(left: DataFrame, right: DataFrame, *, on: str, left_time: str, right_time: str, take: list[str], right_on: str | None = None, strict: bool = False, tie: list[str] = ()) -> DataFrame:
    """left with the columns take of the last right row of its key at (strict: before) its time; rows of a null key pass
    with nulls. tie orders right rows of equal time."""
    side = F.lit(0 if strict else 1)  # which side comes first at one moment
    l = left.withColumns({"_t": F.col(left_time), "_side": side, "_row": F.lit(True), "_v": F.lit(None).cast(right.select(F.struct(*take).alias("v")).schema["v"].dataType)})
    r = right.where(F.col(right_on or on).isNotNull()).select(F.col(right_on or on).alias(on), F.col(right_time).alias("_t"), (1 - side).alias("_side"), F.struct(*take).alias("_v"), *[F.col(t).alias(f"_tie{k}") for k, t in enumerate(tie)])
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(on).orderBy("_t", "_side", *[f"_tie{k}" for k in range(len(tie))]).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_row")
    return out.select(*[F.col(c) for c in left.columns], *[F.when(F.col(on).isNotNull(), F.col(f"_v.{c}")).alias(c) for c in take])


def interval_membership(bars: DataFrame, members: DataFrame, levels=("l3", "l2", "l1")) -> DataFrame:
    """Bars with the membership active on their day (both ends count; of several the one that began last): industry_code
    and industry_name of the deepest level there is. Without an active one they are null."""
    m = members.select(F.col("symbol").alias("_symbol"), "in_date", "out_date", *[c for c in members.columns if c.endswith(("_code", "_name"))])
    have = [lv for lv in levels if f"{lv}_code" in members.columns]
    day = F.col("timestamp").cast("date")
    active = (m["in_date"] <= day) & (m["out_date"].isNull() | (m["out_date"] >= day))
    joined = bars.join(m, (bars["symbol"] == m["_symbol"]) & active, "left")
    deepest = lambda kind: F.coalesce(*[F.col(f"{lv}_{kind}") for lv in have if f"{lv}_{kind}" in members.columns], F.lit(None).cast("string"))
    best = F.max_by(F.struct(deepest("code").alias("code"), deepest("name").alias("name")), F.struct("in_date", deepest("code")))
    values = [c for c in bars.columns if c not in ("symbol", "timestamp")]
    out = joined.groupBy("symbol", "timestamp").agg(*[F.first(c).alias(c) for c in values], best.alias("_m"))
    return out.select(*bars.columns, F.col("_m.code").alias("industry_code"), F.col("_m.name").alias("industry_name"))


def align_announcements(bars: DataFrame, events: DataFrame, take: list[str], *, lag_days: int = 0) -> DataFrame:
    """Bars with the values of the latest report period among events effective by then (the later announcement day plus
    lag); inside a period the last effective, then the last in source order. An event is looked at once, at the first bar
    from its effective day on; if its period ends after that bar it is never seen."""
    e = events.withColumn("effective_at", F.date_add(F.greatest("ann_date", "f_ann_date"), lag_days).cast("timestamp_ntz")).where("effective_at IS NOT NULL AND end_date IS NOT NULL")
    order = "source_order" if "source_order" in events.columns else None
    v = F.struct(F.col("end_date").alias("period"), F.col("effective_at").alias("effective"), F.col(order or "effective_at").alias("order"), *take)
    l = bars.select(*bars.columns, F.col("timestamp").alias("_t"), F.lit(1).alias("_side"), F.lit(True).alias("_row"))
    r = e.select("symbol", F.col("effective_at").alias("_t"), F.lit(0).alias("_side"), v.alias("_v"))
    both = l.unionByName(r, allowMissingColumns=True)
    # backwards in time: a running last value, where a frame up to the end would be read again for each row
    back = Window.partitionBy("symbol").orderBy(F.desc("_t"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    first_bar = F.last(F.when(F.col("_row"), F.col("_t")), ignorenulls=True).over(back)
    both = both.withColumn("_v", F.when(F.col("_v.period") <= F.to_date(first_bar), F.col("_v")))
    w = Window.partitionBy("symbol").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_v", F.max("_v").over(w)).where("_row")
    return out.select(*bars.columns, F.col("_v.period").alias("report_period"), F.col("_v.effective").alias("effective_at"), *[F.col(f"_v.{c}").alias(c) for c in take])


def exact_day(bars: DataFrame, other: DataFrame, take: list[str], *, prefix: str = "") -> DataFrame:
    """Left join on (symbol, day). A day of a symbol with more than one row in other fails while the plan runs."""
    o = unique_rows(other.select(F.col("symbol").alias("_s"), F.col("timestamp").cast("date").alias("_d"), *[F.col(c).alias(f"{prefix}{c}") for c in take]), ["_s", "_d"], "exact-day table")
    return bars.join(o, (bars["symbol"] == o["_s"]) & (bars["timestamp"].cast("date") == o["_d"]), "left").drop("_s", "_d")


def join_context(bars: DataFrame, context: DataFrame, *, on: list[str] = ("timestamp",)) -> DataFrame:
    """Bars with the context columns (market_, sector_, multitf_) of their time. A key with more than one row in context
    fails while the plan runs."""
    take = [c for c in context.columns if c.startswith(("market_", "sector_", "multitf_"))]
    return bars.join(unique_rows(context.select(*on, *take), list(on), "context"), list(on), "left")


def suspended(bars: DataFrame, events: DataFrame | None, covered: DataFrame | None = None) -> DataFrame:
    """Bars with is_suspended: true on an event's day, false where the source covers the day, null where it does not.
    covered: (timestamp) days the source has; None with events: all days."""
    if events is None:
        return bars.withColumn("is_suspended", F.lit(None).cast("boolean"))
    e = events.select(F.col("symbol").alias("_s"), F.col("timestamp").cast("date").alias("_d"), F.lit(True).alias("_hit")).distinct()
    out = bars.join(e, (bars["symbol"] == e["_s"]) & (bars["timestamp"].cast("date") == e["_d"]), "left").drop("_s", "_d")
    if covered is None:
        known = F.lit(True)
    else:
        c = covered.select(F.col("timestamp").cast("date").alias("_c"), F.lit(True).alias("_known")).distinct()
        out = out.join(c, out["timestamp"].cast("date") == c["_c"], "left").drop("_c")
        known = F.col("_known")
    return out.withColumn("is_suspended", F.coalesce("_hit", F.when(known, F.lit(False)))).drop("_hit", "_known")


def overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left (symbol, start, end) that overlap any row of right of their symbol: right's ends run as a maximum over
    starts, so rows are not paired. An overlap is a right row that starts by left's end and ends from its start on."""
    keep = left.columns
    l = left.select(*keep, F.col("end").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema["end"].dataType).alias("_e"))
    r = right.select("symbol", F.col("start").alias("_t"), F.lit(0).alias("_side"), F.col("end").alias("_e"))
    w = Window.partitionBy("symbol").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_last", F.max("_e").over(w))
    return both.where("_side = 1 AND _last >= start").select(*keep)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def relative_strength(bars: DataFrame, context: DataFrame, *, on: str = "context_symbol", span: int = 20) -> DataFrame:
    """Bars with their span-bar return less that of the last context bar at or before them."""
    w = lambda key: Window.partitionBy(key).orderBy("timestamp")
    change = lambda key: F.col("close") / F.nullif(F.lag("close", span).over(w(key)), F.lit(0.0)) - 1
    ctx = context.withColumn("context_return", change("symbol")).select(F.col("symbol").alias("_c"), F.col("timestamp").alias("context_time"), "context_return")
    own = bars.withColumn("own_return", change("symbol"))
    out = asof(own, ctx, on=on, right_on="_c", left_time="timestamp", right_time="context_time", take=["context_time", "context_return"])
    return out.withColumn("relative_strength", F.col("own_return") - F.col("context_return"))


def tradability(panel: DataFrame) -> DataFrame:
    """panel (close, high, low, volume, up_limit, down_limit, is_suspended) with the three-valued screen: known only if
    suspension and limits are, eligible if known, not suspended, traded, and not locked at one price on a limit."""
    limits = F.col("up_limit").isNotNull() & F.col("down_limit").isNotNull()
    one_price = close_to(F.col("high"), F.col("low"))
    locked = one_price & (close_to(F.col("close"), F.col("up_limit")) | close_to(F.col("close"), F.col("down_limit")))
    known = F.col("is_suspended").isNotNull() & limits
    return panel.withColumns({
        "tradability_known": known, "one_price_locked": F.coalesce(locked, F.lit(False)),
        "tradability_eligible": known & ~F.coalesce(F.col("is_suspended"), F.lit(True)) & (F.coalesce("volume", F.lit(0.0)) > 0) & ~F.coalesce(locked, F.lit(False)),
    })


def missing_keys(expected: DataFrame, observed: DataFrame, by: str = "timestamp") -> DataFrame:
    """(by, missing): expected (symbol, timestamp) without an observed row, counted."""
    return expected.join(observed.select("symbol", "timestamp"), ["symbol", "timestamp"], "left_anti").groupBy(by).agg(F.count(F.lit(1)).alias("missing"))


def missing_shares(df: DataFrame) -> DataFrame:
    """(column, share) of columns with any null, in one pass."""
    shares = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("share")) for c in df.columns]))
    return shares.select(pairs.alias("p")).select("p.*").where("share > 0")
