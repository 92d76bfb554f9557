"""Cross-sectional research: strict as-of states, forward targets on the session calendar, neutral scores, rank IC,
quantile groups, turnover, robust t, and walk-forward ridge. States and targets never feed back into segmentation."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import STATE_TOKENS, reject_look_ahead, require
from ..functions.numeric import average_rank, finite, keep_last, pearson, ratio
from ..session import cut
from .asof import asof


def same_day():
    return Window.partitionBy("timestamp")


def sessions(bars: DataFrame) -> DataFrame:
    """(timestamp, session): distinct times numbered; one row a time is ordered in one task."""
    return bars.select("timestamp").distinct().withColumn("session", F.row_number().over(Window.orderBy("timestamp")))


def join_states(bars: DataFrame, states: DataFrame, take: list[str], *, allow_same: bool = False) -> DataFrame:
    """bars with the last state before (allow_same: at) their time. Of states of one symbol and time the last as read counts."""
    reject_look_ahead(states.columns, STATE_TOKENS)
    require(states, ("symbol", "timestamp"), "states")
    states = keep_last(states, ["symbol", "timestamp"])
    return asof(bars, states.withColumnRenamed("timestamp", "state_at"), on="symbol", left_time="timestamp", right_time="state_at", take=take, strict=not allow_same)


def forward_targets(bars: DataFrame, horizons=(5, 20, 60), benchmark: str | None = None) -> DataFrame:
    """bars with future_excess, future_mae, future_reward_risk, future_rank and target_available_at for each horizon of
    market sessions (and target_tradable where bars have selection_eligible). A missing bar stays missing."""
    if not horizons or min(horizons) < 1:
        raise ValueError("horizons must be positive")
    calendar = sessions(bars)
    # rows of a symbol by session number: a range window of sessions sees exactly the sessions ahead
    out = bars.join(calendar, "timestamp")
    own = Window.partitionBy("symbol").orderBy("session")
    for h in horizons:
        at = own.rangeBetween(h, h)
        ahead = own.rangeBetween(1, h)
        gross = ratio(F.max("close").over(at), "close") - 1
        out = out.withColumn(f"future_excess_{h}d", gross)
        low = F.when(F.count("low").over(ahead) == h, F.min("low").over(ahead)) if "low" in bars.columns else F.lit(None).cast("double")
        out = out.withColumn(f"future_mae_{h}d", ratio(low, "close") - 1)
        if "selection_eligible" in bars.columns:
            out = out.withColumn(f"target_tradable_{h}d", F.max("selection_eligible").over(at))
    for h in horizons:
        later = calendar.select((F.col("session") - h).alias("session"), F.col("timestamp").alias(f"target_available_at_{h}d"))
        out = out.join(later, "session", "left")
        if benchmark is not None:
            b = bars.where(F.col("symbol") == benchmark).select("timestamp", "close").join(calendar, "timestamp")
            b = b.select("session", F.col("close").alias("_now")).join(b.select((F.col("session") - h).alias("session"), F.col("close").alias("_then")), "session").select("session", (ratio("_then", "_now") - 1).alias("_b"))
            out = out.join(b, "session", "left").withColumn(f"future_excess_{h}d", F.col(f"future_excess_{h}d") - F.col("_b")).drop("_b")
        out = out.withColumn(f"future_reward_risk_{h}d", ratio(f"future_excess_{h}d", F.abs(f"future_mae_{h}d")))
        known = F.count(f"future_excess_{h}d").over(same_day())
        out = out.withColumn(f"future_rank_{h}d", average_rank(f"future_excess_{h}d", ["timestamp"]) / F.nullif(known.cast("double"), F.lit(0.0)))
    return out.drop("session")


def selection_dataset(bars: DataFrame, states: DataFrame, take: list[str], *, horizons=(5, 20, 60), benchmark: str | None = None, allow_same: bool = False) -> DataFrame:
    """Bars with the states known before their time and the targets of each horizon, one row a symbol and time: of repeated
    keys the last as read stays, on both sides."""
    require(bars, ("symbol", "timestamp", "close"), "bars")
    bars = keep_last(bars.withColumn("close", F.expr("try_cast(close AS double)")), ["symbol", "timestamp"])
    return forward_targets(join_states(bars, states, take, allow_same=allow_same), horizons, benchmark)


def neutralise(df: DataFrame, value: str, *, industry: str | None = "industry", size: str | None = "market_cap", name: str | None = None) -> DataFrame:
    """df with the same-day least-squares residual of value on log size and industry. Both controls: size and value are
    demeaned within an industry and the slope taken between them. With no more valid rows than columns the raw value stays;
    rows without a value or size have none."""
    name = name or f"{value}_neutral"
    by = Window.partitionBy("timestamp")
    x = F.ln(F.greatest(F.col(size).cast("double"), F.lit(1.0))) if size and size in df.columns else None
    # a null industry has no column of its own, so its rows share the constant with the first industry
    key = None
    if industry and industry in df.columns:
        key = F.coalesce(F.col(industry).cast("string"), F.min(F.col(industry).cast("string")).over(by))
    df = df.withColumn("_y", finite(F.col(value).cast("double"))).withColumn("_x", finite(x) if x is not None else F.lit(0.0)).withColumn("_k", key if key is not None else F.lit(""))
    valid = F.col("_y").isNotNull() & F.col("_x").isNotNull()
    columns = 1 + (1 if x is not None else 0) + (F.greatest(F.size(F.collect_set(F.col(industry).cast("string")).over(by)) - 1, F.lit(0)) if key is not None else F.lit(0))
    group = Window.partitionBy("timestamp", "_k")
    mean = lambda c: F.avg(F.when(valid, F.col(c))).over(group)
    df = df.withColumns({"_n": F.count(F.when(valid, 1)).over(by), "_p": columns, "_dy": F.when(valid, F.col("_y") - mean("_y")), "_dx": F.when(valid, F.col("_x") - mean("_x"))})
    sxx, sxy = F.sum(F.col("_dx") * F.col("_dx")).over(by), F.sum(F.col("_dx") * F.col("_dy")).over(by)
    slope = F.when(sxx > 1e-12, sxy / sxx).otherwise(0.0)
    residual = F.col("_dy") - slope * F.col("_dx")
    return df.withColumn(name, F.when(F.col("_n") <= F.col("_p"), F.col("_y")).otherwise(residual)).drop("_y", "_x", "_k", "_n", "_p", "_dy", "_dx")


def rank_ic(df: DataFrame, score: str, target: str, by: str = "timestamp") -> DataFrame:
    """(by, n, rank_ic): Spearman of the pairs without nulls, if there are three, to 12 digits (so that 0 is 0)."""
    pairs = df.select(by, finite(score).alias("s"), finite(target).alias("t")).where("s IS NOT NULL AND t IS NOT NULL")
    ranks = pairs.withColumns({"rs": average_rank("s", [by]), "rt": average_rank("t", [by])})
    out = ranks.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(pearson("rs", "rt"), 12).alias("rank_ic"))
    return out.withColumn("rank_ic", F.when(F.col("n") >= 3, F.col("rank_ic")))


def quantile_groups(df: DataFrame, score: str, groups: int = 5, name: str = "group") -> DataFrame:
    """df with the 0-based quantile group of each day by score, ties in order of symbol; none with fewer scores than groups.
    Row r of n is in group ceil((r - 1) groups / (n - 1)) - 1, the first in 0, in exact arithmetic."""
    if groups < 2:
        raise ValueError("groups must be at least 2")
    has = F.col(score).isNotNull()
    r = F.row_number().over(Window.partitionBy("timestamp", has).orderBy(score, "symbol"))
    n = F.count(score).over(same_day())
    step = (F.col("_r") - 1) * groups
    exact = F.expr("(_s + _n - 2) DIV (_n - 1)")  # ceiling of whole numbers
    df = df.withColumns({"_r": r, "_n": n}).withColumn("_s", step)
    return df.withColumn(name, F.when(has & (F.col("_n") >= groups), F.greatest(exact, F.lit(1)) - 1).cast("int")).drop("_r", "_n", "_s")


def group_returns(df: DataFrame, target: str, group: str = "group") -> DataFrame:
    """(timestamp, group, mean_return)."""
    return df.where(F.col(group).isNotNull() & F.col(target).isNotNull()).groupBy("timestamp", group).agg(F.avg(target).alias("mean_return"))


def monotonicity(df: DataFrame, target: str, group: str = "group") -> DataFrame:
    """One row: Spearman of group number and mean return over days."""
    means = group_returns(df, target, group).groupBy(group).agg(F.avg("mean_return").alias("m")).withColumn("_one", F.lit(1))
    ranked = means.withColumns({"a": average_rank(group, ["_one"]), "b": average_rank("m", ["_one"])})  # a row a group
    return ranked.agg(pearson("a", "b").alias("monotonicity"))


def rebalance_days(df: DataFrame, every: int) -> DataFrame:
    if every < 1:
        raise ValueError("every must be positive")
    return sessions(df).where((F.col("session") - 1) % every == 0).withColumn("k", ((F.col("session") - 1) / every).cast("int")).select("timestamp", "k")


def long_short(df: DataFrame, target: str, *, every: int, cost_bps: float = 0.0, group: str = "group") -> DataFrame:
    """(timestamp, turnover, gross, net) of each rebalance day with weights: +1/n on its top group, -1/n on its bottom.
    Turnover is half the absolute change of weights, 0 on the first day; gross takes the last and first group of all days."""
    return _long_short(cut(df.select("timestamp", "symbol", group, target)), target, every, cost_bps, group)


def _long_short(df: DataFrame, target: str, every: int, cost_bps: float, group: str = "group") -> DataFrame:
    # rows are read twice: for one row a day and group, from which days, ends and weights follow, and for the weights' symbols
    per = cut(df.groupBy("timestamp", group).agg(F.avg(target).alias("mean_return"), F.count(F.lit(1)).alias("n")))  # a row a day and group
    days = rebalance_days(per, every).select("timestamp")
    some = per.where(F.col(group).isNotNull()).join(days, "timestamp")
    some = some.withColumns({"_top": F.max(group).over(same_day()), "_low": F.min(group).over(same_day())}).where(f"`{group}` = _top OR `{group}` = _low")
    weight = some.select("timestamp", group, F.when(F.col(group) == F.col("_top"), 1.0 / F.col("n")).otherwise(-1.0 / F.col("n")).alias("w"))
    held = df.select("timestamp", "symbol", group).join(weight, ["timestamp", group]).select("timestamp", "symbol", "w")
    # days with weights are numbered; a weight changes against the day before, where a missing one is 0
    order = weight.select("timestamp").distinct().withColumn("j", F.row_number().over(Window.orderBy("timestamp")))
    w = held.join(order, "timestamp").select("symbol", "j", "w")
    moves = w.unionByName(w.select("symbol", (F.col("j") + 1).alias("j"), (-F.col("w")).alias("w"))).groupBy("symbol", "j").agg(F.sum("w").alias("d"))
    turnover = moves.groupBy("j").agg((F.sum(F.abs("d")) / 2).alias("turnover"))
    turnover = order.join(turnover, "j", "left").select("timestamp", F.when(F.col("j") == 1, 0.0).otherwise(F.coalesce("turnover", F.lit(0.0))).alias("turnover"))
    means = per.where(F.col(group).isNotNull() & F.col("mean_return").isNotNull())
    ends = means.agg(F.max(group).alias("hi"), F.min(group).alias("lo"))
    both = means.join(days, "timestamp").crossJoin(F.broadcast(ends))  # one row
    gross = both.groupBy("timestamp").agg((F.max(F.when(F.col(group) == F.col("hi"), F.col("mean_return"))) - F.max(F.when(F.col(group) == F.col("lo"), F.col("mean_return")))).alias("gross"))
    out = gross.join(turnover, "timestamp", "left").withColumn("turnover", F.coalesce("turnover", F.lit(0.0)))
    return out.select("timestamp", "turnover", "gross", (F.col("gross") - F.col("turnover") * F.lit(cost_bps / 1e4)).alias("net"))


def drawdown(net: DataFrame, value: str = "net") -> DataFrame:
    """(timestamp, wealth, drawdown) of the compounded series; a row a rebalance day in one task."""
    w = Window.orderBy("timestamp").rowsBetween(Window.unboundedPreceding, 0)
    out = net.select("timestamp", F.product(1 + F.coalesce(value, F.lit(0.0))).over(w).alias("wealth"))
    return out.withColumn("drawdown", F.col("wealth") / F.max("wealth").over(w) - 1)


def hac_t(series: DataFrame, value: str, order: str = "timestamp", max_lag: int = 0) -> DataFrame:
    """One row: n, mean and Newey-West t of a mean with Bartlett weights. Lags are joined by position; a row a day."""
    x = series.where(F.col(value).isNotNull()).select(F.row_number().over(Window.orderBy(order)).alias("i"), F.col(value).alias("x"))
    stats = x.agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"))
    c = x.crossJoin(F.broadcast(stats)).select("i", "n", (F.col("x") - F.col("m")).alias("c"))  # one row
    lags = F.explode(F.sequence(F.lit(0), F.least(F.lit(max(0, int(max_lag))), F.col("n") - 1).cast("int")))
    a = c.select("i", "n", "c", lags.alias("j"))
    pairs = a.join(c.select(F.col("i").alias("i2"), F.col("c").alias("c2")), F.col("i") - F.col("j") == F.col("i2"))
    gamma = pairs.groupBy("j", "n").agg((F.sum(F.col("c") * F.col("c2")) / F.first("n")).alias("g"))
    bandwidth = F.least(F.lit(max(0, int(max_lag))), F.col("n") - 1) + 1
    run = gamma.agg(F.sum(F.when(F.col("j") == 0, F.col("g")).otherwise(2 * (1 - F.col("j") / bandwidth.cast("double")) * F.col("g"))).alias("s"))
    out = stats.crossJoin(run)  # one row each
    se = F.sqrt(F.greatest("s", F.lit(0.0)) / F.col("n"))
    return out.select("n", F.col("m").alias("mean"), F.when((F.col("n") >= 3) & (se > 0), F.col("m") / F.nullif(se, F.lit(0.0))).alias("hac_t"))


def yearly_ic(ic: DataFrame) -> DataFrame:
    out = ic.where("rank_ic IS NOT NULL").groupBy(F.year("timestamp").alias("year")).agg(F.avg("rank_ic").alias("mean"), F.stddev_samp("rank_ic").alias("std"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("icir", F.col("mean") / F.nullif(F.col("std"), F.lit(0.0)))


def evaluate(df: DataFrame, score: str, target: str, *, groups: int = 5, cost_bps: float = 0.0, industry: str | None = "industry", size: str | None = "market_cap", every: int | None = None, eligible: str | None = None) -> dict[str, DataFrame]:
    """Metrics of a score, each a table; summary is one row. Rows have to be eligible and their target tradable, where such
    columns are."""
    require(df, ("symbol", "timestamp", score, target), "dataset")
    horizon = re.search(r"_(\d+)d$", target)
    every = every or (int(horizon[1]) if horizon else 1)
    eligible = eligible or ("selection_eligible" if "selection_eligible" in df.columns else None)
    for c in (eligible, f"target_tradable_{horizon[1]}d" if horizon else None):
        if c and c in df.columns:
            df = df.where(F.coalesce(F.col(c), F.lit(False)))
    df = neutralise(df, score, industry=industry, size=size, name="score_neutral")
    df = neutralise(df, target, industry=industry, size=size, name="target_neutral")
    df = cut(quantile_groups(df, "score_neutral", groups))  # read by every metric
    ic = cut(rank_ic(df, "score_neutral", "target_neutral"))  # a row a day
    ls = cut(_long_short(df, target, every, cost_bps))  # a row a rebalance day
    t = hac_t(ic, "rank_ic", max_lag=every - 1)
    one = ic.agg(F.avg("rank_ic").alias("rank_ic"), (F.avg("rank_ic") / F.nullif(F.stddev_samp("rank_ic"), F.lit(0.0))).alias("icir"), F.avg((F.col("rank_ic") > 0).cast("double")).alias("rank_ic_positive_rate"))
    rest = ls.agg(F.avg("net").alias("mean_net_long_short")).crossJoin(drawdown(ls).agg(F.min("drawdown").alias("max_drawdown"))).crossJoin(monotonicity(df, target))
    rows = df.agg(F.count(F.when(F.col(score).isNotNull() & F.col(target).isNotNull(), 1)).alias("scored_rows"))
    summary = one.crossJoin(t.select(F.col("hac_t").alias("rank_ic_hac_t"))).crossJoin(rest).crossJoin(rows)  # one row each
    out = {"summary": summary, "daily_rank_ic": ic, "group_returns": group_returns(df, target), "long_short": ls, "yearly": yearly_ic(ic), "dataset": df}
    if "market_regime" in df.columns:
        out["regime_rank_ic"] = rank_ic(df, "score_neutral", "target_neutral", by="market_regime")
    return out


def compare(df: DataFrame, scores: list[str], target: str, **settings) -> DataFrame:
    """A summary row for each score."""
    rows = [evaluate(df, s, target, **settings)["summary"].withColumn("score", F.lit(s)) for s in scores]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


#: Limits a summary has to reach before a larger test (fixed values).
EVIDENCE = {
    "positive_rank_ic": "coalesce(rank_ic, 0) > 0", "hac_significance": "coalesce(rank_ic_hac_t >= 2.0, false)", "positive_rate": "coalesce(rank_ic_positive_rate, 0) >= 0.55",
    "quantile_monotonicity": "coalesce(monotonicity >= 0.5, false)", "positive_net_long_short": "coalesce(mean_net_long_short, 0) > 0", "sample_size": "coalesce(scored_rows, 0) >= 1000",
    "causal_audit": "coalesce(causal_audit_passed, false)", "classification_selective_risk": "coalesce(selective_risk <= 0.10, false)", "classification_calibration": "coalesce(ece <= 0.10, false)",
    "classification_coverage": "coalesce(coverage >= 0.50, false)", "unknown_rejection": "coalesce(unknown_rejection_rate >= 0.50, false)",
}


def assess_evidence(summary: DataFrame) -> DataFrame:
    """summary with a boolean for each check whose column is there, passed, status and failed_checks."""
    made = {}
    for name, condition in EVIDENCE.items():
        column = next(w for w in re.findall(r"[a-z_]+", condition) if w not in ("coalesce", "false"))
        if column in summary.columns:
            made[name] = condition
    out = summary.withColumns({n: F.expr(c) for n, c in made.items()})
    failed = F.concat_ws(";", *[F.when(~F.col(n), n) for n in made])
    return out.withColumn("failed_checks", failed).withColumns({"passed": F.col("failed_checks") == "", "status": F.when(F.col("failed_checks") == "", "research_candidate").otherwise("insufficient_evidence")})


def ridge_walk_forward(df: DataFrame, features: list[str], target: str, *, min_dates: int = 60, min_rows: int = 100, refit_every: int = 5, alpha: float = 1.0) -> DataFrame:
    """(symbol, timestamp, model_trained_at, score): on a refit day the ridge of all rows whose target was known before it;
    days in between keep the last model. Sums of products by the day a target became known, run over days, hold every
    cutoff's normal equations; only one row a day and one small solve a refit leave SQL."""
    horizon = re.search(r"_(\d+)d$", target)
    known_at = f"target_available_at_{horizon[1]}d" if horizon else "target_available_at"
    require(df, ("symbol", "timestamp", target, known_at, *features), "dataset")
    p = len(features)
    ok = F.col(target).isNotNull() & F.col(known_at).isNotNull()
    for c in features:
        ok = ok & finite(c).isNotNull()
    for c in ("selection_eligible", f"target_tradable_{horizon[1]}d" if horizon else ""):
        if c in df.columns:
            ok = ok & F.coalesce(F.col(c), F.lit(False))
    v = [F.lit(1.0), *[F.col(c).cast("double") for c in features], F.col(target).cast("double")]
    names = [f"m{a}_{b}" for a in range(p + 2) for b in range(a, p + 2)]
    sums = [F.sum(F.when(ok, v[a] * v[b])).alias(f"m{a}_{b}") for a in range(p + 2) for b in range(a, p + 2)]
    # the one pass over rows before scoring: a row for each day and day of knowledge
    small = df.groupBy("timestamp", F.col(known_at).alias("known_at")).agg(F.count_if(ok).alias("ok"), *sums)
    small = cut(small)
    known = small.where("ok > 0")
    by_day = known.groupBy("known_at").agg(*[F.sum(c).alias(c) for c in names])
    dates = known.groupBy("timestamp").agg(F.min("known_at").alias("first_known")).groupBy(F.col("first_known").alias("known_at")).agg(F.count(F.lit(1)).alias("dates"))
    so_far = Window.orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    # decision days come before sums of the same moment: a target known that day is not used
    days = sessions(small).select(F.col("timestamp").alias("t"), F.lit(0).alias("side"), "session")
    events = by_day.join(dates, "known_at", "full_outer").select(F.col("known_at").alias("t"), F.lit(1).alias("side"), "dates", *names)
    run = days.unionByName(events, allowMissingColumns=True).withColumns({c: F.coalesce(F.sum(c).over(so_far), F.lit(0)) for c in ("dates", *names)}).where("side = 0").select("t", "session", "dates", *names)

    def solve(batches):
        rows = pd.concat(list(batches), ignore_index=True).sort_values("session") if batches else pd.DataFrame()
        model, out = None, []
        for k, r in enumerate(rows.itertuples(index=False)):
            m = np.zeros((p + 2, p + 2))
            for a in range(p + 2):
                for b in range(a, p + 2):
                    m[a, b] = m[b, a] = getattr(r, f"m{a}_{b}")
            n = m[0, 0]
            if n >= min_rows and r.dates >= min_dates and (model is None or k % refit_every == 0):
                mean = m[0, 1 : p + 1] / n
                cov = m[1 : p + 1, 1 : p + 1] - n * np.outer(mean, mean)
                sd = np.sqrt(np.maximum(np.diag(cov), 0) / n)
                sd = np.where(sd > 1e-12 * (1 + np.abs(mean)), sd, 1.0)
                y = m[0, p + 1] / n
                xy = m[1 : p + 1, p + 1] - n * mean * y
                beta = np.linalg.pinv(cov / np.outer(sd, sd) + alpha * np.eye(p)) @ (xy / sd)
                model = (r.t, float(y - (beta * mean / sd).sum()), (beta / sd).tolist())
            if model is not None:
                out.append((r.t, *model))
        yield pd.DataFrame(out, columns=["timestamp", "model_trained_at", "intercept", "slopes"])

    models = run.coalesce(1).mapInPandas(lambda it: solve(list(it)), "timestamp timestamp_ntz, model_trained_at timestamp_ntz, intercept double, slopes array<double>")
    scored = df.join(models, "timestamp")  # a row a day
    value = F.col("intercept")
    for k, c in enumerate(features):
        value = value + F.get("slopes", F.lit(k)) * finite(F.col(c).cast("double"))
    return scored.select("symbol", "timestamp", "model_trained_at", value.alias("score"))


def incremental_test(df: DataFrame, base: list[str], extra: list[str], target: str, *, max_lag: int = 0, **settings) -> DataFrame:
    """One row: does the larger ridge's daily IC beat the smaller's on common rows? n, mean, hac_t, passed."""
    df = df.select("symbol", "timestamp", target, *dict.fromkeys([*base, *extra]), *[c for c in df.columns if c == "selection_eligible" or c.startswith(("target_available_at", "target_tradable"))])
    df = cut(df)
    a = ridge_walk_forward(df, base, target, **settings).select("symbol", "timestamp", F.col("score").alias("score_a"))
    b = ridge_walk_forward(df, [*base, *extra], target, **settings).select("symbol", "timestamp", F.col("score").alias("score_b"))
    both = df.select("symbol", "timestamp", target).join(a, ["symbol", "timestamp"]).join(b, ["symbol", "timestamp"]).where("score_a IS NOT NULL AND score_b IS NOT NULL")
    ics = rank_ic(both, "score_a", target).select("timestamp", F.col("rank_ic").alias("a")).join(rank_ic(both, "score_b", target).select("timestamp", F.col("rank_ic").alias("b")), "timestamp")
    t = hac_t(ics.withColumn("d", F.col("b") - F.col("a")), "d", max_lag=max_lag)
    return t.withColumn("passed", F.coalesce((F.col("mean") > 0) & (F.col("hac_t") >= 2), F.lit(False)))
