"""Labelled segments: abstention gates, recognizability, merging runs, transitions and descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DurationConfig, GateConfig
from ..functions import kernels as K
from ..functions.checks import require, unique_rows
from ..functions.numeric import clip

UNKNOWN = K.UNKNOWN


def in_symbol():
    return Window.partitionBy("symbol").orderBy("start_idx", "end_idx", "segment_id")


def probability_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("prob_")]


# --- gates ----------------------------------------------------------------------------------------------------------


def recognizability(df: DataFrame, cfg: GateConfig | None = None) -> DataFrame:
    """df with recognizability from max_probability, posterior_entropy, model_disagreement, is_low_density,
    boundary_uncertainty and context_conflict (missing ones count as none)."""
    cfg = cfg or GateConfig()
    have = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in df.columns else F.lit(0.0)
    dense = (~F.coalesce(F.col("is_low_density"), F.lit(False))).cast("double")
    apart = F.least(F.col("model_disagreement") / max(cfg.max_disagreement, 1e-12), F.lit(1.0))
    score = 0.40 * F.col("max_probability") + 0.25 * (1 - F.col("posterior_entropy")) + 0.15 * (1 - apart) + 0.10 * dense + 0.05 * (1 - have("boundary_uncertainty")) + 0.05 * (1 - have("context_conflict"))
    return df.withColumn("recognizability", clip(score, 0.0, 1.0))


def discovery_gates(cfg: GateConfig) -> list[tuple[str, str]]:
    """(name, SQL condition), in the order they are told."""
    return [
        ("low_consensus", f"max_probability < {cfg.min_consensus}"), ("model_disagreement", f"model_disagreement > {cfg.max_disagreement}"), ("mixture_nonconverged", "NOT mixture_converged"),
        ("low_density", "is_low_density"), ("hdbscan_noise", "hdbscan_noise"), ("weak_hdbscan_membership", f"hdbscan_strength < {cfg.hdbscan_min_strength} AND NOT hdbscan_noise"),
        ("high_entropy", f"posterior_entropy > {cfg.max_entropy}"), ("boundary_unstable", f"boundary_uncertainty > {cfg.max_boundary_uncertainty}"),
        ("context_conflict", f"context_conflict > {cfg.max_context_conflict}"), ("low_recognizability", f"recognizability < {cfg.min_recognizability}"),
        ("insufficient_cluster_support", "NOT cluster_supported"),
    ]


def baseline_gates(cfg: GateConfig) -> list[tuple[str, str]]:
    of = dict(discovery_gates(cfg))
    order = ("high_entropy", "model_disagreement", "low_density", "boundary_unstable", "context_conflict", "low_recognizability", "insufficient_cluster_support")
    return [("low_posterior", of["low_consensus"]), *[(n, of[n]) for n in order]]


def apply_gates(df: DataFrame, gates: list[tuple[str, str]]) -> DataFrame:
    """df with unknown_reason (names of closed gates, ';'-joined), label, is_unknown and candidate_status. A gate on a
    missing column or a null value does not close."""
    usable = [(n, c) for n, c in gates if c.removeprefix("NOT ").split()[0] in df.columns]
    out = df.withColumn("unknown_reason", F.concat_ws(";", *[F.when(F.expr(c), n) for n, c in usable]))
    known = F.col("unknown_reason") == ""
    return out.withColumns({"label": F.when(known, F.col("candidate_label")).otherwise(UNKNOWN), "is_unknown": ~known, "candidate_status": F.when(known, "classified").otherwise("model_abstention")})


def cluster_support(df: DataFrame, cfg: GateConfig | None = None) -> DataFrame:
    """(candidate_label, cluster_supported): enough rows, symbols and years of start; fails closed without them."""
    cfg = cfg or GateConfig()
    n = lambda c: F.count_distinct(c)
    enough = (F.count(F.lit(1)) >= cfg.min_cluster_samples) & (n(F.col("symbol")) >= cfg.min_cluster_symbols) & (n(F.year("start")) >= cfg.min_cluster_years)
    return df.groupBy("candidate_label").agg(enough.alias("cluster_supported"))


def ensemble_diagnostics(df: DataFrame, members: list[list[str]], labels: list[str]) -> DataFrame:
    """df with the members' mean probabilities prob_*, candidate_label, max_probability, posterior_entropy (of 1) and
    model_disagreement (mean over labels of the members' population deviation). members: a column for each label."""
    k = len(labels)
    mean = lambda xs: sum(xs[1:], xs[0]) / len(xs)
    columns = [[F.col(m[j]) for m in members] for j in range(k)]
    p = {f"prob_{x}": mean(columns[j]) for j, x in enumerate(labels)}
    apart = mean([F.sqrt(F.greatest(mean([x * x for x in c]) - mean(c) * mean(c), F.lit(0.0))) for c in columns])
    out = df.withColumns(p).withColumn("model_disagreement", apart)
    ps = [F.col(c) for c in p]
    top = F.greatest(*ps)
    entropy = -sum((x * F.ln(F.greatest(x, F.lit(1e-12))) for x in ps[1:]), ps[0] * F.ln(F.greatest(ps[0], F.lit(1e-12)))) / F.ln(F.lit(float(k)))
    best = F.coalesce(*[F.when(x == top, F.lit(n)) for x, n in zip(ps, labels, strict=True)])
    return out.withColumns({"max_probability": top, "posterior_entropy": entropy, "candidate_label": best})


def total_variation(df: DataFrame, left: list[str], right: list[str], name: str = "total_variation") -> DataFrame:
    s = lambda cs: F.nullif(sum((F.col(c) for c in cs[1:]), F.col(cs[0])), F.lit(0.0))
    parts = [F.abs(F.col(a) / s(left) - F.col(b) / s(right)) for a, b in zip(left, right, strict=True)]
    return df.withColumn(name, 0.5 * sum(parts[1:], parts[0]))


def overlap_matrix(df: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """(left_label, right_label, overlap): cosine of the two labels' probabilities over all rows."""
    cells = [F.struct(F.lit(a).alias("left_label"), F.lit(b).alias("right_label"), (F.sum(F.col(a) * F.col(b)) / F.nullif(F.sqrt(F.sum(F.col(a) ** 2) * F.sum(F.col(b) ** 2)), F.lit(0.0))).alias("overlap")) for a in left for b in right]
    return df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


# --- sequences ------------------------------------------------------------------------------------------------------


def merge_runs(segments: DataFrame, *, merge_unknown: bool = False) -> DataFrame:
    """Neighbouring segments of one label as one: bounds and outer evidence kept, bars counted anew, probabilities weighted
    by bars and scaled to 1, original ids in order. UNKNOWN stays apart unless asked."""
    require(segments, ("symbol", "segment_id", "start_idx", "end_idx", "label"), "segments")
    probs = probability_columns(segments)
    joins = (F.lag("label").over(in_symbol()) == F.col("label")) & (F.col("start_idx") <= F.lag("end_idx").over(in_symbol()) + 1)
    if not merge_unknown:
        joins = joins & (F.col("label") != UNKNOWN)
    rows = segments.withColumn("_new", (~F.coalesce(joins, F.lit(False))).cast("int")).withColumn("_run", F.sum("_new").over(in_symbol().rowsBetween(Window.unboundedPreceding, 0)))
    n = F.col("n_bars") if "n_bars" in segments.columns else F.col("end_idx") - F.col("start_idx") + 1
    rows = rows.withColumn("_n", n)
    order = F.struct("start_idx", "end_idx", "segment_id")
    first, last = (lambda c: F.min_by(c, order)), (lambda c: F.max_by(c, order))
    keep = {c: first(c) for c in segments.columns if c in ("start", "start_boundary_probability", "start_boundary_sources", "start_boundary_stability", "start_available_at")}
    keep |= {c: last(c) for c in segments.columns if c in ("end", "end_boundary_probability", "end_boundary_sources", "end_boundary_stability", "available_at", "confirmation_idx")}
    merged = rows.groupBy("symbol", "_run").agg(
        first("label").alias("label"), F.min("start_idx").alias("start_idx"), F.max("end_idx").alias("end_idx"), F.transform(F.array_sort(F.collect_list(order)), lambda x: x["segment_id"]).alias("segment_ids"),
        *[x.alias(c) for c, x in keep.items()], *[(F.sum(F.col(c) * F.col("_n")) / F.nullif(F.sum("_n"), F.lit(0))).alias(c) for c in probs],
    )
    if probs:
        total = F.nullif(sum((F.col(c) for c in probs[1:]), F.col(probs[0])), F.lit(0.0))
        merged = merged.withColumn("_total", total).withColumns({c: F.col(c) / F.col("_total") for c in probs}).drop("_total")
    if {"start_boundary_probability", "end_boundary_probability"} <= set(keep):
        p = F.least("start_boundary_probability", "end_boundary_probability")
        merged = merged.withColumns({"boundary_probability": p, "boundary_uncertainty": 1 - p})
    ids = F.col("segment_ids")
    return merged.withColumns({
        "n_bars": (F.col("end_idx") - F.col("start_idx") + 1).cast("int"), "merged_segments": F.size(ids), "segment_no": (F.col("_run") - 1).cast("int"),
        "segment_id": F.when(F.size(ids) == 1, F.get(ids, 0)).otherwise(F.concat_ws(":", "symbol", F.lit("merged"), F.col("start_idx").cast("string"), F.col("end_idx").cast("string"))),
    }).drop("_run")


def with_regimes(states: DataFrame, regimes: DataFrame, take: tuple = ("market_proxy_regime",), *, time: str = "state_available_at") -> DataFrame:
    """States with the regime of the day they became known; without one that day the regime is UNKNOWN. A day with two rows in
    regimes fails."""
    r = unique_rows(regimes.select(F.to_date("timestamp").alias("_day"), *take), ["_day"], "regimes")
    out = states.join(r, F.to_date(time) == F.col("_day"), "left").drop("_day")
    return out.withColumns({c: F.coalesce(c, F.lit(UNKNOWN)) for c in take})


def version_transitions(df: DataFrame, by: str = "model_version", label: str = "label") -> DataFrame:
    """(by, from_label, to_label, n) of adjacent segments of one symbol and version, on a dense grid of a version's labels."""
    w = Window.partitionBy(by, "symbol").orderBy("start_idx", "end_idx")
    steps = df.withColumn("_next", F.lead(F.struct(label, "start_idx")).over(w)).where("_next IS NOT NULL AND _next.start_idx <= end_idx + 1")
    steps = steps.groupBy(by, F.col(label).alias("from_label"), F.col(f"_next.{label}").alias("to_label")).agg(F.count(F.lit(1)).alias("n"))
    names = df.select(by, F.col(label).alias("from_label")).distinct()  # a row a version and label
    grid = names.join(names.withColumnRenamed("from_label", "to_label"), by)
    return grid.join(steps, [by, "from_label", "to_label"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def weighted_summary(df: DataFrame, values: list[str], weight: str, by: list[str] = ()) -> DataFrame:
    """Weighted means of values by slice, with rows and weight."""
    w = F.col(weight).cast("double")
    mean = lambda v: F.sum(F.when(F.col(v).isNotNull(), w * F.col(v))) / F.nullif(F.sum(F.when(F.col(v).isNotNull(), w)), F.lit(0.0))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.sum(w).alias("weight"), *[mean(v).alias(v) for v in values])


def duration_sensitivity(segments: DataFrame, shortest: tuple = (2, 3), by: str = "model_version") -> DataFrame:
    """(by, shortest, rows, changed, self_transition_rate) of explicit-duration decoding at several least runs."""
    out = None
    for n in shortest:
        d = decode_durations(segments, shortest=n)
        w = Window.partitionBy(by, "symbol").orderBy("start_idx", "end_idx")
        d = d.withColumn("_p", F.lag("hsmm_label").over(w))
        known = (F.col("hsmm_label") != UNKNOWN) & (F.col("_p") != UNKNOWN)
        row = d.groupBy(by).agg(F.lit(n).alias("shortest"), F.count(F.lit(1)).alias("rows"), F.avg(F.col("hsmm_changed").cast("double")).alias("changed"), F.avg(F.when(known, (F.col("hsmm_label") == F.col("_p")).cast("double"))).alias("self_transition_rate"))
        out = row if out is None else out.unionByName(row)
    return out


def transitions(segments: DataFrame, *, drop_unknown: bool = False, label: str = "label") -> DataFrame:
    """(from_label, to_label, n, probability), dense over all labels; rows without a transition have probability 0."""
    if drop_unknown:
        segments = segments.where(F.col(label) != UNKNOWN)
    steps = segments.withColumn("_next", F.lead(label).over(in_symbol())).where("_next IS NOT NULL").groupBy(F.col(label).alias("from_label"), F.col("_next").alias("to_label")).agg(F.count(F.lit(1)).alias("n"))
    names = steps.select(F.col("from_label").alias("l")).union(steps.select("to_label")).distinct()
    # labels are few by nature: a row each
    grid = names.select(F.col("l").alias("from_label")).crossJoin(names.select(F.col("l").alias("to_label")))
    filled = grid.join(steps, ["from_label", "to_label"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    total = F.sum("n").over(Window.partitionBy("from_label"))
    return filled.withColumn("probability", F.coalesce(F.col("n") / F.nullif(total.cast("double"), F.lit(0.0)), F.lit(0.0)))


def describe_labels(df: DataFrame, features: list[str], label: str = "label", by: str | None = None) -> DataFrame:
    """(label, feature, n, mean, median, std, min, max, segments, share), long form; a null label is a label. by: also for
    each of its values (a model version, say), with the share within it."""
    if by is not None:
        pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features]))
        rows = df.select(F.col(by), F.col(label).alias("label"), pairs.alias("p")).select(by, "label", "p.*")
        out = rows.groupBy(by, "label", "feature").agg(
            F.count("x").alias("n"), F.avg("x").alias("mean"), F.median("x").alias("median"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"), F.count(F.lit(1)).alias("segments")
        )
        return out.withColumn("share", F.col("segments") / F.sum("segments").over(Window.partitionBy(by, "feature")))
    total = df.count()
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features]))
    rows = df.select(F.col(label).alias("label"), pairs.alias("p")).select("label", "p.*")
    return rows.groupBy("label", "feature").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.median("x").alias("median"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"),
        F.count(F.lit(1)).alias("segments"), (F.count(F.lit(1)) / F.lit(float(max(total, 1)))).alias("share"),
    )


def coverage(df: DataFrame, by: list[str]) -> DataFrame:
    unknown = F.col("label") == UNKNOWN
    labels = F.array_join(F.array_sort(F.collect_set(F.when(~unknown, F.col("label")))), ",")
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("segments"), F.count_if(~unknown).alias("identified"), F.count_if(unknown).alias("unknown"), labels.alias("fold_local_labels"))
    return out.withColumn("coverage", F.col("identified") / F.col("segments").cast("double"))


def unknown_reasons(df: DataFrame, by: str = "model_version") -> DataFrame:
    return df.select(by, F.explode(F.split("unknown_reason", ";")).alias("reason")).where("trim(reason) <> ''").groupBy(by, "reason").agg(F.count(F.lit(1)).alias("n"))


def label_counts(df: DataFrame, by: str = "model_version") -> DataFrame:
    return df.groupBy(by, "label").agg(F.count(F.lit(1)).alias("n"))


def structure_summary(df: DataFrame, by: str = "model_version") -> DataFrame:
    """A row a version: share of UNKNOWN, symbols, median and 90th percentile of bars of known segments, adjacent known
    pairs and how many keep their label, runs of one label and their median bars (a shared pivot counts once)."""
    w = Window.partitionBy(by, "symbol").orderBy("start_idx", "end_idx")
    known = F.col("label") != UNKNOWN
    before = F.lag(F.struct("label", "end_idx")).over(w)
    adjacent = F.coalesce((F.col("start_idx") <= before["end_idx"] + 1) & known & (before["label"] != UNKNOWN), F.lit(False))
    rows = df.withColumn("_known", known).withColumn("_adjacent", adjacent).withColumn("_same", F.coalesce(adjacent & (before["label"] == F.col("label")), F.lit(False)))
    n = F.when(F.col("_known"), F.col("n_bars").cast("double"))
    top = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("segments"), F.avg((~F.col("_known")).cast("double")).alias("unknown_fraction"), F.count_distinct("symbol").alias("symbols"),
        F.median(n).alias("median_bars"), F.percentile(n, F.lit(0.9)).alias("p90_bars"), F.count_if("_adjacent").alias("adjacent_pairs"), F.count_if("_same").alias("same_pairs"),
    )
    runs = rows.where("_known").withColumn("_run", F.sum((~F.col("_same")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    bars = runs.groupBy(by, "symbol", "_run").agg((F.max("end_idx") - F.min("start_idx") + 1).cast("double").alias("b")).groupBy(by).agg(F.count(F.lit(1)).alias("runs"), F.median("b").alias("median_run_bars"))
    return top.withColumn("self_transition_rate", F.col("same_pairs") / F.nullif(F.col("adjacent_pairs").cast("double"), F.lit(0.0))).join(bars, by, "left")


def decode_durations(segments: DataFrame, *, longest: int = 8, shortest=2, continuation: float = 0.65, transition=None) -> DataFrame:
    """Segments with hsmm_label, hsmm_path_score and hsmm_changed, by explicit-duration decoding of each symbol. UNKNOWN
    rows split a symbol and stay UNKNOWN. It sees later segments, so it is for description only."""
    import pandas as pd

    probs = probability_columns(segments)
    names = [c.removeprefix("prob_") for c in probs]
    import numpy as np

    prior = K.geometric_durations(names, longest, shortest, continuation)
    durations, move = np.array([prior[n] for n in names]), K.transition_prior(len(names), transition)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start_idx", "end_idx"], kind="stable")
        label, score = np.full(len(pdf), UNKNOWN, object), np.full(len(pdf), np.nan)
        p = pdf[probs].to_numpy(float)
        for a, b in K.runs((pdf["label"] != UNKNOWN).tolist()):
            path, total = K.hsmm_path(p[a:b], durations, move)
            label[a:b], score[a:b] = np.array(names, object)[path], total / (b - a)
        return pdf.assign(hsmm_label=label, hsmm_path_score=score)[["segment_id", "hsmm_label", "hsmm_path_score"]]

    need = segments.select("segment_id", "symbol", "start_idx", "end_idx", "label", *probs)
    decoded = need.groupBy("symbol").applyInPandas(run, "segment_id string, hsmm_label string, hsmm_path_score double")
    return segments.join(decoded, "segment_id").withColumn("hsmm_changed", F.col("hsmm_label") != F.col("label"))


def smooth_and_merge(segments: DataFrame, **settings) -> DataFrame:
    decoded = decode_durations(segments, **settings)
    return merge_runs(decoded.withColumn("label", F.col("hsmm_label")))


def dwell_filter(segments: DataFrame, least=DurationConfig.dwell_bars) -> DataFrame:
    """Segments with causal_duration_label: a label holds until it has lasted `least` bars; past only."""
    import pandas as pd

    probs = probability_columns(segments)
    best = F.greatest(*[F.col(c) for c in probs])
    top = F.coalesce(*[F.when(F.col(c) == best, c.removeprefix("prob_")) for c in probs])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start_idx", "end_idx"], kind="stable")
        out, _ = K.dwell(pdf["top"].tolist(), (pdf["label"] == UNKNOWN).tolist(), pdf["n_bars"].tolist(), least)
        return pdf.assign(causal_duration_label=out)[["segment_id", "causal_duration_label"]]

    need = segments.select("segment_id", "symbol", "start_idx", "end_idx", "label", "n_bars", top.alias("top"))
    return segments.join(need.groupBy("symbol").applyInPandas(run, "segment_id string, causal_duration_label string"), "segment_id")
