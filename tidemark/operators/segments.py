"""Segmentation of bars, one grouped kernel a symbol, and its bootstrap stability.

Only the columns a kernel needs are sent to it; filter symbols or dates before, as Spark cannot push filters below it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SegmentationConfig
from ..functions import kernels as K
from ..functions.checks import require
from .bars import BAR, numbered

SEGMENT = (
    "segment_id string, symbol string, segment_no int, start_idx int, end_idx int, start timestamp_ntz, end timestamp_ntz, start_boundary_probability double, "
    "end_boundary_probability double, boundary_probability double, boundary_uncertainty double, start_boundary_sources string, end_boundary_sources string, n_bars int"
)
#: Perturbed draws of a symbol in one task.
DRAWS = 25
CAUSAL = SEGMENT + ", confirmation_idx int, available_at timestamp_ntz, start_available_at timestamp_ntz, segmenter string"


def _arrays(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    return {c: pdf[c].to_numpy(float) for c in ("open", "high", "low", "close", "volume")}


def boundaries(bars: dict[str, np.ndarray], cfg: SegmentationConfig, change_points: bool) -> list[K.Boundary]:
    """Fused boundaries of one symbol's bars."""
    h, lo, c, v = (bars[k] for k in ("high", "low", "close", "volume"))
    found = K.zigzag(h, lo, c, cfg.atr_period, cfg.atr_reversal)
    if change_points and cfg.use_adaptive_structure:
        found += K.structure(h, lo, c, v, cfg.min_bars)
    if change_points and cfg.use_fractal_pivots:
        found += K.fractals(h, lo, c, max(1, cfg.fractal_window), cfg.fractal_min_prominence_atr, cfg.atr_period)
    if change_points and cfg.use_bocpd:
        found += K.change_points(c, cfg.bocpd_hazard, cfg.bocpd_min_run_length, cfg.bocpd_change_probability, cfg.bocpd_max_run_length)
    if change_points and cfg.use_kernel_changes:
        found += K.kernel_changes(c, v, cfg.kernel_change_penalty)
    return K.fuse(found, len(c), cfg.merge_tolerance, cfg.min_bars, cfg.min_boundary_probability, cfg.min_boundary_votes, cfg.single_source_min_probability)


def _frame(symbol: str, when: np.ndarray, legs: list[tuple], causal: bool) -> pd.DataFrame:
    """legs: (number, left, right) with left and right (index, probability, sources, confirming index)."""
    rows = []
    for no, left, right in legs:
        p = min(left[1], right[1])
        row = [f"{symbol}:{no}", symbol, no, left[0], right[0], when[left[0]], when[right[0]], left[1], right[1], p, 1 - p, left[2], right[2], right[0] - left[0] + 1]
        rows.append(row + ([right[3], when[right[3]], when[left[3]], "causal_atr_zigzag"] if causal else []))
    names = [x.split()[0] for x in (CAUSAL if causal else SEGMENT).split(", ")]
    return pd.DataFrame(rows, columns=names)


def segment_bars(bars: DataFrame, cfg: SegmentationConfig | None = None, *, change_points: bool = False) -> DataFrame:
    """Candidate segments, in retrospect. Indices count a symbol's bars from 0; neighbours share their turning bar."""
    cfg = cfg or SegmentationConfig()
    require(bars, BAR, "bars")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("timestamp")
        found = boundaries(_arrays(pdf), cfg, change_points)
        legs = [(k, (*a, 0), (*b, 0)) for k, (a, b) in enumerate(zip(found, found[1:], strict=False))]
        return _frame(pdf["symbol"].iloc[0], pdf["timestamp"].to_numpy(), legs, False)

    return bars.select(*BAR).groupBy("symbol").applyInPandas(run, SEGMENT)


def segment_causal(bars: DataFrame, cfg: SegmentationConfig | None = None) -> DataFrame:
    """Legs whose last pivot the input confirms; available_at is the confirming bar's time. More bars only add rows."""
    cfg = cfg or SegmentationConfig()
    require(bars, BAR, "bars")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("timestamp")
        b = _arrays(pdf)
        pivots = K.causal_pivots(b["high"], b["low"], b["close"], cfg.atr_period, cfg.atr_reversal)
        ends = [(i, p, "causal_atr_zigzag" if k else "edge", c) for k, (i, p, c) in enumerate(pivots)]
        legs = [(k, x, y) for k, (x, y) in enumerate(zip(ends, ends[1:], strict=False)) if y[0] - x[0] >= cfg.min_bars]
        return _frame(pdf["symbol"].iloc[0], pdf["timestamp"].to_numpy(), legs, True)

    return bars.select(*BAR).groupBy("symbol").applyInPandas(run, CAUSAL)


class Segmenter:
    """Facade with the settings kept."""

    def __init__(self, cfg: SegmentationConfig | None = None, *, causal: bool = False, change_points: bool = False):
        self.cfg, self.causal, self.change_points = cfg or SegmentationConfig(), causal, change_points

    def fit_predict(self, bars: DataFrame) -> DataFrame:
        return segment_causal(bars, self.cfg) if self.causal else segment_bars(bars, self.cfg, change_points=self.change_points)


# --- boundaries of segments -----------------------------------------------------------------------------------------


def boundary_table(segments: DataFrame, *, edges: bool = False) -> DataFrame:
    """(symbol, boundary_idx, is_edge): distinct ends; a symbol's first and last are edges and left out by default."""
    from pyspark.sql import Window

    ends = segments.select("symbol", F.col("start_idx").alias("boundary_idx")).union(segments.select("symbol", F.col("end_idx"))).distinct()
    w = Window.partitionBy("symbol")
    at = F.col("boundary_idx")
    out = ends.withColumn("is_edge", (at == F.min(at).over(w)) | (at == F.max(at).over(w)))
    return out if edges else out.where("NOT is_edge")


def causal_boundaries(segments: DataFrame) -> DataFrame:
    """(symbol, boundary_idx, at, year): distinct ends but each symbol's first."""
    from pyspark.sql import Window

    ends = segments.select("symbol", F.col("start_idx").alias("boundary_idx"), F.col("start").alias("at")).union(segments.select("symbol", "end_idx", "end")).distinct()
    w = Window.partitionBy("symbol").orderBy("boundary_idx")
    return ends.withColumn("_n", F.row_number().over(w)).where("_n > 1").select("symbol", "boundary_idx", "at", F.year("at").alias("year"))


def boundary_matches(predicted: DataFrame, reference: DataFrame, tolerance: int = 3, by: tuple = ("symbol",)) -> DataFrame:
    """(by..., matched, predicted, reference) counts of one-to-one matches within tolerance; both have by and boundary_idx."""
    both = predicted.select(*by, "boundary_idx", F.lit(0).alias("side")).union(reference.select(*by, "boundary_idx", F.lit(1).alias("side")))
    kinds = ", ".join(f"{c} {predicted.schema[c].dataType.simpleString()}" for c in by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (sorted(pdf.loc[pdf.side == s, "boundary_idx"]) for s in (0, 1))
        return pd.DataFrame([[*(pdf[c].iloc[0] for c in by), len(K.match(a, b, tolerance)), len(a), len(b)]], columns=[*by, "matched", "predicted", "reference"])

    return both.groupBy(*by).applyInPandas(run, f"{kinds}, matched long, predicted long, reference long")


def compare_boundaries(reference: DataFrame, observed: DataFrame, tolerance: int = 3) -> dict[str, DataFrame]:
    """Agreement of two segmentations' boundaries (causal_boundaries of each): overall, by symbol, and by symbol and year; a
    match across years counts in neither year. Names say that neither side is the truth."""
    if tolerance < 0:
        raise ValueError("tolerance must not be negative")
    a, b = causal_boundaries(observed), causal_boundaries(reference)
    names = {"predicted": "observed_boundaries", "reference": "reference_boundaries", "matched": "matches", "precision": "precision_vs_reference", "recall": "recall_vs_reference", "f1": "f1_agreement"}
    zero = lambda df: df.fillna(0.0, ["precision", "recall", "f1"]).withColumnsRenamed(names)
    by_symbol = boundary_matches(a, b, tolerance)
    by_year = boundary_matches(a, b, tolerance, ("symbol", "year"))
    return {"overall": zero(precision_recall(by_symbol)).withColumn("tolerance_bars", F.lit(tolerance)), "symbol": zero(precision_recall(by_symbol, ("symbol",))), "year": zero(precision_recall(by_year, ("symbol", "year")))}


def precision_recall(counts: DataFrame, by: tuple = ()) -> DataFrame:
    sums = counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("matched", "predicted", "reference")])
    p, r = (F.col("matched") / F.nullif(F.col(c).cast("double"), F.lit(0.0)) for c in ("predicted", "reference"))
    return sums.withColumns({"precision": p, "recall": r}).withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)))


# --- bootstrap ------------------------------------------------------------------------------------------------------


def bootstrap_stability(bars: DataFrame, cfg: SegmentationConfig | None = None, *, iterations: int = 100, seed: int = 0, causal: bool = False, change_points: bool = False, segmenter: Callable | None = None) -> DataFrame:
    """(symbol, boundary_idx, frequency): how often a boundary comes back within the tolerance on perturbed bars. Noise
    depends on (seed, symbol, iteration) alone. Causal: a candidate counts only if it was confirmed no later than the
    boundary itself; the first bar always comes back. segmenter(arrays) -> [(index, confirming index)] takes its place."""
    cfg = cfg or SegmentationConfig()

    def find(b: dict[str, np.ndarray]) -> list[tuple[int, int]]:
        if segmenter is not None:
            return list(segmenter(b))
        if causal:
            return [(i, c) for i, _, c in K.causal_pivots(b["high"], b["low"], b["close"], cfg.atr_period, cfg.atr_reversal)]
        return [(x.index, x.index) for x in boundaries(b, cfg, change_points)[1:-1]]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("timestamp")
        symbol, first, b = pdf["symbol"].iloc[0], int(pdf["first"].iloc[0]), _arrays(pdf)
        base = find(b)
        hits = np.zeros(len(base))
        for k in range(first, min(first + DRAWS, iterations)):
            noisy = find(K.perturb(b, K.keyed_rng(seed, symbol, k), cfg.bootstrap_price_noise, cfg.bootstrap_volume_noise))
            hits += [causal and i == 0 or any(abs(i - j) <= cfg.bootstrap_tolerance and (not causal or d <= c) for j, d in noisy) for i, c in base]
        return pd.DataFrame({"symbol": symbol, "boundary_idx": np.array([i for i, _ in base], np.int32), "hits": hits})

    each = bars.select(*BAR).crossJoin(F.broadcast(bars.sparkSession.range(0, iterations, DRAWS).select(F.col("id").cast("int").alias("first"))))
    hits = each.groupBy("symbol", "first").applyInPandas(run, "symbol string, boundary_idx int, hits double")
    return hits.groupBy("symbol", "boundary_idx").agg((F.sum("hits") / iterations).alias("frequency"))


def fold_in_stability(segments: DataFrame, stability: DataFrame, default: float = 1.0) -> DataFrame:
    """Segments with both boundary probabilities kept to their frequency (default where a boundary has none: 1 for edges in
    retrospect, 0 in causal runs); the detector's own stay in detector_ columns."""
    s = stability.select("symbol", "boundary_idx", "frequency")
    out = segments
    for end in ("start", "end"):
        own = s.select(F.col("symbol").alias("_s"), F.col("boundary_idx").alias("_i"), F.col("frequency").alias(f"{end}_boundary_stability"))
        out = out.join(own, (out["symbol"] == own["_s"]) & (out[f"{end}_idx"] == own["_i"]), "left").drop("_s", "_i")
        stable = F.coalesce(f"{end}_boundary_stability", F.lit(default))
        out = out.withColumn(f"{end}_boundary_stability", stable).withColumn(f"detector_{end}_boundary_probability", F.col(f"{end}_boundary_probability"))
        out = out.withColumn(f"{end}_boundary_probability", F.least(f"{end}_boundary_probability", f"{end}_boundary_stability"))
    p = F.least("start_boundary_probability", "end_boundary_probability")
    return out.withColumns({"bootstrap_boundary_stability": F.least("start_boundary_stability", "end_boundary_stability"), "boundary_probability": p, "boundary_uncertainty": 1 - p})


def segment_distribution(segments: DataFrame, short: int = 10, by: tuple = ()) -> DataFrame:
    n = F.col("n_bars").cast("double")
    q = lambda p: F.percentile(n, F.lit(p))
    return segments.groupBy(*by).agg(F.count(F.lit(1)).alias("segments"), q(0.5).alias("median_bars"), q(0.1).alias("p10_bars"), q(0.9).alias("p90_bars"), F.avg((n < short).cast("double")).alias("short_share"))


def with_bars(segments: DataFrame, bars: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each bar of each segment (both ends): segment_id, keep..., and the bar's columns with idx. Segments are written
    out by index and joined on (symbol, idx), so rows made are rows out. Bounds outside a symbol's bars, an end before the
    start and an unknown symbol fail while the plan runs."""
    b = numbered(bars).withColumnRenamed("idx", "_idx").withColumnRenamed("symbol", "_symbol")
    told = F.concat(F.lit("invalid segment bounds for "), F.coalesce(F.col("symbol").cast("string"), F.lit("null")), F.lit(": "), F.coalesce(F.col("start_idx").cast("string"), F.lit("null")), F.lit(".."), F.coalesce(F.col("end_idx").cast("string"), F.lit("null")))
    fine = (F.col("start_idx") >= 0) & (F.col("end_idx") >= F.col("start_idx")) & F.col("symbol").isNotNull()
    every = F.when(fine, F.sequence(F.col("start_idx").cast("int"), F.col("end_idx").cast("int"))).otherwise(F.raise_error(told).cast("array<int>"))
    s = segments.select("segment_id", "symbol", *[F.col(c).alias(f"seg_{c}") for c in keep], told.alias("_told"), F.explode(every).alias("idx"))
    out = s.join(b, (s["symbol"] == b["_symbol"]) & (s["idx"] == b["_idx"]), "left")
    there = F.when(F.col("_idx").isNotNull(), F.col("idx")).otherwise(F.raise_error(F.col("_told")).cast("int"))
    return out.withColumn("idx", there).drop("_told", "_idx", "_symbol")
