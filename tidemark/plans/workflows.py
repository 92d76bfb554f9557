"""Whole flows from bars to tables, as lazy DataFrames; only fits run while they are built."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PipelineConfig
from ..operators import discovery, features, labels, review, segments
from ..operators.bars import normalize
from ..session import cut


def describe_bars(bars: DataFrame, cfg: PipelineConfig | None = None, *, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Retrospective description: candidate segments, labels, past-only smoothing, duration decoding, merged runs with
    features of their own bounds, descriptions, transitions. The review queue is of labels before decoding."""
    cfg = cfg or PipelineConfig()
    names = names or [c for c in features.CAUSAL_FEATURES]
    bars = normalize(bars)
    segs = segments.segment_bars(bars, cfg.segmentation, change_points=True)
    if cfg.segmentation.bootstrap_iterations:
        stable = segments.bootstrap_stability(bars, cfg.segmentation, iterations=cfg.segmentation.bootstrap_iterations, change_points=True)
        segs = segments.fold_in_stability(segs, stable)
    segs = cut(segs)  # the fit, the labels and the merged rows all start from it
    rows = cut(segs.join(features.segment_features(segs, bars), "segment_id"))
    found = discovery.discover(rows, names, cfg.model, backend=cfg.backend)
    found = labels.dwell_filter(found, cfg.duration.dwell_bars)
    final = found
    if cfg.duration.enabled:
        decoded = labels.decode_durations(found, longest=cfg.duration.max_segments, shortest=cfg.duration.min_segments, continuation=cfg.duration.continuation)
        final = decoded.withColumns({"pre_hsmm_label": F.col("label"), "label": F.col("hsmm_label")})
    merged = labels.merge_runs(final)
    merged = merged.join(features.segment_features(merged.select("segment_id", "symbol", "start_idx", "end_idx"), bars), "segment_id")
    return {
        "segments": rows, "labels": found, "merged": merged, "descriptions": labels.describe_labels(merged, [n for n in names if n in merged.columns]), "transitions": labels.transitions(merged),
        "review_queue": review.review_queue(found),
    }


def causal_states(bars: DataFrame, cfg: PipelineConfig | None = None, *, min_rows: int = 100, every: int = 20, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Point-in-time flow: confirmed segments, their features, states scored out of sample, and diagnostics of them."""
    cfg = cfg or PipelineConfig()
    names = names or list(features.CAUSAL_FEATURES)
    bars = normalize(bars)
    segs = segments.segment_causal(bars, cfg.segmentation)
    if cfg.segmentation.bootstrap_iterations:
        stable = segments.bootstrap_stability(bars, cfg.segmentation, iterations=cfg.segmentation.bootstrap_iterations, causal=True)
        segs = segments.fold_in_stability(segs, stable, default=0.0)
    segs = cut(segs)
    rows = cut(segs.join(features.segment_features(segs, bars), "segment_id"))
    states = discovery.walk_forward(rows, names, cfg.model, min_rows=min_rows, every=every)
    versioned = states.withColumn("model_version", F.coalesce(F.col("oos_model_trained_at").cast("string"), F.lit("none")))
    return {"segments": rows, "states": states, "coverage": labels.coverage(versioned, ["model_version"]), "reasons": labels.unknown_reasons(versioned), "structure": labels.structure_summary(versioned)}
