"""Schema checks made while a plan is built: required columns, and columns that would look ahead."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Parts of column names that give away the future, for each layer (fixed values).
DISCOVERY_TOKENS = ("future", "forward", "target", "label", "return_5d", "return_20d", "return_60d")
VALIDATION_TOKENS = ("future", "forward", "fwd", "next_", "return_5", "return_20", "return_60")
STATE_TOKENS = ("future_", "forward_", "fwd_", "next_return", "hsmm_")
#: Columns that are no features: of unsupervised fits, and of supervised ones (fixed values), with their prefixes.
NOT_FEATURES = frozenset((
    "segment_id", "symbol", "start", "end", "start_timestamp", "end_timestamp", "segment_no", "start_idx", "end_idx", "start_boundary_probability", "end_boundary_probability",
    "boundary_probability", "boundary_uncertainty", "max_probability", "posterior_entropy", "model_disagreement", "density_score", "density_is_low", "recognizability", "is_unknown",
    "context_conflict", "label", "hard_label", "semantic_label", "review_status", "review_note",
))
NOT_FEATURE_PREFIXES = ("prob_", "ensemble_", "gate_", "gmm_")
NOT_VALIDATION_FEATURES = frozenset((
    "segment_id", "symbol", "start", "end", "start_timestamp", "end_timestamp", "start_idx", "end_idx", "label", "consensus_label", "annotator", "segment_no", "max_probability",
    "posterior_entropy", "model_disagreement", "density_score", "density_is_low", "recognizability", "is_unknown", "cluster_support_valid",
))
NOT_VALIDATION_PREFIXES = ("prob_", "future_", "forward_")


def require(df: DataFrame, columns: Iterable[str], what: str = "data") -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing columns: {missing}")


def reject_look_ahead(columns: Iterable[str], tokens: Iterable[str]) -> None:
    bad = sorted(c for c in columns if any(t in c.lower() for t in tokens))
    if bad:
        raise ValueError(f"columns look ahead: {bad}")


def _inferred(df: DataFrame, columns: Iterable[str] | None, no: frozenset[str], prefixes: tuple[str, ...], what: str) -> list[str]:
    if columns is not None:
        columns = list(columns)
        missing = sorted(set(columns) - set(df.columns))
        if missing:
            raise ValueError(f"feature columns not found: {missing}")
    else:
        columns = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in no and not f.name.startswith(prefixes)]
    if not columns:
        raise ValueError(f"no {what} features")
    return columns


def numeric_features(df: DataFrame, columns: Iterable[str] | None = None) -> list[str]:
    """Features of an unsupervised fit: the given columns, which have to be there, or all numeric ones that are neither
    identifiers nor outputs of a model."""
    return _inferred(df, columns, NOT_FEATURES, NOT_FEATURE_PREFIXES, "numeric segment")


def validation_features(df: DataFrame, columns: Iterable[str] | None = None) -> list[str]:
    """Features of a supervised fit, given or inferred; none may look ahead."""
    found = _inferred(df, columns, NOT_VALIDATION_FEATURES, NOT_VALIDATION_PREFIXES, "descriptive numeric")
    reject_look_ahead(found, VALIDATION_TOKENS)
    return found


def unique_rows(df: DataFrame, keys: list[str], what: str = "table") -> DataFrame:
    """df, which fails while it runs if a key has more than one row. Where df is joined on the keys next, the exchange that
    the join needs does for this too."""
    from pyspark.sql import functions as F

    rest = [c for c in df.columns if c not in keys]
    told = F.concat(F.lit(f"{what} has more than one row for "), F.to_json(F.struct(*keys)))
    one = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.first(F.struct(*rest)).alias("_row"))
    row = F.when(F.col("_rows") == 1, F.col("_row")).otherwise(F.raise_error(told).cast(df.select(F.struct(*rest).alias("s")).schema["s"].dataType))
    return one.withColumn("_row", row).select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])
