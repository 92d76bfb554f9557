"""Review queue, stratified samples, and feedback of reviews into labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import require
from ..functions.numeric import clip, keep_last
from .discovery import hash_share, keyed_hash

UNKNOWN = "UNKNOWN"
REVIEWER = ("annotator", "review_status", "accepted", "true_label", "boundary_ok", "boundary_start_correction", "boundary_end_correction", "notes", "reviewed_at")
QUEUE = (
    "segment_id", "symbol", "start_timestamp", "end_timestamp", "candidate_status", "predicted_label", "suggested_semantic_label", "max_probability", "normalized_entropy",
    "recognizability", "unknown_reason", "review_priority", "sampling_stratum", "sampling_probability", *REVIEWER,
)


def _first(df: DataFrame, names: tuple, otherwise, kind: str = "string") -> F.Column:
    found = next((n for n in names if n in df.columns), None)
    return F.col(found).cast(kind) if found else F.lit(otherwise).cast(kind)


def review_queue(segments: DataFrame, reviews: DataFrame | None = None, *, limit: int | None = None) -> DataFrame:
    """Fixed columns, UNKNOWN first, then the less recognizable and less certain; ties by id."""
    label = F.coalesce(_first(segments, ("label", "display_label", "predicted_label", "hard_label"), UNKNOWN), F.lit(UNKNOWN))
    reason = F.coalesce(_first(segments, ("unknown_reason",), ""), F.lit(""))
    unknown = F.upper(label) == UNKNOWN
    inferred = F.when(reason == "unreviewed_candidate", "unreviewed_candidate").when(unknown, "model_abstention").otherwise("classified")
    status = F.coalesce(F.col("candidate_status"), F.lit("unreviewed_candidate")) if "candidate_status" in segments.columns else inferred
    entropy = _first(segments, ("normalized_entropy", "entropy", "posterior_entropy"), None, "double")
    recog = _first(segments, ("recognizability", "recognizability_score"), None, "double")
    priority = unknown.cast("int") * 10 + (1 - clip(F.coalesce(recog, F.lit(0.0)), 0.0, 1.0)) + clip(F.coalesce(entropy, F.lit(1.0)), 0.0, 1.0) * 0.25
    queue = segments.select(
        F.col("segment_id").cast("string").alias("segment_id"), _first(segments, ("symbol",), None).alias("symbol"), _first(segments, ("start_timestamp", "start"), None).alias("start_timestamp"),
        _first(segments, ("end_timestamp", "end"), None).alias("end_timestamp"), status.alias("candidate_status"), label.alias("predicted_label"), _first(segments, ("suggested_semantic_label",), None).alias("suggested_semantic_label"),
        _first(segments, ("max_probability", "confidence", "max_posterior"), None, "double").alias("max_probability"), entropy.alias("normalized_entropy"), recog.alias("recognizability"),
        _first(segments, ("unknown_reason", "abstention_reason"), "").alias("unknown_reason"), priority.alias("review_priority"), _first(segments, ("sampling_stratum",), None).alias("sampling_stratum"),
        _first(segments, ("sampling_probability",), None, "double").alias("sampling_probability"), *[F.lit(None).cast("string").alias(c) for c in REVIEWER],
    )
    if reviews is not None:
        queue = merge_reviews(queue, reviews)
    queue = queue.select(*QUEUE).orderBy(F.desc("review_priority"), "segment_id")
    return queue.limit(limit) if limit is not None else queue


def last_reviews(reviews: DataFrame, columns: list[str]) -> DataFrame:
    """(segment_id, columns as text) of each segment's last review: by reviewed_at, without a time last, then by the place in
    the table as read. Without reviewed_at the place alone decides."""
    require(reviews, ("segment_id",), "reviews")
    rows = reviews.select(F.col("segment_id").cast("string").alias("segment_id"), *[F.col(c).cast("string").alias(c) for c in dict.fromkeys([*columns, *[c for c in ("reviewed_at",) if c in reviews.columns]])])
    when = [F.col("reviewed_at").isNull().alias("_none"), F.col("reviewed_at").alias("_when")] if "reviewed_at" in reviews.columns else []
    return keep_last(rows, ["segment_id"], when).select("segment_id", *columns)


def merge_reviews(queue: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviewer columns from each segment's last review, where it has them."""
    have = [c for c in REVIEWER if c in reviews.columns]
    latest = last_reviews(reviews, have).select("segment_id", F.struct(*have).alias("_r"))
    out = queue.join(latest, "segment_id", "left")
    return out.select(*[F.coalesce(F.col(f"_r.{c}"), F.col(c)).alias(c) if c in have else F.col(c) for c in queue.columns])


def apply_reviews(segments: DataFrame, reviews: DataFrame, label: str = "label") -> DataFrame:
    """segments with supervised_label by each segment's last review: the corrected label, else the predicted one if it was
    accepted. Segments stay one row each."""
    have = [c for c in ("true_label", "accepted") if c in reviews.columns]
    r = last_reviews(reviews, have)
    true = F.trim("true_label") if "true_label" in have else F.lit(None).cast("string")
    r = r.select(F.col("segment_id").alias("_id"), F.when(~true.isin("", "nan", "<NA>"), true).alias("_true"), (F.lower("accepted").isin("true", "1", "yes", "y", "accepted") if "accepted" in have else F.lit(False)).alias("_ok"))
    out = segments.join(r, segments["segment_id"].cast("string") == r["_id"], "left")
    return out.withColumn("supervised_label", F.coalesce("_true", F.when(F.col("_ok"), F.col(label)))).drop("_id", "_true", "_ok")


def stratum(df: DataFrame) -> F.Column:
    keys = [F.coalesce(F.year("start").cast("string"), F.lit("NA")) if "start" in df.columns else F.lit("NA"), F.coalesce("label", F.lit(UNKNOWN))]
    return F.concat_ws("|", *keys, *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in ("industry", "market_regime", "size_bucket") if c in df.columns])


def allocation(df: DataFrame, target: int, *, unknown_share: float = 0.35, seed: int = 42) -> DataFrame:
    """(sampling_stratum, is_unknown, capacity, take): one from each stratum that has any left, round after round, until a
    pool's number is reached; in the last round strata go by a seeded hash. Rounds are not run: with level L all strata give
    min(capacity, L), and L is found from running sums over strata by capacity."""
    if target < 1 or not 0 <= unknown_share <= 1:
        raise ValueError("target must be positive and unknown_share between 0 and 1")
    caps = df.select(stratum(df).alias("sampling_stratum"), (F.upper(F.coalesce("label", F.lit(UNKNOWN))) == UNKNOWN).alias("is_unknown")).groupBy("sampling_stratum", "is_unknown").agg(F.count(F.lit(1)).alias("capacity"))
    # a row a stratum from here on
    pools = caps.agg(F.coalesce(F.sum(F.when(F.col("is_unknown"), F.col("capacity"))), F.lit(0)).alias("u"), F.coalesce(F.sum(F.when(~F.col("is_unknown"), F.col("capacity"))), F.lit(0)).alias("k"))
    total = F.least(F.lit(target), F.col("u") + F.col("k"))
    first = F.least(F.col("u"), F.rint(total * F.lit(float(unknown_share))))
    known = F.least(F.col("k"), total - first)
    pools = pools.select(F.least(F.col("u"), first + F.greatest(F.lit(0), total - first - known)).cast("long").alias("want_u"), known.cast("long").alias("want_k"))
    w = Window.partitionBy("is_unknown").orderBy("capacity", "sampling_stratum")
    rows = caps.crossJoin(F.broadcast(pools)).withColumn("want", F.when(F.col("is_unknown"), F.col("want_u")).otherwise(F.col("want_k")))
    rows = rows.withColumns({"i": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("is_unknown")), "below": F.coalesce(F.sum("capacity").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    # level if all smaller strata are full: what is left, shared by this and the larger ones
    rows = rows.withColumn("level", F.floor((F.col("want") - F.col("below")) / (F.col("n") - F.col("i"))))
    # smaller strata are full, so the first one that would not be has the level
    level = F.min(F.when(F.col("level") < F.col("capacity"), F.struct("i", "level"))).over(Window.partitionBy("is_unknown"))["level"]
    rows = rows.withColumn("base", F.least("capacity", F.greatest(F.coalesce(level, F.col("capacity")), F.lit(0))))
    rest = F.col("want") - F.sum("base").over(Window.partitionBy("is_unknown"))
    lucky = F.row_number().over(Window.partitionBy("is_unknown", F.col("base") < F.col("capacity")).orderBy(keyed_hash("sampling_stratum", seed), "sampling_stratum"))
    rows = rows.withColumns({"rest": rest, "lucky": lucky}).withColumn("take", F.col("base") + F.when((F.col("base") < F.col("capacity")) & (F.col("lucky") <= F.col("rest")), 1).otherwise(0))
    return rows.select("sampling_stratum", "is_unknown", "capacity", F.col("take").cast("long").alias("take"))


def stratified_sample(df: DataFrame, target: int, *, unknown_share: float = 0.35, seed: int = 42) -> DataFrame:
    """The queue of a seeded sample with each stratum's own sampling probability."""
    take = allocation(df, target, unknown_share=unknown_share, seed=seed).select("sampling_stratum", "take", "capacity", (F.col("take") / F.col("capacity")).alias("sampling_probability"))
    h = keyed_hash("segment_id", seed)
    rows = df.withColumns({"sampling_stratum": stratum(df), "_h": h}).drop("sampling_probability").join(take, "sampling_stratum").where(hash_share(F.col("_h"), F.col("take"), F.col("capacity")))
    w = Window.partitionBy("sampling_stratum").orderBy("_h", "segment_id")
    chosen = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= F.col("take")).drop("_r", "_h", "take", "capacity")
    return review_queue(chosen)


def resolve_correction(events: DataFrame, bars: DataFrame, side: str = "start") -> DataFrame:
    """events with {side}_resolved_idx: the correction as a whole number from 0, else the bar of its date (null: neither,
    or a date with more than one bar)."""
    c = F.col(f"boundary_{side}_correction").cast("string")
    own = F.when(c.rlike(r"^\s*\d+\s*$"), F.trim(c).cast("int"))
    b = bars.groupBy(F.col("symbol").alias("_s"), F.to_date("timestamp").alias("_d")).agg(F.max("idx").alias("_i"), F.count(F.lit(1)).alias("_n")).where("_n = 1")
    out = events.withColumn("_date", F.try_to_date(c)).join(b, (F.col("symbol") == F.col("_s")) & (F.col("_date") == F.col("_d")), "left")
    return out.withColumn(f"{side}_resolved_idx", F.coalesce(own, F.col("_i"))).drop("_date", "_s", "_d", "_i", "_n")


def append_annotation(path: str, events: DataFrame) -> None:
    """Append-only sink: events get an id and a time where they have none."""
    have = events.columns
    ids = F.coalesce(F.col("annotation_id"), F.expr("uuid()")) if "annotation_id" in have else F.expr("uuid()")
    when = F.coalesce(F.col("reviewed_at"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")) if "reviewed_at" in have else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    events.withColumns({"annotation_id": ids, "reviewed_at": when}).write.mode("append").parquet(path)
