"""Agreement of annotators: latest votes, consensus, weighted kappas, boundary agreement. Weights are inverse inclusion
probabilities (missing: 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import unique_rows
from ..functions.numeric import close_to

UNKNOWN = "UNKNOWN"


def latest_votes(events: DataFrame, order: str | None = None) -> DataFrame:
    """The last event of each (segment_id, annotator): undated ones first, then by time, then in order of arrival."""
    w = Window.partitionBy("segment_id", "annotator").orderBy(*([F.desc_nulls_last("reviewed_at")] if "reviewed_at" in events.columns else []), F.desc(order) if order else F.desc("_arrival"))
    out = events.withColumn("_arrival", F.lit(0) if order else F.monotonically_increasing_id())
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_arrival")


def _weight(votes: DataFrame) -> F.Column:
    p = F.max("sampling_probability") if "sampling_probability" in votes.columns else F.lit(1.0)
    return 1 / F.coalesce(p, F.lit(1.0))


def _quoted(text: F.Column) -> F.Column:
    """text inside a JSON string."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for plain, escaped in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out


def with_consensus(features: DataFrame, agreed: DataFrame, *, known_only: bool = True) -> DataFrame:
    """Feature rows with their segment's consensus (label as truth, its weight), for supervised fits: segments without one are
    left out, and disputed or UNKNOWN ones too unless asked for. A segment with two consensus rows fails."""
    rows = agreed.where(F.col("consensus_label") != UNKNOWN) if known_only else agreed
    rows = unique_rows(rows.select(F.col("segment_id").cast("string").alias("_id"), F.col("consensus_label").alias("truth"), "weight", "agreement_rate"), ["_id"], "consensus")
    return features.join(rows, features["segment_id"].cast("string") == rows["_id"]).drop("_id")


def consensus(votes: DataFrame) -> DataFrame:
    """A row a segment: a label only if two or more raters all agree, else UNKNOWN; votes as a JSON object of
    numbers by label, sorted."""
    per = votes.where("label IS NOT NULL").withColumn("label", F.col("label").cast("string"))
    counts = per.groupBy("segment_id", "label").agg(F.count(F.lit(1)).alias("n"), _weight(per).alias("w"))
    top = F.max_by("label", F.struct("n", "label"))
    out = counts.groupBy("segment_id").agg(
        F.sum("n").alias("annotator_count"), F.max("n").alias("_top"), F.count(F.lit(1)).alias("_labels"), top.alias("_label"), F.max("w").alias("weight"),
        F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("label", "n"))), lambda x: F.concat(F.lit('"'), _quoted(x["label"]), F.lit('": '), x["n"].cast("string"))), ", "), F.lit("}")).alias("vote_counts"),
    )
    agreed = (F.col("_labels") == 1) & (F.col("annotator_count") >= 2)
    return out.select(
        "segment_id", F.when(agreed, F.col("_label")).otherwise(UNKNOWN).alias("consensus_label"), "annotator_count", (F.col("_top") / F.col("annotator_count").cast("double")).alias("agreement_rate"),
        (~agreed).alias("is_disputed"), "vote_counts", F.when(agreed, "unanimous").when(F.col("annotator_count") < 2, "insufficient_independent_raters").otherwise("label_disagreement").alias("consensus_reason"), "weight",
    )


def _pairs(votes: DataFrame, value: list[str]) -> DataFrame:
    """Votes of two raters on one segment, the smaller name first."""
    side = lambda s: votes.select("segment_id", F.col("annotator").alias(f"annotator_{s}"), *[F.col(v).alias(f"{v}_{s}") for v in value])
    w = votes.groupBy("segment_id").agg(_weight(votes).alias("w"))
    return side("a").join(side("b"), "segment_id").where("annotator_a < annotator_b").join(w, "segment_id")


def cohen_kappa(votes: DataFrame) -> DataFrame:
    """A row a pair of raters; kappa is null where chance alone would agree."""
    votes = votes.where("label IS NOT NULL")
    pairs = _pairs(votes.withColumn("label", F.col("label").cast("string")), ["label"])
    by = ["annotator_a", "annotator_b"]
    total = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("shared_segments"), F.sum("w").alias("weighted_segments"), (F.sum(F.when(F.col("label_a") == F.col("label_b"), F.col("w")).otherwise(0.0)) / F.sum("w")).alias("raw_agreement"))
    side = lambda s: pairs.groupBy(*by, F.col(f"label_{s}").alias("label")).agg(F.sum("w").alias(f"w_{s}"))
    chance = side("a").join(side("b"), [*by, "label"]).groupBy(*by).agg(F.sum(F.col("w_a") * F.col("w_b")).alias("joint"))
    out = total.join(chance, by, "left").withColumn("_e", F.coalesce("joint", F.lit(0.0)) / (F.col("weighted_segments") * F.col("weighted_segments")))
    kappa = F.when(~close_to(F.col("_e"), F.lit(1.0)), (F.col("raw_agreement") - F.col("_e")) / F.nullif(1 - F.col("_e"), F.lit(0.0)))
    return out.withColumn("cohen_kappa", kappa).drop("_e", "joint")


def fleiss_kappa(votes: DataFrame) -> DataFrame:
    """One row: kappa of all segments with two or more votes; null with fewer than three raters."""
    votes = votes.where("label IS NOT NULL")
    counts = votes.groupBy("segment_id", "label").agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows = counts.groupBy("segment_id").agg(F.sum("n").alias("r"), F.sum(F.col("n") * F.col("n")).alias("sq")).where("r >= 2").join(votes.groupBy("segment_id").agg(_weight(votes).alias("w")), "segment_id")
    top = rows.agg(F.sum(F.col("w") * F.col("r")).alias("wr"), (F.sum(F.col("w") * (F.col("sq") - F.col("r")) / (F.col("r") * (F.col("r") - 1))) / F.sum("w")).alias("p"), F.count(F.lit(1)).alias("segments"))
    share = counts.join(rows.select("segment_id", "w"), "segment_id").groupBy("label").agg(F.sum(F.col("w") * F.col("n")).alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("s2"))
    raters = votes.agg(F.count_distinct("annotator").alias("raters"))
    out = top.crossJoin(share).crossJoin(raters).withColumn("_e", F.col("s2") / F.nullif(F.col("wr") * F.col("wr"), F.lit(0.0)))  # one row each
    kappa = F.when((F.col("raters") >= 3) & ~close_to(F.col("_e"), F.lit(1.0)), (F.col("p") - F.col("_e")) / F.nullif(1 - F.col("_e"), F.lit(0.0)))
    return out.select("segments", kappa.alias("fleiss_kappa"))


def boundary_agreement(votes: DataFrame, tolerance: int = 3) -> DataFrame:
    """A row a pair of raters and side: weighted matches within tolerance, precision, recall, F1. A correction takes the
    place of the sampled index; only segments both reviewed count."""
    if tolerance < 0:
        raise ValueError("tolerance must not be negative")
    for side in ("start", "end"):
        own = [F.col(c).cast("double") for c in (f"boundary_{side}_correction", f"{side}_idx") if c in votes.columns]
        votes = votes.withColumn(f"b_{side}", F.coalesce(*own) if own else F.lit(None).cast("double"))
    pairs = _pairs(votes, ["b_start", "b_end"])
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("boundary"), F.col(f"b_{s}_a").alias("l"), F.col(f"b_{s}_b").alias("r")) for s in ("start", "end")]))
    rows = pairs.select("annotator_a", "annotator_b", "w", each.alias("x")).select("annotator_a", "annotator_b", "w", "x.*")
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    s = lambda cond: F.sum(F.when(cond, F.col("w")).otherwise(0.0))
    out = rows.groupBy("annotator_a", "annotator_b", "boundary").agg(
        F.count_if(both).alias("shared_segments"), s(both & (F.abs(F.col("l") - F.col("r")) <= tolerance)).alias("weighted_true_positive"), s(F.col("l").isNotNull()).alias("weighted_predicted"), s(F.col("r").isNotNull()).alias("weighted_reference")
    ).where("shared_segments > 0")
    tp = F.col("weighted_true_positive")
    out = out.withColumns({"precision": tp / F.nullif(F.col("weighted_predicted"), F.lit(0.0)), "recall": tp / F.nullif(F.col("weighted_reference"), F.lit(0.0))})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)))
