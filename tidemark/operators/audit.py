"""Audits as aggregates and anti-joins: segments, causal states, daily partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "UNKNOWN"


def audit_segments(segments: DataFrame, features: DataFrame, review: DataFrame | None = None) -> DataFrame:
    """(code, n): repeated ids, broken geometry, ids without features, labels before their time, bad probabilities where
    there are such columns, review rows without a segment."""
    geometry = (F.col("start") > F.col("end")) | (F.col("end_idx") < F.col("start_idx")) | (F.col("n_bars") != F.col("end_idx") - F.col("start_idx") + 1)
    one = [("duplicate_segment_id", F.count(F.lit(1)) - F.count_distinct("segment_id")), ("invalid_segment_geometry", F.count_if(geometry))]
    if "label" in segments.columns:
        one.append(("premature_label", F.count_if(F.coalesce(F.col("label"), F.lit(UNKNOWN)) != UNKNOWN)))
    probabilities = [c for c in ("start_boundary_probability", "end_boundary_probability", "boundary_probability") if c in segments.columns]
    if probabilities:
        bad = ~F.col(probabilities[0]).between(0, 1)
        for c in probabilities[1:]:
            bad = bad | ~F.col(c).between(0, 1)
        one.append(("invalid_probability", F.count_if(bad)))
    top = segments.agg(F.array(*[F.struct(F.lit(n).alias("code"), x.cast("long").alias("n")) for n, x in one]).alias("c")).select(F.explode("c").alias("c")).select("c.*")
    ids = segments.select("segment_id").distinct()
    lost = ids.join(features.select("segment_id").distinct(), "segment_id", "left_anti").agg(F.lit("missing_features").alias("code"), F.count(F.lit(1)).alias("n"))
    out = top.unionByName(lost)
    if review is not None:
        out = out.unionByName(review.select("segment_id").distinct().join(ids, "segment_id", "left_anti").agg(F.lit("unmatched_review").alias("code"), F.count(F.lit(1)).alias("n")))
    return out


def audit_states(states: DataFrame) -> DataFrame:
    """(code, n) of out-of-sample states: trained on rows as late as their own, training rows not before the model, known
    labels of models that did not converge, states without a time, unknown rows without a reason."""
    late = F.col("oos_train_max_available_at") >= F.col("oos_model_trained_at")
    checks = {
        "model_after_state": F.col("oos_model_trained_at") > F.col("state_available_at"), "training_not_before_model": late, "known_without_model": ~F.col("is_unknown") & F.col("oos_model_trained_at").isNull(),
        "state_without_time": F.col("state_available_at").isNull(), "unknown_without_reason": F.col("is_unknown") & (F.coalesce("unknown_reason", F.lit("")) == ""),
    }
    return states.agg(F.array(*[F.struct(F.lit(n).alias("code"), F.count_if(F.coalesce(c, F.lit(False))).alias("n")) for n, c in checks.items()]).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def audit_artifacts(segments: DataFrame, features: DataFrame, review: DataFrame, buckets: DataFrame | None = None, *, complete: bool = False) -> DataFrame:
    """(bucket, code, artifact, n) of a build in buckets, issues only: each artifact has a column bucket. buckets is the
    manifest (bucket, status, segments). Codes: bucket_incomplete (if the build has to be complete), row_count_mismatch,
    duplicate_segment_id, segment_id_set_mismatch, cross_bucket_duplicate_id, premature_semantic_label,
    invalid_segment_geometry and invalid_probability (the artifact is then the column)."""
    parts = {"segments": segments, "features": features, "review": review}
    marks = {"segments": ("label", "candidate_label"), "features": ("label", "candidate_label"), "review": ("predicted_label",)}
    issues = []
    ids = None
    for name, df in parts.items():
        named = [c for c in marks[name] if c in df.columns]
        early = F.lit(False)
        for c in named:
            early = early | (F.coalesce(F.col(c), F.lit("")) != UNKNOWN)
        one = df.select(F.col("bucket").cast("string").alias("bucket"), F.col("segment_id").cast("string").alias("segment_id"), early.alias("early"))
        per = one.groupBy("bucket", "segment_id").agg(F.count(F.lit(1)).alias("n"), F.max("early").alias("early")).select("bucket", "segment_id", F.lit(name).alias("artifact"), "n", "early")
        ids = per if ids is None else ids.unionByName(per)
    # a row a bucket, id and artifact feeds all checks of ids
    counts = ids.groupBy("bucket", "artifact").agg(F.sum("n").alias("rows"), F.count_if(F.col("n") > 1).alias("repeated"), F.sum(F.when(F.col("n") > 1, F.col("n") - 1)).alias("more"), F.max("early").alias("early"))
    issues.append(counts.where("repeated > 0").select("bucket", F.lit("duplicate_segment_id").alias("code"), "artifact", F.col("more").alias("n")))
    issues.append(counts.where("early").select("bucket", F.lit("premature_semantic_label").alias("code"), F.when(F.col("artifact") == "review", "review").otherwise(F.col("artifact")).alias("artifact"), F.lit(1).cast("long").alias("n")))
    sets = ids.groupBy("bucket", "segment_id").agg(F.count(F.lit(1)).alias("in")).groupBy("bucket").agg(F.count_if(F.col("in") < len(parts)).alias("n")).where("n > 0")
    issues.append(sets.select("bucket", F.lit("segment_id_set_mismatch").alias("code"), F.lit(None).cast("string").alias("artifact"), "n"))
    first = ids.where("artifact = 'segments'").groupBy("segment_id").agg(F.array_sort(F.collect_set("bucket")).alias("b")).where("size(b) > 1")
    again = first.select(F.explode(F.slice("b", 2, F.size("b"))).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    issues.append(again.select("bucket", F.lit("cross_bucket_duplicate_id").alias("code"), F.lit(None).cast("string").alias("artifact"), "n"))
    rows = lambda name: F.coalesce(F.max(F.when(F.col("artifact") == name, F.col("rows"))), F.lit(0)).alias(f"_{name}")
    wide = counts.groupBy("bucket").agg(*[rows(n) for n in parts])
    unequal = (F.col("_segments") != F.col("_features")) | (F.col("_segments") != F.col("_review"))
    if buckets is not None:
        b = buckets.select(F.col("bucket").cast("string").alias("bucket"), "status", F.col("segments").cast("long").alias("_told"))
        if complete:
            issues.append(b.where("status IS NULL OR status <> 'complete'").select("bucket", F.lit("bucket_incomplete").alias("code"), F.col("status").alias("artifact"), F.lit(1).cast("long").alias("n")))
        wide = b.where("status = 'complete'").join(wide, "bucket", "left").fillna(0, [f"_{n}" for n in parts])
        unequal = unequal | (F.col("_segments") != F.coalesce("_told", F.lit(-1)))
    issues.append(wide.where(unequal).select("bucket", F.lit("row_count_mismatch").alias("code"), F.lit(None).cast("string").alias("artifact"), F.col("_segments").alias("n")))
    geometry = (F.col("start") > F.col("end")) | (F.col("end_idx") < F.col("start_idx")) | (F.col("n_bars") != F.col("end_idx") - F.col("start_idx") + 1)
    checks = [("invalid_segment_geometry", None, F.coalesce(geometry, F.lit(True)))]
    checks += [("invalid_probability", c, ~F.coalesce(F.col(c).between(0, 1), F.lit(False))) for c in ("start_boundary_probability", "end_boundary_probability", "boundary_probability") if c in segments.columns]
    cells = F.array(*[F.struct(F.lit(code).alias("code"), F.lit(column).cast("string").alias("artifact"), F.count_if(bad).alias("n")) for code, column, bad in checks])
    shape = segments.groupBy(F.col("bucket").cast("string").alias("bucket")).agg(cells.alias("c")).select("bucket", F.explode("c").alias("c")).select("bucket", "c.*").where("n > 0")
    out = shape
    for x in issues:
        out = out.unionByName(x)
    return out


def active_listings(days: DataFrame, master: DataFrame) -> DataFrame:
    """(trade_date, active): codes of master (list_date, delist_date; both days count) that are listed on each date of days.
    Listings begun less listings ended run over days, one row a day, so no listing is paired with a date."""
    begun = master.where("list_date IS NOT NULL").groupBy(F.col("list_date").cast("date").alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    ended = master.where("list_date IS NOT NULL AND delist_date IS NOT NULL").groupBy(F.date_add(F.col("delist_date").cast("date"), 1).alias("_day")).agg((-F.count(F.lit(1))).alias("_n"))
    asked = days.select("trade_date").distinct().select(F.col("trade_date").cast("date").alias("_day"), F.lit(0).cast("long").alias("_n"), "trade_date")
    both = asked.unionByName(begun, allowMissingColumns=True).unionByName(ended, allowMissingColumns=True)
    upto = Window.orderBy("_day").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("active", F.sum("_n").over(upto)).where("trade_date IS NOT NULL").select("trade_date", "active")


def audit_partitions(daily: DataFrame, expected: DataFrame, master: DataFrame | None = None, *, least_match: float = 0.999, row_limit: int = 6000) -> DataFrame:
    """(trade_date, code): dates of expected (trade_date) without rows, with repeated codes, too few adjustment factors or as
    many rows as the vendor's limit; with master, codes listed that day but absent."""
    per = daily.groupBy("trade_date").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ts_code").alias("codes"), F.avg(F.col("adj_factor").isNotNull().cast("double")).alias("match"))
    missing = expected.join(per, "trade_date", "left_anti").select("trade_date", F.lit("missing_partition").alias("code"))
    codes = F.array(F.when(F.col("n") > F.col("codes"), "duplicate_keys"), F.when(F.col("match") < least_match, "factor_match"), F.when(F.col("n") >= row_limit, "possibly_truncated"))
    out = missing.unionByName(per.select("trade_date", F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code")))
    if master is not None:
        m = master.select(F.col("ts_code").alias("_c"), "list_date", "delist_date")
        day = F.col("trade_date").cast("date")
        there = daily.join(m, F.col("ts_code") == F.col("_c")).where((F.col("list_date") <= day) & (F.col("delist_date").isNull() | (F.col("delist_date") >= day)))
        there = there.groupBy("trade_date").agg(F.count_distinct("ts_code").alias("there"))
        gaps = active_listings(per, master).join(there, "trade_date", "left").where(F.col("active") > F.coalesce("there", F.lit(0)))
        out = out.unionByName(gaps.select("trade_date", F.lit("universe_gap").alias("code")))
    return out


#: Endpoints that a day needs (fixed values).
REQUIRED = ("daily", "adj_factor")


def audit_daily(daily: DataFrame, entries: DataFrame, endpoints: DataFrame, expected: DataFrame, master: DataFrame | None = None, *, required: tuple = REQUIRED, least_match: float = 0.999, least_coverage: float | None = None) -> dict[str, DataFrame]:
    """The audit of a build by days against a calendar. daily: trade_date, ts_code, adj_factor; entries: trade_date, status,
    rows; endpoints: trade_date, endpoint, status, truncated; expected: trade_date. Tables: issues (trade_date, code, detail),
    dates (a row an expected date: status, rows, adj_factor_match_rate, duplicate_keys, active_universe, universe_coverage),
    endpoint_status (endpoint, status, n), extra_dates, and summary (one row)."""
    days = expected.select("trade_date").distinct()
    own = daily.groupBy("trade_date", "ts_code").agg(F.count(F.lit(1)).alias("n"), F.count("adj_factor").alias("m"))
    per = own.groupBy("trade_date").agg(F.sum("n").alias("rows"), F.sum("m").alias("matched"), F.sum(F.col("n") - 1).alias("duplicate_keys"))
    told = entries.select("trade_date", "status", F.col("rows").cast("long").alias("told_rows"), F.lit(True).alias("_told"))
    dates = days.join(told, "trade_date", "left").join(per, "trade_date", "left")
    rate = F.col("matched") / F.nullif(F.col("rows").cast("double"), F.lit(0.0))
    dates = dates.withColumn("adj_factor_match_rate", rate)
    if master is not None:
        dates = dates.join(active_listings(days, master).withColumnRenamed("active", "active_universe"), "trade_date", "left")
        dates = dates.withColumn("universe_coverage", F.col("rows") / F.nullif(F.col("active_universe").cast("double"), F.lit(0.0)))
    else:
        dates = dates.withColumns({"active_universe": F.lit(None).cast("long"), "universe_coverage": F.lit(None).cast("double")})
    there = F.col("rows").isNotNull()
    checks = [
        ("missing_manifest_date", F.col("_told").isNull(), F.lit(None)), ("partition_not_complete", F.col("_told") & (F.coalesce("status", F.lit("unknown")) != "complete"), F.col("status")),
        ("partition_file_missing", F.col("_told") & ~there, F.lit(None)), ("manifest_row_count_mismatch", F.col("_told") & there & (F.col("told_rows") != F.col("rows")), F.col("told_rows").cast("string")),
        ("duplicate_security_date_keys", F.col("_told") & (F.col("duplicate_keys") > 0), F.col("duplicate_keys").cast("string")), ("low_adj_factor_match", F.col("_told") & (rate < least_match), F.lit(None)),
    ]
    if least_coverage is not None:
        checks.append(("low_universe_coverage", F.col("_told") & there & (F.col("universe_coverage").isNull() | (F.col("universe_coverage") < least_coverage)), F.lit(None)))
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("code"), d.cast("string").alias("detail"))) for n, c, d in checks]), lambda x: x.isNotNull())
    issues = dates.select("trade_date", F.explode(found).alias("i")).select("trade_date", "i.code", "i.detail")
    # a needed endpoint that a told day does not list is missing
    needed = days.join(told.select("trade_date"), "trade_date").withColumn("endpoint", F.explode(F.array(*[F.lit(e) for e in required])))
    said = endpoints.join(days, "trade_date").select("trade_date", "endpoint", F.col("status").alias("endpoint_status"), "truncated")
    states = needed.withColumn("needed", F.lit(True)).join(said, ["trade_date", "endpoint"], "full_outer").withColumn("endpoint_status", F.coalesce("endpoint_status", F.lit("missing")))
    bad = states.where("needed AND endpoint_status NOT IN ('ok', 'complete')").select("trade_date", F.lit("required_endpoint_not_ok").alias("code"), F.concat_ws("=", "endpoint", "endpoint_status").alias("detail"))
    cut = states.where("coalesce(truncated, false) OR endpoint_status = 'truncated'").select("trade_date", F.lit("suspected_truncation").alias("code"), F.col("endpoint").alias("detail"))
    issues = issues.unionByName(bad).unionByName(cut)
    q = lambda p: F.percentile("universe_coverage", F.lit(p))
    done = F.count_if((F.col("status") == "complete") & there)
    summary = dates.agg(
        F.count(F.lit(1)).alias("expected_dates"), done.alias("completed_partitions"), F.sum(F.when(F.col("_told"), F.col("rows"))).alias("rows"), (F.sum("matched") / F.nullif(F.sum("rows").cast("double"), F.lit(0.0))).alias("adj_factor_match_rate"),
        F.min("universe_coverage").alias("coverage_min"), q(0.01).alias("coverage_p01"), q(0.05).alias("coverage_p05"), q(0.5).alias("coverage_median"), q(0.95).alias("coverage_p95"), F.max("universe_coverage").alias("coverage_max"),
        F.count_if(F.col("universe_coverage") < 0.9).alias("dates_below_90pct"),
    )
    summary = summary.crossJoin(F.broadcast(issues.agg(F.count(F.lit(1)).alias("issue_count"))))  # one row each
    extra = entries.select("trade_date").distinct().join(days, "trade_date", "left_anti")
    return {
        "summary": summary.withColumn("passed", F.col("issue_count") == 0), "issues": issues, "dates": dates.drop("_told", "matched"),
        "endpoint_status": states.groupBy("endpoint", F.col("endpoint_status").alias("status")).agg(F.count(F.lit(1)).alias("n")), "extra_dates": extra,
    }
