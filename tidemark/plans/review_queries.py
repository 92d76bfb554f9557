"""Queries over annotations, scores and review pools."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement, audit, calibration, review
from ..sources.fixtures import load, oracle
from .bars_queries import rounded

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def votes(spark, d):
    return load(spark, d, "f7_annotations")


def scored(spark, d):
    """Truth and two probabilities; every ninth truth is UNKNOWN."""
    rows = load(spark, d, "f7_scored")
    truth = F.when(F.col("row_id") % 9 == 0, "UNKNOWN").otherwise(F.col("truth"))
    return rows.select("row_id", truth.alias("truth"), (1 - F.col("p_good")).alias("prob_BAD"), F.col("p_good").alias("prob_GOOD"), (1.0 / (1 + F.col("row_id") % 3)).alias("weight"))


LABELS = ["BAD", "GOOD"]
SCORED = """
, s AS (SELECT row_id, CASE WHEN row_id % 9 = 0 THEN 'UNKNOWN' ELSE truth END AS truth, 1 - p_good AS pb, p_good AS pg, CAST(1 AS DOUBLE) / (1 + row_id % 3) AS w FROM f7_scored),
c AS (SELECT *, greatest(pb, pg) AS conf, CASE WHEN pb >= pg THEN 'BAD' ELSE 'GOOD' END AS said, CASE WHEN truth = CASE WHEN pb >= pg THEN 'BAD' ELSE 'GOOD' END THEN 1.0 ELSE 0.0 END AS ok FROM s)
"""
REVISED = """
, e AS (SELECT *, 0 AS ord, CAST(NULL AS TIMESTAMP) AS reviewed_at FROM f7_annotations UNION ALL SELECT segment_id, annotator, 1 - label, sampling_probability, start_idx, 1, CASE WHEN CAST(segment_id AS BIGINT) % 2 = 0 THEN TIMESTAMP '2024-01-05' END FROM f7_annotations WHERE CAST(segment_id AS BIGINT) % 6 = 0)
"""


@query("latest_annotations", oracle("f7_annotations", REVISED + "SELECT segment_id, annotator, label FROM (SELECT *, row_number() OVER (PARTITION BY segment_id, annotator ORDER BY reviewed_at DESC NULLS LAST, ord DESC) AS n FROM e) WHERE n = 1"))
def latest_annotations(spark, d):
    rows = votes(spark, d)
    old = rows.withColumns({"ord": F.lit(0), "reviewed_at": F.lit(None).cast("timestamp_ntz")})
    i = F.col("segment_id").cast("long")
    new = rows.where(i % 6 == 0).withColumns({"label": 1 - F.col("label"), "ord": F.lit(1), "reviewed_at": F.when(i % 2 == 0, F.lit("2024-01-05").cast("timestamp_ntz"))})
    return agreement.latest_votes(old.unionByName(new), "ord").select("segment_id", "annotator", "label")


@query("consensus_labels", oracle("f7_annotations", """
, c AS (SELECT segment_id, CAST(label AS VARCHAR) AS label, count(*) AS n, max(1 / sampling_probability) AS w FROM f7_annotations GROUP BY ALL),
g AS (SELECT segment_id, sum(n) AS raters, max(n) AS top, count(*) AS k, arg_max(label, n * 100 + CAST(label AS INT)) AS label, '{' || string_agg('"' || label || '": ' || n, ', ' ORDER BY label) || '}' AS v, max(w) AS w FROM c GROUP BY segment_id)
SELECT segment_id, CASE WHEN k = 1 AND raters >= 2 THEN label ELSE 'UNKNOWN' END AS consensus_label, CAST(raters AS BIGINT) AS annotator_count, round(top / raters, 6) AS agreement_rate, NOT (k = 1 AND raters >= 2) AS is_disputed, v AS vote_counts,
       CASE WHEN k = 1 AND raters >= 2 THEN 'unanimous' WHEN raters < 2 THEN 'insufficient_independent_raters' ELSE 'label_disagreement' END AS consensus_reason, round(w, 6) AS weight FROM g"""))
def consensus_labels(spark, d):
    return rounded(agreement.consensus(votes(spark, d)))


PAIRS = """
, w AS (SELECT segment_id, max(1 / sampling_probability) AS w FROM f7_annotations GROUP BY ALL),
p AS (SELECT a.segment_id, a.annotator AS x, b.annotator AS y, CAST(a.label AS VARCHAR) AS la, CAST(b.label AS VARCHAR) AS lb, a.start_idx AS sa, b.start_idx AS sb, w.w FROM f7_annotations a JOIN f7_annotations b ON a.segment_id = b.segment_id AND a.annotator < b.annotator JOIN w ON w.segment_id = a.segment_id)
"""


@query("cohen_kappa", oracle("f7_annotations", PAIRS + """
, t AS (SELECT x, y, count(*) AS n, sum(w) AS sw, sum(CASE WHEN la = lb THEN w ELSE 0 END) / sum(w) AS po FROM p GROUP BY ALL), a AS (SELECT x, y, la AS l, sum(w) AS wa FROM p GROUP BY ALL), b AS (SELECT x, y, lb AS l, sum(w) AS wb FROM p GROUP BY ALL),
e AS (SELECT x, y, sum(wa * wb) AS j FROM a JOIN b USING (x, y, l) GROUP BY ALL)
SELECT x AS annotator_a, y AS annotator_b, n AS shared_segments, round(sw, 6) AS weighted_segments, round(po, 6) AS raw_agreement, round((po - j / (sw * sw)) / (1 - j / (sw * sw)), 6) AS cohen_kappa FROM t JOIN e USING (x, y)"""))
def cohen_kappa(spark, d):
    return rounded(agreement.cohen_kappa(votes(spark, d)))


@query("fleiss_kappa", oracle("f7_annotations", """
, c AS (SELECT segment_id, label, CAST(count(*) AS DOUBLE) AS n FROM f7_annotations GROUP BY ALL), r AS (SELECT segment_id, sum(n) AS r, sum(n * n) AS sq FROM c GROUP BY ALL HAVING sum(n) >= 2), w AS (SELECT segment_id, max(1 / sampling_probability) AS w FROM f7_annotations GROUP BY ALL),
t AS (SELECT sum(w * r) AS wr, sum(w * (sq - r) / (r * (r - 1))) / sum(w) AS p, count(*) AS segments FROM r JOIN w USING (segment_id)), s AS (SELECT sum(s * s) AS s2 FROM (SELECT label, sum(w * n) AS s FROM c JOIN r USING (segment_id) JOIN w USING (segment_id) GROUP BY label))
SELECT segments, round((p - s2 / (wr * wr)) / (1 - s2 / (wr * wr)), 6) AS fleiss_kappa FROM t, s"""))
def fleiss_kappa(spark, d):
    return rounded(agreement.fleiss_kappa(votes(spark, d)))


@query("boundary_annotation_agreement", oracle("f7_annotations", PAIRS + """
, g AS (SELECT x, y, count(*) AS n, sum(CASE WHEN abs(sa - sb) <= 3 THEN w ELSE 0 END) AS tp, sum(w) AS s FROM p GROUP BY ALL)
SELECT x AS annotator_a, y AS annotator_b, 'start' AS boundary, n AS shared_segments, round(tp, 6) AS weighted_true_positive, round(s, 6) AS weighted_predicted, round(s, 6) AS weighted_reference, round(tp / s, 6) AS precision, round(tp / s, 6) AS recall, round(tp / s, 6) AS f1 FROM g"""))
def boundary_annotation_agreement(spark, d):
    return rounded(agreement.boundary_agreement(votes(spark, d)))


BIN = "CASE " + " ".join(f"WHEN conf < CAST({i / 10!r} AS DOUBLE) THEN {i - 1}" for i in range(1, 10)) + " ELSE 9 END"


@query("ece", oracle("f7_scored", SCORED + f", b AS (SELECT {BIN} AS bin, sum(w) AS w, sum(w * conf) / sum(w) AS c, sum(w * ok) / sum(w) AS a FROM c GROUP BY ALL) SELECT round(sum(w * abs(c - a)) / sum(w), 6) AS ece FROM b"))
def ece(spark, d):
    return rounded(calibration.expected_calibration_error(scored(spark, d), LABELS))


@query("reliability", oracle("f7_scored", SCORED + f", b AS (SELECT {BIN} AS bin, count(*) AS n, sum(w) AS w, sum(w * conf) / sum(w) AS c, sum(w * ok) / sum(w) AS a FROM c GROUP BY ALL) SELECT CAST(r.i AS INT) AS bin, coalesce(n, 0) AS n, round(coalesce(w, 0.0), 6) AS weight, round(c, 6) AS confidence, round(a, 6) AS accuracy FROM range(10) r(i) LEFT JOIN b ON b.bin = r.i"))
def reliability(spark, d):
    return rounded(calibration.reliability(scored(spark, d), LABELS))


CURVE = SCORED + ", t AS (SELECT CAST(i AS DOUBLE) / 100 AS t FROM range(101) r(i)), k AS (SELECT t, sum(CASE WHEN conf >= t THEN w ELSE 0 END) / sum(w) AS cov, sum(CASE WHEN conf >= t THEN w * (1 - ok) ELSE 0 END) / nullif(sum(CASE WHEN conf >= t THEN w ELSE 0 END), 0) AS risk FROM t, c GROUP BY t) "


@query("coverage_risk", oracle("f7_scored", CURVE + "SELECT t AS threshold, round(cov, 6) AS coverage, round(risk, 6) AS risk FROM k"))
def coverage_risk(spark, d):
    return rounded(calibration.coverage_risk(scored(spark, d), LABELS))


@query("unknown_threshold", oracle("f7_scored", CURVE + "SELECT coalesce(min(CASE WHEN cov >= 0.1 AND risk <= 0.55 THEN t END), 1.0) AS unknown_threshold FROM k"))
def unknown_threshold(spark, d):
    return calibration.unknown_threshold(scored(spark, d), LABELS, target_error=0.55, min_coverage=0.1)


@query("selective_metrics", oracle("f7_scored", SCORED + """
SELECT round(sum(CASE WHEN truth <> 'UNKNOWN' THEN w * ((pb - CASE WHEN truth = 'BAD' THEN 1 ELSE 0 END) ^ 2 + (pg - CASE WHEN truth = 'GOOD' THEN 1 ELSE 0 END) ^ 2) END) / sum(CASE WHEN truth <> 'UNKNOWN' THEN w END), 6) AS brier,
       round(sum(CASE WHEN truth <> 'UNKNOWN' THEN -w * ln(CASE WHEN truth = 'BAD' THEN pb ELSE pg END) END) / sum(CASE WHEN truth <> 'UNKNOWN' THEN w END), 6) AS log_loss, round(sum(CASE WHEN truth <> 'UNKNOWN' THEN w * ok END) / sum(CASE WHEN truth <> 'UNKNOWN' THEN w END), 6) AS accuracy,
       round(sum(CASE WHEN conf >= 0.7 THEN w ELSE 0 END) / sum(w), 6) AS coverage, round(sum(CASE WHEN conf >= 0.7 THEN w * (1 - ok) END) / sum(CASE WHEN conf >= 0.7 THEN w END), 6) AS selective_risk,
       round(sum(CASE WHEN truth <> 'UNKNOWN' AND conf >= 0.7 THEN w ELSE 0 END) / sum(CASE WHEN truth <> 'UNKNOWN' THEN w END), 6) AS known_coverage, round(sum(CASE WHEN truth = 'UNKNOWN' AND conf < 0.7 THEN w ELSE 0 END) / sum(CASE WHEN truth = 'UNKNOWN' THEN w END), 6) AS unknown_rejection_rate FROM c"""))
def selective_metrics(spark, d):
    return rounded(calibration.selective_metrics(scored(spark, d), LABELS, 0.7))


@query("per_class_metrics", oracle("f7_scored", SCORED + """
, l AS (SELECT unnest(['BAD', 'GOOD']) AS label), g AS (SELECT label, sum(CASE WHEN truth = label AND said = label THEN w ELSE 0 END) AS tp, sum(CASE WHEN said = label THEN w ELSE 0 END) AS p, sum(CASE WHEN truth = label THEN w ELSE 0 END) AS s FROM l, c WHERE truth <> 'UNKNOWN' GROUP BY label)
SELECT label, round(tp / p, 6) AS precision, round(tp / s, 6) AS recall, round(2 * (tp / p) * (tp / s) / (tp / p + tp / s), 6) AS f1, round(s, 6) AS weighted_support FROM g"""))
def per_class_metrics(spark, d):
    return rounded(calibration.per_class(scored(spark, d), LABELS))


APS = SCORED + ", a AS (SELECT row_id, CASE truth WHEN 'BAD' THEN CASE WHEN pg >= pb THEN pb + pg ELSE pb END WHEN 'GOOD' THEN CASE WHEN pb >= pg THEN pb + pg ELSE pg END END AS s FROM c), q AS (SELECT round(s, 9) AS s, row_number() OVER (ORDER BY s) - 1 AS i, count(*) OVER () AS n FROM a WHERE s IS NOT NULL) "


@query("aps_quantile", oracle("f7_scored", APS + "SELECT s AS aps_q FROM q WHERE i = least(n - 1, CAST(ceil((n + 1) * (1 - 0.4)) AS BIGINT) - 1)"))
def aps_quantile(spark, d):
    return rounded(calibration.aps_quantile(scored(spark, d), LABELS, alpha=0.4), 9)


@query("prediction_sets", oracle("f7_scored", SCORED + "SELECT row_id, CASE WHEN conf >= 0.65 THEN CASE WHEN pg >= pb THEN 'GOOD' ELSE 'BAD' END ELSE 'BAD,GOOD' END AS prediction_set FROM c"))
def prediction_sets(spark, d):
    return calibration.prediction_sets(scored(spark, d), LABELS, 0.65).select("row_id", F.array_join(F.array_sort("prediction_set"), ",").alias("prediction_set"))


@query("purged_walk_forward_folds", oracle("f3_fixed_segments", """
, d AS (SELECT e, ntile(5) OVER (ORDER BY e) - 1 AS block FROM (SELECT DISTINCT end_ts AS e FROM f3_fixed_segments)), r AS (SELECT segment_id, start_ts, end_ts, block FROM f3_fixed_segments JOIN d ON d.e = end_ts),
p AS (SELECT f.i AS fold, r.*, CASE WHEN block <= f.i THEN 'train' WHEN block = f.i + 1 THEN 'calibration' WHEN block = f.i + 2 THEN 'test' END AS role FROM r, range(3) f(i)),
m AS (SELECT fold, min(CASE WHEN role = 'calibration' THEN start_ts END) AS c, min(CASE WHEN role = 'test' THEN start_ts END) AS t FROM p GROUP BY fold),
k AS (SELECT p.fold, segment_id, role FROM p JOIN m USING (fold) WHERE role = 'test' OR role = 'train' AND end_ts < least(c, t) OR role = 'calibration' AND end_ts < t)
SELECT CAST(fold AS INT) AS fold, segment_id, role FROM k WHERE fold IN (SELECT fold FROM k WHERE role = 'train' GROUP BY fold HAVING count(*) >= 8)"""))
def purged_walk_forward_folds(spark, d):
    return calibration.purged_folds(load(spark, d, "f3_fixed_segments").withColumnsRenamed({"start_ts": "start", "end_ts": "end"}))


POOL = """
, p AS (SELECT s.segment_id, s.symbol, s.label, f.start_ts AS "start", CASE WHEN f.segment_no % 5 <> 0 THEN s.boundary_uncertainty END AS recognizability, 'I' || (f.segment_no % 4) AS industry FROM f4_states s JOIN f3_fixed_segments f USING (segment_id))
"""


def pool(spark, d):
    f = load(spark, d, "f3_fixed_segments").select("segment_id", "segment_no", F.col("start_ts").alias("start"))
    n = F.col("segment_no")
    return load(spark, d, "f4_states").join(f, "segment_id").select("segment_id", "symbol", "label", "start", F.when(n % 5 != 0, F.col("boundary_uncertainty")).alias("recognizability"), F.concat(F.lit("I"), (n % 4).cast("string")).alias("industry"))


@query("review_queue", oracle(("f4_states", "f3_fixed_segments"), POOL + """
SELECT segment_id, symbol, CASE WHEN label = 'UNKNOWN' THEN 'model_abstention' ELSE 'classified' END AS candidate_status, label AS predicted_label, recognizability,
       round(CASE WHEN label = 'UNKNOWN' THEN 10 ELSE 0 END + 1 - greatest(0, least(1, coalesce(recognizability, 0))) + 0.25, 6) AS review_priority FROM p ORDER BY review_priority DESC, segment_id LIMIT 100"""))
def review_queue(spark, d):
    out = review.review_queue(pool(spark, d), limit=100)
    return rounded(out.select("segment_id", "symbol", "candidate_status", "predicted_label", "recognizability", "review_priority"))


@query("review_feedback", oracle(("f4_states", "f3_fixed_segments"), POOL + """
, r AS (SELECT segment_id, CASE WHEN CAST(split_part(segment_id, ':', 2) AS INT) % 3 = 0 THEN ' fixed ' ELSE '' END AS t, CASE WHEN CAST(split_part(segment_id, ':', 2) AS INT) % 3 = 1 THEN 'Yes' ELSE 'no' END AS a FROM p WHERE CAST(split_part(segment_id, ':', 2) AS INT) % 2 = 0)
SELECT p.segment_id, coalesce(nullif(trim(r.t), ''), CASE WHEN lower(r.a) IN ('true', '1', 'yes', 'y', 'accepted') THEN p.label END) AS supervised_label FROM p LEFT JOIN r USING (segment_id)"""))
def review_feedback(spark, d):
    rows = pool(spark, d)
    n = F.split("segment_id", ":")[1].cast("int")
    marks = rows.where(n % 2 == 0).select("segment_id", F.when(n % 3 == 0, " fixed ").otherwise("").alias("true_label"), F.when(n % 3 == 1, "Yes").otherwise("no").alias("accepted"))
    return review.apply_reviews(rows, marks).select("segment_id", "supervised_label")


ALLOCATION = POOL + """
, st AS (SELECT *, CAST(year("start") AS VARCHAR) || '|' || label || '|' || industry AS stratum, label = 'UNKNOWN' AS unknown FROM p),
cp AS (SELECT stratum, unknown, count(*) AS capacity FROM st GROUP BY ALL), n AS (SELECT sum(capacity) FILTER (WHERE unknown) AS u, sum(capacity) FILTER (WHERE NOT unknown) AS k FROM cp),
n2 AS (SELECT *, least(60, u + k) AS total, least(u, round_even(least(60, u + k) * 0.35, 0)) AS f FROM n), n3 AS (SELECT *, least(k, total - f) AS kn FROM n2), n4 AS (SELECT kn AS want_k, least(u, f + greatest(0, total - f - kn)) AS want_u FROM n3),
rd AS (SELECT stratum, unknown, unnest(range(capacity)) AS rnd FROM cp), od AS (SELECT *, row_number() OVER (PARTITION BY unknown ORDER BY rnd, md5(stratum || '|42'), stratum) AS place FROM rd),
al AS (SELECT cp.stratum, cp.unknown, capacity, count(od.place) AS take FROM cp CROSS JOIN n4 LEFT JOIN od ON od.stratum = cp.stratum AND od.unknown = cp.unknown AND od.place <= CASE WHEN cp.unknown THEN want_u ELSE want_k END GROUP BY ALL)
"""


@query("stratified_allocation", oracle(("f4_states", "f3_fixed_segments"), ALLOCATION + "SELECT stratum AS sampling_stratum, unknown AS is_unknown, capacity, take FROM al"))
def stratified_allocation(spark, d):
    return review.allocation(pool(spark, d), 60)


@query("stratified_review_sample", oracle(("f4_states", "f3_fixed_segments"), ALLOCATION + """
, ch AS (SELECT st.*, al.take, al.capacity, row_number() OVER (PARTITION BY st.stratum ORDER BY md5(segment_id || '|42'), segment_id) AS r FROM st JOIN al USING (stratum))
SELECT segment_id, symbol, label AS predicted_label, stratum AS sampling_stratum, round(take / capacity, 6) AS sampling_probability, round(CASE WHEN unknown THEN 10 ELSE 0 END + 1 - greatest(0, least(1, coalesce(recognizability, 0))) + 0.25, 6) AS review_priority FROM ch WHERE r <= take"""))
def stratified_review_sample(spark, d):
    return rounded(review.stratified_sample(pool(spark, d), 60).select("segment_id", "symbol", "predicted_label", "sampling_stratum", "sampling_probability", "review_priority"))


@query("calibrated_classifier")
def calibrated_classifier(spark, d):
    """Fit on the first fold, calibrated and scored on later rows."""
    rows = load(spark, d, "f3_fixed_segments").withColumnsRenamed({"start_ts": "start", "end_ts": "end"})
    rows = rows.withColumns({"truth": F.col("label"), "f1": (F.col("segment_no") % 7).cast("double"), "f2": (F.col("label") == "CLUSTER_A").cast("double") + F.col("segment_no") % 3})
    folds = calibration.purged_folds(rows, splits=1)
    of = lambda role: rows.join(folds.where(F.col("role") == role).select("segment_id"), "segment_id")
    model = calibration.CalibratedClassifier(["f1", "f2"]).fit(of("train"), of("calibration"))
    model.choose_threshold(of("calibration"), target_error=0.3)
    return model.predict(of("test")).select("segment_id", "truth", "prob_CLUSTER_A", "prob_CLUSTER_B", "predicted_label")


@query("bulk_partition_audit", oracle(("f6_adjusted_source", "f6_master"), """
, x AS (SELECT ts_code, timestamp AS trade_date, CASE WHEN month(timestamp) = 5 THEN NULL ELSE adj_factor END AS adj_factor FROM f6_adjusted_source WHERE month(timestamp) <> 7 UNION ALL SELECT ts_code, timestamp, adj_factor FROM f6_adjusted_source WHERE month(timestamp) = 3),
g AS (SELECT trade_date, count(*) AS n, count(DISTINCT ts_code) AS k, avg(CASE WHEN adj_factor IS NULL THEN 0.0 ELSE 1.0 END) AS m FROM x GROUP BY ALL)
SELECT CAST(trade_date AS TIMESTAMP) AS trade_date, 'duplicate_keys' AS code FROM g WHERE n > k UNION ALL SELECT CAST(trade_date AS TIMESTAMP), 'factor_match' FROM g WHERE m < 0.999 UNION ALL SELECT CAST(trade_date AS TIMESTAMP), 'possibly_truncated' FROM g WHERE n >= 100
UNION ALL SELECT DISTINCT CAST(timestamp AS TIMESTAMP), 'missing_partition' FROM f6_adjusted_source WHERE month(timestamp) = 7
UNION ALL SELECT DISTINCT CAST(g.trade_date AS TIMESTAMP), 'universe_gap' FROM g JOIN f6_master m ON m.list_date <= CAST(g.trade_date AS DATE) AND (m.delist_date IS NULL OR m.delist_date >= CAST(g.trade_date AS DATE)) WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.trade_date = g.trade_date AND x.ts_code = m.ts_code)"""))
def bulk_partition_audit(spark, d):
    rows = load(spark, d, "f6_adjusted_source").select("ts_code", F.col("timestamp").alias("trade_date"), "adj_factor")
    m = F.month("trade_date")
    daily = rows.where(m != 7).withColumn("adj_factor", F.when(m != 5, F.col("adj_factor"))).unionByName(rows.where(m == 3))
    return audit.audit_partitions(daily, rows.select("trade_date").distinct(), load(spark, d, "f6_master"), row_limit=100)


@query("macro_metrics", oracle("f7_scored", SCORED + """
, l AS (SELECT unnest(['BAD', 'GOOD']) AS label), g AS (SELECT label, sum(CASE WHEN truth = label AND said = label THEN w ELSE 0 END) AS tp, sum(CASE WHEN said = label THEN w ELSE 0 END) AS p, sum(CASE WHEN truth = label THEN w ELSE 0 END) AS s FROM l, c WHERE truth <> 'UNKNOWN' GROUP BY label)
SELECT round(avg(2 * (tp / p) * (tp / s) / (tp / p + tp / s)), 6) AS macro_f1, round(avg(tp / s), 6) AS balanced_accuracy FROM g"""))
def macro_metrics(spark, d):
    return rounded(calibration.macro_metrics(scored(spark, d), LABELS))


@query("review_feedback_repeated", oracle(("f4_states", "f3_fixed_segments"), POOL + """
, n AS (SELECT segment_id, CAST(split_part(segment_id, ':', 2) AS INT) AS n FROM p), r AS (
 SELECT segment_id, 'first' AS t, 'no' AS a, TIMESTAMP '2024-01-01' AS w FROM n UNION ALL SELECT segment_id, '', 'yes', TIMESTAMP '2024-02-01' + INTERVAL (n) MINUTE FROM n WHERE n % 2 = 0
 UNION ALL SELECT segment_id, ' third', 'no', CAST(NULL AS TIMESTAMP) FROM n WHERE n % 6 = 0),
l AS (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY w IS NULL DESC, w DESC) AS k FROM r)
SELECT p.segment_id, coalesce(nullif(trim(l.t), ''), CASE WHEN l.a = 'yes' THEN p.label END) AS supervised_label FROM p LEFT JOIN l ON l.segment_id = p.segment_id AND l.k = 1"""))
def review_feedback_repeated(spark, d):
    """Up to three reviews a segment: the last counts, and one without a time is the last."""
    rows = pool(spark, d)
    n = F.split("segment_id", ":")[1].cast("int")
    at = lambda t, a, w: rows.select("segment_id", n.alias("n"), F.lit(t).alias("true_label"), F.lit(a).alias("accepted"), w.alias("reviewed_at"))
    marks = at("first", "no", F.lit("2024-01-01T00:00:00")).unionByName(at("", "yes", F.date_format(F.timestamp_seconds(F.lit(1706745600) + n * 60), "yyyy-MM-dd'T'HH:mm:ss")).where("n % 2 = 0")).unionByName(at(" third", "no", F.lit(None).cast("string")).where("n % 6 = 0"))
    return review.apply_reviews(rows, marks.drop("n")).select("segment_id", "supervised_label")


@query("features_with_consensus", oracle("f7_annotations", """
, c AS (SELECT segment_id, CAST(label AS VARCHAR) AS label, count(*) AS n, max(1 / sampling_probability) AS w FROM f7_annotations GROUP BY ALL), g AS (SELECT segment_id, sum(n) AS raters, count(*) AS k, max(label) AS label, max(w) AS w FROM c GROUP BY segment_id)
SELECT CAST(d.doc_id AS VARCHAR) AS segment_id, CAST(d.n_chars AS BIGINT) AS n_chars, g.label AS truth, round(g.w, 6) AS weight FROM documents d JOIN g ON g.segment_id = CAST(d.doc_id AS VARCHAR) WHERE k = 1 AND raters >= 2"""))
def features_with_consensus(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("segment_id"), F.col("n_chars").cast("long").alias("n_chars"))
    return rounded(agreement.with_consensus(rows, agreement.consensus(votes(spark, d))).select("segment_id", "n_chars", "truth", "weight"))


@query("daily_build_audit", oracle(("f6_adjusted_source", "f6_master"), """
, x AS (SELECT ts_code, timestamp AS t, CASE WHEN month(timestamp) = 5 THEN NULL ELSE adj_factor END AS f FROM f6_adjusted_source WHERE month(timestamp) <> 7 UNION ALL SELECT ts_code, timestamp, adj_factor FROM f6_adjusted_source WHERE month(timestamp) = 3),
dd AS (SELECT DISTINCT timestamp AS t FROM f6_adjusted_source), en AS (SELECT t, CASE WHEN month(t) = 9 THEN 'incomplete' ELSE 'complete' END AS status, CASE WHEN month(t) = 2 THEN 1 ELSE (SELECT count(*) FROM x WHERE x.t = dd.t) END AS told FROM dd WHERE month(t) <> 11),
g AS (SELECT t, count(*) AS n, count(f) AS m, count(*) - count(DISTINCT ts_code) AS dup FROM x GROUP BY t), j AS (SELECT dd.t, en.status, en.told, en.t IS NOT NULL AS known, g.n, g.m, g.dup FROM dd LEFT JOIN en USING (t) LEFT JOIN g USING (t)),
ac AS (SELECT dd.t, count(*) AS active FROM dd JOIN f6_master m ON m.list_date <= CAST(dd.t AS DATE) AND (m.delist_date IS NULL OR m.delist_date >= CAST(dd.t AS DATE)) GROUP BY dd.t),
i AS (SELECT t, 'missing_manifest_date' AS code FROM j WHERE NOT known UNION ALL SELECT t, 'partition_not_complete' FROM j WHERE known AND status <> 'complete' UNION ALL SELECT t, 'partition_file_missing' FROM j WHERE known AND n IS NULL
 UNION ALL SELECT t, 'manifest_row_count_mismatch' FROM j WHERE known AND n <> told UNION ALL SELECT t, 'duplicate_security_date_keys' FROM j WHERE known AND dup > 0 UNION ALL SELECT t, 'low_adj_factor_match' FROM j WHERE known AND m / CAST(n AS DOUBLE) < 0.999
 UNION ALL SELECT j.t, 'low_universe_coverage' FROM j LEFT JOIN ac USING (t) WHERE known AND n IS NOT NULL AND (active IS NULL OR n / CAST(active AS DOUBLE) < 0.8)
 UNION ALL SELECT t, 'required_endpoint_not_ok' FROM en WHERE month(t) IN (4, 8) UNION ALL SELECT t, 'suspected_truncation' FROM en WHERE month(t) = 10)
SELECT CAST(t AS TIMESTAMP) AS trade_date, code FROM i"""))
def daily_build_audit(spark, d):
    """Issues of a build by days with planted faults."""
    return _daily(spark, d)["issues"].select("trade_date", "code")


def _daily(spark, d):
    rows = load(spark, d, "f6_adjusted_source").select("ts_code", F.col("timestamp").alias("trade_date"), "adj_factor")
    m = F.month("trade_date")
    daily = rows.where(m != 7).withColumn("adj_factor", F.when(m != 5, F.col("adj_factor"))).unionByName(rows.where(m == 3))
    days = rows.select("trade_date").distinct()
    n = daily.groupBy("trade_date").agg(F.count(F.lit(1)).alias("n"))
    entries = days.where(m != 11).join(n, "trade_date", "left").select("trade_date", F.when(m == 9, "incomplete").otherwise("complete").alias("status"), F.when(m == 2, 1).otherwise(F.coalesce("n", F.lit(0))).alias("rows"))
    ends = entries.select("trade_date", F.explode(F.array(*[F.lit(e) for e in ("daily", "adj_factor", "stk_limit")])).alias("endpoint"))
    ends = ends.where((m != 4) | (F.col("endpoint") != "daily")).select("trade_date", "endpoint", F.when((m == 8) & (F.col("endpoint") == "adj_factor"), "failed").otherwise("ok").alias("status"), ((m == 10) & (F.col("endpoint") == "stk_limit")).alias("truncated"))
    return audit.audit_daily(daily, entries, ends, days, load(spark, d, "f6_master"), least_coverage=0.8)


@query("daily_build_summary", oracle(("f6_adjusted_source", "f6_master"), """
, x AS (SELECT ts_code, timestamp AS t, CASE WHEN month(timestamp) = 5 THEN NULL ELSE adj_factor END AS f FROM f6_adjusted_source WHERE month(timestamp) <> 7 UNION ALL SELECT ts_code, timestamp, adj_factor FROM f6_adjusted_source WHERE month(timestamp) = 3),
dd AS (SELECT DISTINCT timestamp AS t FROM f6_adjusted_source), g AS (SELECT t, count(*) AS n, count(f) AS m FROM x GROUP BY t),
ac AS (SELECT dd.t, count(*) AS active FROM dd JOIN f6_master m ON m.list_date <= CAST(dd.t AS DATE) AND (m.delist_date IS NULL OR m.delist_date >= CAST(dd.t AS DATE)) GROUP BY dd.t),
c AS (SELECT dd.t, n, m, n / CAST(active AS DOUBLE) AS cov FROM dd LEFT JOIN g USING (t) LEFT JOIN ac USING (t))
SELECT count(*) AS expected_dates, count(*) FILTER (WHERE n IS NOT NULL AND month(t) NOT IN (9, 11)) AS completed_partitions, CAST(sum(n) FILTER (WHERE month(t) <> 11) AS BIGINT) AS rows, round(sum(m) / sum(n), 6) AS adj_factor_match_rate, round(min(cov), 6) AS coverage_min, round(quantile_cont(cov, 0.01), 6) AS coverage_p01,
 round(quantile_cont(cov, 0.05), 6) AS coverage_p05, round(quantile_cont(cov, 0.5), 6) AS coverage_median, round(quantile_cont(cov, 0.95), 6) AS coverage_p95, round(max(cov), 6) AS coverage_max, count(*) FILTER (WHERE cov < 0.9) AS dates_below_90pct FROM c"""))
def daily_build_summary(spark, d):
    return rounded(_daily(spark, d)["summary"].drop("issue_count", "passed"))
