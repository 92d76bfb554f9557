"""Queries over segments: detection, features, boundaries, labels, sequences."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import BASELINE_GATES, GateConfig, SegmentationConfig
from ..operators import audit, discovery, features, labels, segments
from ..sources.fixtures import load, oracle
from .bars_queries import TR, rounded

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def fixed(spark, d):
    """Fixed segments of the event bars, with the library's names for their times."""
    return load(spark, d, "f3_fixed_segments").withColumnsRenamed({"start_ts": "start", "end_ts": "end"})


def states(spark, d):
    return load(spark, d, "f4_states")


# --- detection ------------------------------------------------------------------------------------------------------

ZIGZAG = TR + """
, z AS (
  SELECT symbol, idx, atr, 0 AS leg, 0 AS far, (SELECT close FROM t WHERE t.symbol = a.symbol AND t.idx = 0) AS best, CAST(NULL AS INT) AS turned, CAST(NULL AS DOUBLE) AS p FROM a WHERE idx = 0
  UNION ALL
  SELECT symbol, idx, atr,
         CASE WHEN up THEN 1 WHEN down THEN -1 WHEN turn THEN -leg ELSE leg END, CASE WHEN up OR down OR ext OR turn THEN idx ELSE far END,
         CASE WHEN up OR ext AND leg = 1 OR turn AND leg = -1 THEN high WHEN down OR ext AND leg = -1 OR turn AND leg = 1 THEN low ELSE best END,
         CASE WHEN turn THEN far END, CASE WHEN turn THEN least(0.96, greatest(0.42, 0.42 + 0.18 * least(back / lim, 3))) END
  FROM (SELECT *, leg <> 0 AND NOT ext AND back >= lim AS turn FROM
        (SELECT *, leg = 0 AND high - best >= lim AND high - best >= best - low AS up, leg = 0 AND NOT (high - best >= lim AND high - best >= best - low) AND best - low >= lim AS down,
                leg = 1 AND high >= best OR leg = -1 AND low <= best AS ext, (best - close) * leg AS back FROM
         (SELECT t.symbol, t.idx, a.atr, t.high, t.low, t.close, z.leg, z.far, z.best, greatest(a.atr * 2.2, abs(t.close) * CAST(1e-6 AS DOUBLE)) AS lim
          FROM z JOIN t ON t.symbol = z.symbol AND t.idx = z.idx + 1 JOIN a ON a.symbol = t.symbol AND a.idx = t.idx))))
, pivots AS (SELECT symbol, 0 AS idx, CAST(1 AS DOUBLE) AS p, 0 AS conf FROM a WHERE idx = 0 AND EXISTS (SELECT 1 FROM a b WHERE b.symbol = a.symbol AND b.idx = 1) UNION ALL SELECT symbol, turned, p, idx FROM z WHERE turned IS NOT NULL)
, legs AS (SELECT symbol, row_number() OVER w - 1 AS no, idx AS a, lead(idx) OVER w AS b, p AS pa, lead(p) OVER w AS pb, conf AS ca, lead(conf) OVER w AS cb FROM pivots WINDOW w AS (PARTITION BY symbol ORDER BY conf))
"""


@query(
    "causal_zigzag_segments",
    oracle("f1_event_bars", ZIGZAG + """
SELECT l.symbol || ':' || l.no AS segment_id, l.symbol, CAST(l.no AS INT) AS segment_no, CAST(l.a AS INT) AS start_idx, CAST(l.b AS INT) AS end_idx, round(pa, 6) AS start_boundary_probability, round(pb, 6) AS end_boundary_probability,
       CAST(l.b - l.a + 1 AS INT) AS n_bars, CAST(cb AS INT) AS confirmation_idx, c.timestamp AS available_at
FROM legs l JOIN t c ON c.symbol = l.symbol AND c.idx = l.cb WHERE l.b - l.a >= 4""", recursive=True),
)
def causal_zigzag_segments(spark, d):
    out = segments.segment_causal(load(spark, d, "f1_event_bars"))
    return rounded(out.select("segment_id", "symbol", "segment_no", "start_idx", "end_idx", "start_boundary_probability", "end_boundary_probability", "n_bars", "confirmation_idx", "available_at"))


@query(
    "direction_transitions",
    oracle("f1_event_bars", ZIGZAG + """
, s AS (SELECT l.symbol, l.a, CASE WHEN y.close / x.close - 1 > 0.002 THEN 'up' WHEN y.close / x.close - 1 < -0.002 THEN 'down' ELSE 'flat' END AS d FROM legs l JOIN t x ON x.symbol = l.symbol AND x.idx = l.a JOIN t y ON y.symbol = l.symbol AND y.idx = l.b WHERE l.b - l.a >= 4)
, n AS (SELECT d AS f, lead(d) OVER (PARTITION BY symbol ORDER BY a) AS g FROM s), q AS (SELECT f, g, count(*) AS n FROM n WHERE g IS NOT NULL GROUP BY ALL), l2 AS (SELECT f AS x FROM q UNION SELECT g FROM q)
SELECT p.x AS from_label, r.x AS to_label, coalesce(q.n, 0) AS n, round(coalesce(coalesce(q.n, 0) / nullif(sum(coalesce(q.n, 0)) OVER (PARTITION BY p.x), 0), 0.0), 6) AS probability FROM l2 p CROSS JOIN l2 r LEFT JOIN q ON q.f = p.x AND q.g = r.x""", recursive=True),
)
def direction_transitions(spark, d):
    bars = load(spark, d, "f1_event_bars")
    segs = segments.segment_causal(bars)
    rows = segs.join(features.segment_features(segs, bars).select("segment_id", "direction"), "segment_id")
    return rounded(labels.transitions(rows, label="direction"))


@query("zigzag_segments")
def zigzag_segments(spark, d):
    return segments.segment_bars(load(spark, d, "f1_event_bars"))


@query("fused_segments")
def fused_segments(spark, d):
    return segments.segment_bars(load(spark, d, "f1_event_bars"), change_points=True)


@query("bootstrap_stability")
def bootstrap_stability(spark, d):
    bars = load(spark, d, "f1_event_bars")
    stable = segments.bootstrap_stability(bars, iterations=100)
    return segments.fold_in_stability(segments.segment_bars(bars), stable)


@query("bootstrap_stability_causal")
def bootstrap_stability_causal(spark, d):
    bars = load(spark, d, "f1_event_bars")
    return segments.fold_in_stability(segments.segment_causal(bars), segments.bootstrap_stability(bars, iterations=100, causal=True), default=0.0)


def _second(sql: str) -> str:
    """The pivots and legs of ZIGZAG at the other multiple, under other names."""
    body = re.sub(r"\b(z|pivots|legs)\b", r"\g<1>2", sql[len(TR):])
    return body.replace("a.atr * 2.2", "a.atr * 1.8")


AGREEMENT = ZIGZAG + _second(ZIGZAG) + """
, e1 AS (SELECT symbol, a AS i FROM legs WHERE b - a >= 4 UNION SELECT symbol, b FROM legs WHERE b - a >= 4), b1 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY i) AS k FROM e1),
e2 AS (SELECT symbol, a AS i FROM legs2 WHERE b - a >= 4 UNION SELECT symbol, b FROM legs2 WHERE b - a >= 4), b2 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY i) AS k FROM e2),
o AS (SELECT 0 AS side, x.symbol, x.i, {slice} AS s FROM b1 x JOIN t ON t.symbol = x.symbol AND t.idx = x.i WHERE k > 1 UNION ALL SELECT 1, x.symbol, x.i, {slice} FROM b2 x JOIN t ON t.symbol = x.symbol AND t.idx = x.i WHERE k > 1),
ls AS (SELECT symbol, s, coalesce(list(i ORDER BY i) FILTER (WHERE side = 0), []) AS p, coalesce(list(i ORDER BY i) FILTER (WHERE side = 1), []) AS r FROM o GROUP BY ALL),
mt AS (SELECT symbol, s, 1 AS x, 1 AS y, 0 AS n FROM ls UNION ALL
  SELECT mt.symbol, mt.s, CASE WHEN p[x] - r[y] <= 3 THEN x + 1 ELSE x END, CASE WHEN r[y] - p[x] <= 3 THEN y + 1 ELSE y END, n + CASE WHEN abs(p[x] - r[y]) <= 3 THEN 1 ELSE 0 END
  FROM mt JOIN ls ON ls.symbol = mt.symbol AND ls.s = mt.s WHERE x <= len(p) AND y <= len(r)),
ct AS (SELECT ls.symbol, ls.s, max(n) AS matched, any_value(len(p)) AS predicted, any_value(len(r)) AS reference FROM mt JOIN ls ON ls.symbol = mt.symbol AND ls.s = mt.s GROUP BY ALL)
"""
AGREED = "round(2 * (m / p) * (m / r) / nullif(m / p + m / r, 0), 6)"


@query(
    "boundary_agreement",
    oracle("f1_event_bars", AGREEMENT.replace("{slice}", "0") + """
SELECT symbol, CAST(matched AS BIGINT) AS matched, CAST(predicted AS BIGINT) AS predicted, CAST(reference AS BIGINT) AS reference, round(matched / nullif(predicted, 0), 6) AS precision, round(matched / nullif(reference, 0), 6) AS recall,
       coalesce(round(2 * (matched / nullif(predicted, 0)) * (matched / nullif(reference, 0)) / nullif(matched / nullif(predicted, 0) + matched / nullif(reference, 0), 0), 6), 0) AS f1 FROM ct""", recursive=True),
)
def boundary_agreement(spark, d):
    a, b = (segments.causal_boundaries(x) for x in _two(spark, d))
    return rounded(segments.precision_recall(segments.boundary_matches(a, b), ("symbol",)))


def _two(spark, d):
    bars = load(spark, d, "f1_event_bars")
    return [segments.segment_causal(bars, SegmentationConfig(atr_reversal=x)) for x in (2.2, 1.8)]


COMPARED = """coalesce(round(sum(matched) / nullif(sum(predicted), 0), 6), 0) AS precision_vs_reference, coalesce(round(sum(matched) / nullif(sum(reference), 0), 6), 0) AS recall_vs_reference,
 coalesce(round(2 * (sum(matched) / nullif(sum(predicted), 0)) * (sum(matched) / nullif(sum(reference), 0)) / nullif(sum(matched) / nullif(sum(predicted), 0) + sum(matched) / nullif(sum(reference), 0), 0), 6), 0) AS f1_agreement,
 CAST(sum(matched) AS BIGINT) AS matches, CAST(sum(predicted) AS BIGINT) AS observed_boundaries, CAST(sum(reference) AS BIGINT) AS reference_boundaries"""


@query("boundary_agreement_overall", oracle("f1_event_bars", AGREEMENT.replace("{slice}", "0") + f"SELECT {COMPARED}, 3 AS tolerance_bars FROM ct", recursive=True))
def boundary_agreement_overall(spark, d):
    a, b = _two(spark, d)
    return rounded(segments.compare_boundaries(b, a)["overall"])


@query("boundary_agreement_years", oracle("f1_event_bars", AGREEMENT.replace("{slice}", "CAST(year(t.timestamp) AS INT)") + f"SELECT symbol, s AS year, {COMPARED} FROM ct GROUP BY symbol, s", recursive=True))
def boundary_agreement_years(spark, d):
    a, b = _two(spark, d)
    return rounded(segments.compare_boundaries(b, a)["year"])


# --- features -------------------------------------------------------------------------------------------------------

FEATURE_SQL = TR + """
, m AS (SELECT s.segment_id, t.*, a.atr FROM f3_fixed_segments s JOIN t ON t.symbol = s.symbol AND t.idx BETWEEN s.start_idx AND s.end_idx JOIN a ON a.symbol = t.symbol AND a.idx = t.idx)
, q AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS ret, close / max(close) OVER (PARTITION BY segment_id ORDER BY idx) - 1 AS fall, volume / nullif(lag(volume) OVER w, 0) - 1 AS vc,
        coalesce(lag(volume) OVER w = 0 AND volume > 0, false) AS broken, coalesce(close > lag(close) OVER w, false) AS rise, abs(open / nullif(lag(close) OVER w, 0) - 1) AS gap, nullif(high - low, 0) AS span FROM m WINDOW w AS (PARTITION BY segment_id ORDER BY idx))
, g AS (SELECT segment_id, arg_max(close, idx) / arg_min(close, idx) - 1 AS r, count(*) AS n, coalesce(regr_slope(ln(greatest(close, 1e-12)), idx), 0) AS slope, max(high) / min(low) - 1 AS amp, min(fall) AS dd, stddev_pop(ret) AS vol, avg(atr) AS am, avg(atr / close) AS ap,
        avg(volume) AS vm, median(volume) AS vd, stddev_pop(volume) / nullif(avg(volume), 0) AS vcv, coalesce(regr_slope(ln(1 + greatest(volume, 0)), idx), 0) AS vt,
        CASE WHEN count(CASE WHEN ret IS NOT NULL AND vc IS NOT NULL THEN 1 END) >= 3 AND NOT bool_or(broken) THEN
          covar_pop(CASE WHEN vc IS NOT NULL THEN ret END, CASE WHEN ret IS NOT NULL THEN vc END) / nullif(stddev_pop(CASE WHEN vc IS NOT NULL THEN ret END) * stddev_pop(CASE WHEN ret IS NOT NULL THEN vc END), 0) END AS pvc,
        sum(CASE WHEN rise THEN volume ELSE 0 END) / nullif(sum(volume), 0) AS uv, avg(abs(close - open) / span) AS body, avg((high - greatest(open, close)) / span) AS us, avg((least(open, close) - low) / span) AS ls,
        avg(CASE WHEN abs(close - open) / span < 0.1 THEN 1.0 ELSE 0.0 END) AS doji, avg(CASE WHEN close > open THEN 1.0 ELSE 0.0 END) AS bull, avg(gap) AS gap, avg((high - low) / close) AS rr, datediff('second', min(timestamp), max(timestamp)) // 86400 AS days FROM q GROUP BY segment_id)
SELECT segment_id, CASE WHEN r > 0.002 THEN 'up' WHEN r < -0.002 THEN 'down' ELSE 'flat' END AS direction, round(r, 6) AS cumulative_return, round(slope, 6) AS log_price_slope, round(amp, 6) AS amplitude, round(dd, 6) AS max_drawdown, n AS duration_bars,
       days AS duration_days, round(vol, 6) AS return_volatility, round(am, 3) AS atr_mean, round(ap, 6) AS atr_pct_mean, round(vm, 6) AS volume_mean, round(vd, 6) AS volume_median, round(vcv, 6) AS volume_cv, round(vt, 6) AS volume_trend, round(pvc, 6) AS price_volume_corr,
       round(uv, 6) AS up_volume_ratio, round(body, 6) AS body_ratio_mean, round(us, 6) AS upper_shadow_ratio_mean, round(ls, 6) AS lower_shadow_ratio_mean, round(doji, 6) AS doji_ratio, round(bull, 6) AS bullish_candle_ratio, round(gap, 6) AS gap_ratio, round(rr, 6) AS realized_range_mean FROM g"""


@query("segment_features", oracle(("f1_event_bars", "f3_fixed_segments"), FEATURE_SQL, recursive=True))
def segment_features(spark, d):
    out = features.segment_features(fixed(spark, d), load(spark, d, "f1_event_bars"))
    return rounded(out.withColumn("atr_mean", F.round("atr_mean", 3)))


@query(
    "segment_context_features",
    oracle(("f1_event_bars", "f3_fixed_segments"), """
, b AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY timestamp) - 1 AS INT) AS idx FROM f1_event_bars)
, m AS (SELECT s.segment_id, b.idx, CASE WHEN b.idx % 3 <> 0 THEN b.close / 1000 END AS x, CASE WHEN b.idx % 4 <> 1 THEN 'R' || CAST(b.idx % 5 AS STRING) END AS c FROM f3_fixed_segments s JOIN b ON b.symbol = s.symbol AND b.idx BETWEEN s.start_idx AND s.end_idx)
SELECT segment_id, round(avg(x), 6) AS market_level_mean, round(arg_max_null(x, idx), 6) AS market_level_end, arg_max(c, idx) AS sector_regime_end FROM m GROUP BY segment_id"""),
)
def segment_context_features(spark, d):
    from ..operators.bars import numbered

    i = F.col("idx")
    bars = numbered(load(spark, d, "f1_event_bars")).withColumns({"market_level": F.when(i % 3 != 0, F.col("close") / 1000), "sector_regime": F.when(i % 4 != 1, F.concat(F.lit("R"), (i % 5).cast("string")))}).drop("idx")
    return rounded(features.segment_features(fixed(spark, d), bars).select("segment_id", "market_level_mean", "market_level_end", "sector_regime_end"))


# --- boundaries -----------------------------------------------------------------------------------------------------


@query(
    "boundary_table",
    oracle("f3_fixed_segments", """
, e AS (SELECT symbol, start_idx AS b FROM f3_fixed_segments UNION SELECT symbol, end_idx FROM f3_fixed_segments), x AS (SELECT *, b = min(b) OVER w OR b = max(b) OVER w AS is_edge FROM e WINDOW w AS (PARTITION BY symbol))
SELECT symbol, b AS boundary_idx, is_edge FROM x"""),
)
def boundary_table(spark, d):
    return segments.boundary_table(fixed(spark, d), edges=True)


@query(
    "segment_distribution",
    oracle("f3_fixed_segments", """
SELECT symbol, count(*) AS segments, median(CAST(n_bars AS DOUBLE)) AS median_bars, round(quantile_cont(CAST(n_bars AS DOUBLE), 0.1), 6) AS p10_bars, round(quantile_cont(CAST(n_bars AS DOUBLE), 0.9), 6) AS p90_bars, round(avg(CASE WHEN n_bars < 10 THEN 1.0 ELSE 0.0 END), 6) AS short_share
FROM f3_fixed_segments GROUP BY symbol"""),
)
def segment_distribution(spark, d):
    return rounded(segments.segment_distribution(fixed(spark, d), by=("symbol",)))


@query(
    "causal_boundaries",
    oracle("f3_fixed_segments", """
, e AS (SELECT symbol, start_idx AS b, start_ts AS "at" FROM f3_fixed_segments UNION SELECT symbol, end_idx, end_ts FROM f3_fixed_segments), x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY b) AS n FROM e)
SELECT symbol, b AS boundary_idx, "at", CAST(year("at") AS INT) AS year FROM x WHERE n > 1"""),
)
def causal_boundaries(spark, d):
    return segments.causal_boundaries(fixed(spark, d))


# --- labels ---------------------------------------------------------------------------------------------------------


@query(
    "merge_same_label",
    oracle("f4_states", """
, o AS (SELECT *, CASE WHEN label <> 'UNKNOWN' AND label = lag(label) OVER w AND start_idx <= lag(end_idx) OVER w + 1 THEN 0 ELSE 1 END AS fresh FROM f4_states WINDOW w AS (PARTITION BY symbol ORDER BY start_idx, end_idx, segment_id)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY start_idx, end_idx, segment_id) AS run FROM o),
g AS (SELECT symbol, run, min(start_idx) AS a, max(end_idx) AS b, arg_min(label, start_idx) AS label, count(*) AS k, string_agg(segment_id, ',' ORDER BY start_idx) AS ids, arg_min(segment_id, start_idx) AS first_id,
      sum(prob_CLUSTER_A * n_bars) / sum(n_bars) AS pa, sum(prob_CLUSTER_B * n_bars) / sum(n_bars) AS pb FROM r GROUP BY ALL)
SELECT CASE WHEN k = 1 THEN first_id ELSE symbol || ':merged:' || a || ':' || b END AS segment_id, symbol, label, a AS start_idx, b AS end_idx, CAST(b - a + 1 AS INT) AS n_bars, ids AS segment_ids, round(pa / (pa + pb), 6) AS "prob_CLUSTER_A", round(pb / (pa + pb), 6) AS "prob_CLUSTER_B" FROM g"""),
)
def merge_same_label(spark, d):
    out = labels.merge_runs(states(spark, d))
    return rounded(out.select("segment_id", "symbol", "label", "start_idx", "end_idx", "n_bars", F.array_join("segment_ids", ",").alias("segment_ids"), "prob_CLUSTER_A", "prob_CLUSTER_B"))


TRANSITION_SQL = """
, n AS (SELECT label AS f, lead(label) OVER (PARTITION BY symbol ORDER BY start_idx, end_idx, segment_id) AS g FROM f4_states {where}), q AS (SELECT f, g, count(*) AS n FROM n WHERE g IS NOT NULL GROUP BY ALL), l AS (SELECT f AS x FROM q UNION SELECT g FROM q)
SELECT p.x AS from_label, r.x AS to_label, coalesce(q.n, 0) AS n, round(coalesce(coalesce(q.n, 0) / nullif(sum(coalesce(q.n, 0)) OVER (PARTITION BY p.x), 0), 0.0), 6) AS probability FROM l p CROSS JOIN l r LEFT JOIN q ON q.f = p.x AND q.g = r.x"""


@query("transition_matrix", oracle("f4_states", TRANSITION_SQL.format(where="")))
def transition_matrix(spark, d):
    return rounded(labels.transitions(states(spark, d)))


@query("transition_matrix_known", oracle("f4_states", TRANSITION_SQL.format(where="WHERE label <> 'UNKNOWN'")))
def transition_matrix_known(spark, d):
    return rounded(labels.transitions(states(spark, d), drop_unknown=True))


@query(
    "label_descriptions",
    oracle("f4_states", """
, u AS (SELECT label, unnest(['n_bars', 'boundary_uncertainty']) AS feature, unnest([CAST(n_bars AS DOUBLE), boundary_uncertainty]) AS x FROM f4_states)
SELECT label, feature, count(x) AS n, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max, count(*) AS segments, round(count(*) / (SELECT count(*) FROM f4_states), 6) AS share FROM u GROUP BY ALL"""),
)
def label_descriptions(spark, d):
    return rounded(labels.describe_labels(states(spark, d), ["n_bars", "boundary_uncertainty"]))


@query(
    "structure_summary",
    oracle("f4_states", """
, w AS (SELECT *, lag(label) OVER o AS pl, lag(end_idx) OVER o AS pe FROM f4_states WINDOW o AS (PARTITION BY model_version, symbol ORDER BY start_idx, end_idx)),
x AS (SELECT *, coalesce(start_idx <= pe + 1 AND label <> 'UNKNOWN' AND pl <> 'UNKNOWN', false) AS adj FROM w), y AS (SELECT *, adj AND pl = label AS same FROM x),
r AS (SELECT model_version, symbol, start_idx, end_idx, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY model_version, symbol ORDER BY start_idx, end_idx) AS run FROM y WHERE label <> 'UNKNOWN'),
b AS (SELECT model_version, symbol, run, CAST(max(end_idx) - min(start_idx) + 1 AS DOUBLE) AS n FROM r GROUP BY ALL), c AS (SELECT model_version, count(*) AS runs, median(n) AS median_run_bars FROM b GROUP BY ALL)
SELECT model_version, count(*) AS segments, round(avg(CASE WHEN label = 'UNKNOWN' THEN 1.0 ELSE 0.0 END), 6) AS unknown_fraction, count(DISTINCT symbol) AS symbols, median(CASE WHEN label <> 'UNKNOWN' THEN CAST(n_bars AS DOUBLE) END) AS median_bars,
       round(quantile_cont(CASE WHEN label <> 'UNKNOWN' THEN CAST(n_bars AS DOUBLE) END, 0.9), 6) AS p90_bars, count(*) FILTER (WHERE adj) AS adjacent_pairs, count(*) FILTER (WHERE same) AS same_pairs,
       round(count(*) FILTER (WHERE same) / nullif(count(*) FILTER (WHERE adj), 0), 6) AS self_transition_rate, any_value(runs) AS runs, any_value(median_run_bars) AS median_run_bars FROM y JOIN c USING (model_version) GROUP BY model_version"""),
)
def structure_summary(spark, d):
    return rounded(labels.structure_summary(states(spark, d)))


@query(
    "coverage_by_group",
    oracle("f4_states", """
SELECT model_version, symbol, count(*) AS segments, count(*) FILTER (WHERE label <> 'UNKNOWN') AS identified, count(*) FILTER (WHERE label = 'UNKNOWN') AS unknown,
       coalesce(string_agg(DISTINCT CASE WHEN label <> 'UNKNOWN' THEN label END, ',' ORDER BY CASE WHEN label <> 'UNKNOWN' THEN label END), '') AS fold_local_labels, round(count(*) FILTER (WHERE label <> 'UNKNOWN') / count(*), 6) AS coverage
FROM f4_states GROUP BY ALL"""),
)
def coverage_by_group(spark, d):
    return rounded(labels.coverage(states(spark, d), ["model_version", "symbol"]))


@query("label_counts", oracle("f4_states", "SELECT model_version, label, count(*) AS n FROM f4_states GROUP BY ALL"))
def label_counts(spark, d):
    return labels.label_counts(states(spark, d))


def _diagnosed(spark, d):
    a, b = F.col("prob_CLUSTER_A"), F.col("prob_CLUSTER_B")
    n = F.split("segment_id", ":")[1].cast("int")
    rows = states(spark, d).withColumns({"m1_A": a, "m1_B": b, "m2_A": 0.5 * a + 0.25, "m2_B": 0.5 * b + 0.25}).drop("prob_CLUSTER_A", "prob_CLUSTER_B", "label")
    rows = labels.ensemble_diagnostics(rows, [["m1_A", "m1_B"], ["m2_A", "m2_B"]], ["CLUSTER_A", "CLUSTER_B"])
    rows = rows.withColumns({"is_low_density": n % 10 == 0, "context_conflict": (n % 4) / F.lit(4.0), "mixture_converged": n % 29 != 0, "cluster_supported": n % 23 != 5, "hdbscan_noise": F.lit(None).cast("boolean")})
    return labels.recognizability(rows)


DIAGNOSED = """
, s AS (SELECT *, CAST(split_part(segment_id, ':', 2) AS INT) AS n, (prob_CLUSTER_A + (0.5 * prob_CLUSTER_A + 0.25)) / 2 AS pa, (prob_CLUSTER_B + (0.5 * prob_CLUSTER_B + 0.25)) / 2 AS pb FROM f4_states),
e AS (SELECT *, greatest(pa, pb) AS mp, -(pa * ln(pa) + pb * ln(pb)) / ln(2) AS h, (abs(prob_CLUSTER_A - (0.5 * prob_CLUSTER_A + 0.25)) / 2 + abs(prob_CLUSTER_B - (0.5 * prob_CLUSTER_B + 0.25)) / 2) / 2 AS dis, CASE WHEN pa >= pb THEN 'CLUSTER_A' ELSE 'CLUSTER_B' END AS cand FROM s),
r AS (SELECT *, greatest(0.0, least(1.0, 0.40 * mp + 0.25 * (1 - h) + 0.15 * (1 - least(dis / 0.25, 1)) + 0.10 * CASE WHEN n % 10 = 0 THEN 0 ELSE 1 END + 0.05 * (1 - boundary_uncertainty) + 0.05 * (1 - (n % 4) / 4.0))) AS rec FROM e)
"""


@query("recognizability", oracle("f4_states", DIAGNOSED + "SELECT segment_id, round(pa, 6) AS \"prob_CLUSTER_A\", round(mp, 6) AS max_probability, round(h, 6) AS posterior_entropy, round(dis, 6) AS model_disagreement, cand AS candidate_label, round(rec, 6) AS recognizability FROM r"))
def recognizability(spark, d):
    return rounded(_diagnosed(spark, d).select("segment_id", "prob_CLUSTER_A", "max_probability", "posterior_entropy", "model_disagreement", "candidate_label", "recognizability"))


def _gate_sql(first: str, consensus: float, apart: float, more: bool) -> str:
    extra = ", CASE WHEN n % 29 = 0 THEN 'mixture_nonconverged' END" if more else ""
    order = (f"CASE WHEN mp < {consensus} THEN '{first}' END", f"CASE WHEN dis > {apart} THEN 'model_disagreement' END{extra}", "CASE WHEN n % 10 = 0 THEN 'low_density' END", "CASE WHEN h > 0.78 THEN 'high_entropy' END")
    head = (order[0], order[1], order[2], order[3]) if more else (order[0], order[3], order[1], order[2])
    rest = "CASE WHEN boundary_uncertainty > 0.44 THEN 'boundary_unstable' END, CASE WHEN (n % 4) / 4.0 > 0.75 THEN 'context_conflict' END, CASE WHEN rec < 0.48 THEN 'low_recognizability' END, CASE WHEN n % 23 = 5 THEN 'insufficient_cluster_support' END"
    return DIAGNOSED + f", g AS (SELECT segment_id, cand, concat_ws(';', {', '.join(head)}, {rest}) AS reason FROM r) SELECT segment_id, reason AS unknown_reason, CASE WHEN reason = '' THEN cand ELSE 'UNKNOWN' END AS label, reason <> '' AS is_unknown, CASE WHEN reason = '' THEN 'classified' ELSE 'model_abstention' END AS candidate_status FROM g"


@query("abstention_gates", oracle("f4_states", _gate_sql("low_consensus", 0.5, 0.25, True)))
def abstention_gates(spark, d):
    return labels.apply_gates(_diagnosed(spark, d), labels.discovery_gates(GateConfig())).select("segment_id", "unknown_reason", "label", "is_unknown", "candidate_status")


@query("abstention_gates_baseline", oracle("f4_states", _gate_sql("low_posterior", 0.52, 0.22, False)))
def abstention_gates_baseline(spark, d):
    return labels.apply_gates(_diagnosed(spark, d), labels.baseline_gates(BASELINE_GATES)).select("segment_id", "unknown_reason", "label", "is_unknown", "candidate_status")


@query("unknown_reasons", oracle("f4_states", _gate_sql("low_consensus", 0.5, 0.25, True).replace("SELECT segment_id, reason AS unknown_reason", ", u AS (SELECT unnest(string_split(reason, ';')) AS reason, model_version FROM g JOIN f4_states USING (segment_id)) SELECT model_version, reason, count(*) AS n FROM u WHERE reason <> '' GROUP BY ALL --")))
def unknown_reasons(spark, d):
    return labels.unknown_reasons(labels.apply_gates(_diagnosed(spark, d), labels.discovery_gates(GateConfig())))


@query("total_variation", oracle("f4_states", """
SELECT segment_id, round(0.5 * (abs(prob_CLUSTER_A - pa / (pa + pb)) + abs(prob_CLUSTER_B - pb / (pa + pb))), 6) AS total_variation FROM (SELECT *, 0.9 * prob_CLUSTER_A + 0.05 AS pa, 0.7 * prob_CLUSTER_B + 0.1 AS pb FROM f4_states)"""))
def total_variation(spark, d):
    rows = states(spark, d).withColumns({"q_A": 0.9 * F.col("prob_CLUSTER_A") + 0.05, "q_B": 0.7 * F.col("prob_CLUSTER_B") + 0.1})
    return rounded(labels.total_variation(rows, ["prob_CLUSTER_A", "prob_CLUSTER_B"], ["q_A", "q_B"]).select("segment_id", "total_variation"))


@query("overlap_matrix", oracle("f4_states", """
, x AS (SELECT prob_CLUSTER_A AS a, prob_CLUSTER_B AS b, boundary_uncertainty AS c FROM f4_states)
SELECT 'prob_CLUSTER_A' AS left_label, 'boundary_uncertainty' AS right_label, round(sum(a * c) / sqrt(sum(a * a) * sum(c * c)), 6) AS overlap FROM x UNION ALL SELECT 'prob_CLUSTER_B', 'boundary_uncertainty', round(sum(b * c) / sqrt(sum(b * b) * sum(c * c)), 6) FROM x"""))
def overlap_matrix(spark, d):
    return rounded(labels.overlap_matrix(states(spark, d), ["prob_CLUSTER_A", "prob_CLUSTER_B"], ["boundary_uncertainty"]))


@query("cluster_support", oracle("f4_states", """
SELECT label AS candidate_label, count(*) >= 5 AND count(DISTINCT symbol) >= 2 AND count(DISTINCT year(available_at)) >= 1 AS cluster_supported FROM f4_states GROUP BY label"""))
def cluster_support(spark, d):
    return labels.cluster_support(states(spark, d).withColumnsRenamed({"label": "candidate_label", "available_at": "start"}))


@query(
    "dwell_filter",
    oracle("f4_states", """
, o AS (SELECT *, CASE WHEN prob_CLUSTER_A >= prob_CLUSTER_B THEN 'CLUSTER_A' ELSE 'CLUSTER_B' END AS top, row_number() OVER (PARTITION BY symbol ORDER BY start_idx, end_idx) AS i FROM f4_states),
r AS (SELECT symbol, i, segment_id, CASE WHEN label <> 'UNKNOWN' THEN top END AS cur, CASE WHEN label = 'UNKNOWN' THEN 0 ELSE n_bars END AS dwell FROM o WHERE i = 1
      UNION ALL SELECT o.symbol, o.i, o.segment_id, CASE WHEN o.label = 'UNKNOWN' THEN NULL WHEN r.cur IS NULL OR r.dwell >= 20 THEN o.top ELSE r.cur END,
      CASE WHEN o.label = 'UNKNOWN' THEN 0 WHEN (r.cur IS NULL OR r.dwell >= 20) AND (r.cur IS NULL OR o.top <> r.cur) THEN o.n_bars ELSE r.dwell + o.n_bars END FROM r JOIN o ON o.symbol = r.symbol AND o.i = r.i + 1)
SELECT segment_id, coalesce(cur, 'UNKNOWN') AS causal_duration_label FROM r""", recursive=True),
)
def dwell_filter(spark, d):
    return labels.dwell_filter(states(spark, d), 20).select("segment_id", "causal_duration_label")


@query("hsmm_decode")
def hsmm_decode(spark, d):
    return labels.decode_durations(states(spark, d)).select("segment_id", "hsmm_label", "hsmm_path_score", "hsmm_changed")


@query("hsmm_smooth_and_merge")
def hsmm_smooth_and_merge(spark, d):
    return labels.smooth_and_merge(states(spark, d)).select("segment_id", "symbol", "label", "start_idx", "end_idx", "n_bars", "merged_segments")


# --- discovery ------------------------------------------------------------------------------------------------------


def _causal_features(spark, d):
    bars = load(spark, d, "f1_event_bars")
    segs = segments.segment_causal(bars)
    return segs.join(features.segment_features(segs, bars), "segment_id")


@query("discovery_labels")
def discovery_labels(spark, d):
    out = discovery.discover(_causal_features(spark, d), list(features.CAUSAL_FEATURES))
    return out.select("segment_id", "candidate_label", "max_probability", "posterior_entropy", "model_disagreement", "density_score", "recognizability", "unknown_reason", "label", "is_unknown")


@query("discovery_labels_baseline")
def discovery_labels_baseline(spark, d):
    out = discovery.discover(_causal_features(spark, d), list(features.CAUSAL_FEATURES), backend="gmm")
    return out.select("segment_id", "candidate_label", "max_probability", "posterior_entropy", "recognizability", "unknown_reason", "label", "is_unknown")


@query("discovery_walk_forward")
def discovery_walk_forward(spark, d):
    out = discovery.walk_forward(_causal_features(spark, d), list(features.CAUSAL_FEATURES), min_rows=40, every=20)
    return out.select("segment_id", "label", "unknown_reason", "is_unknown", "max_probability", "state_available_at", "oos_model_trained_at", "oos_train_rows", "oos_train_max_end", "oos_train_max_available_at")


SCHEDULE = """
, dd AS (SELECT available_at AS t, count(*) AS n FROM f4_states GROUP BY ALL), k AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS k, coalesce(sum(n) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM dd),
v AS (SELECT t, last_value(CASE WHEN before >= 50 AND (k = (SELECT min(k) FROM k WHERE before >= 50) OR k % 20 = 0) THEN t END IGNORE NULLS) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS version FROM k)
"""


@query("refit_schedule", oracle("f4_states", SCHEDULE + "SELECT t AS decision_at, version FROM v"))
def refit_schedule(spark, d):
    return discovery.refit_schedule(states(spark, d), min_rows=50, every=20)


def _timed(spark, d):
    return fixed(spark, d).withColumn("available_at", F.col("end"))


@query("training_bounds", oracle(("f3_fixed_segments", "f4_states"), SCHEDULE + """
SELECT x.version, count(*) AS train_rows, max(s.end_ts) AS train_max_end, max(s.end_ts) AS train_max_available_at FROM (SELECT DISTINCT version FROM v WHERE version IS NOT NULL) x JOIN f3_fixed_segments s ON s.end_ts < x.version GROUP BY x.version"""))
def training_bounds(spark, d):
    rows = _timed(spark, d)
    return discovery.training_bounds(rows, discovery.refit_schedule(rows, min_rows=50, every=20))


@query("purged_overlaps", oracle(("f3_fixed_segments", "f4_states"), SCHEDULE + """
SELECT s.segment_id, v.version, coalesce(s.start_ts <= (SELECT max(p.end_ts) FROM f3_fixed_segments p WHERE p.symbol = s.symbol AND p.end_ts < v.version), false) AS purged FROM f3_fixed_segments s LEFT JOIN v ON v.t = s.end_ts"""))
def purged_overlaps(spark, d):
    rows = _timed(spark, d)
    return discovery.purge_overlaps(rows, discovery.refit_schedule(rows, min_rows=50, every=20)).select("segment_id", "version", "purged")


@query("year_quotas", oracle("f2_ship_bars", """
, a AS (SELECT CAST(year(timestamp) AS INT) AS year, count(*) AS available FROM f2_ship_bars GROUP BY ALL), b AS (SELECT *, least(available, 5) AS low FROM a), c AS (SELECT *, greatest(least(1000, sum(available) OVER ()) - sum(low) OVER (), 0) AS rest, sum(available - low) OVER () AS room FROM b),
e AS (SELECT *, rest * (available - low) / CAST(room AS DOUBLE) AS share FROM c), f AS (SELECT *, floor(share) AS whole FROM e)
SELECT year, available, CAST(low + whole + CASE WHEN row_number() OVER (ORDER BY share - whole DESC, year) <= rest - sum(whole) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM f"""))
def year_quotas(spark, d):
    return discovery.year_quotas(load(spark, d, "f2_ship_bars").withColumnRenamed("timestamp", "start"), 1000, 5)


@query("gaussian_soft_assign")
def gaussian_soft_assign(spark, d):
    """Over all dimensions; held to brute force in the tests."""
    return rounded(discovery.soft_assign(spark.read.parquet(f"{d}/embeddings.parquet")))


@query("segment_audit", oracle("f3_fixed_segments", """
, a AS (SELECT *, CASE WHEN segment_no % 17 = 0 THEN n_bars + 1 ELSE n_bars END AS nb FROM f3_fixed_segments UNION ALL SELECT *, n_bars FROM f3_fixed_segments WHERE segment_no % 19 = 0)
SELECT 'duplicate_segment_id' AS code, count(*) - count(DISTINCT segment_id) AS n FROM a UNION ALL SELECT 'invalid_segment_geometry', count(*) FILTER (WHERE start_ts > end_ts OR end_idx < start_idx OR nb <> end_idx - start_idx + 1) FROM a
UNION ALL SELECT 'missing_features', count(DISTINCT segment_id) FILTER (WHERE segment_no % 13 = 0) FROM a UNION ALL SELECT 'premature_label', count(*) FILTER (WHERE label <> 'UNKNOWN') FROM a"""))
def segment_audit(spark, d):
    rows = fixed(spark, d)
    bad = rows.withColumn("n_bars", F.when(F.col("segment_no") % 17 == 0, F.col("n_bars") + 1).otherwise(F.col("n_bars"))).unionByName(rows.where("segment_no % 19 = 0"))
    return audit.audit_segments(bad, bad.where("segment_no % 13 <> 0").select("segment_id"))


@query("causal_state_audit", oracle("f4_states", """
SELECT count(*) AS rows, count(*) FILTER (WHERE available_at IS NULL) AS without_time, count(*) FILTER (WHERE prob_CLUSTER_A + prob_CLUSTER_B NOT BETWEEN 0.999999 AND 1.000001) AS bad_probabilities FROM f4_states"""))
def causal_state_audit(spark, d):
    return states(spark, d).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("available_at").isNull()).alias("without_time"), F.count_if(~(F.col("prob_CLUSTER_A") + F.col("prob_CLUSTER_B")).between(0.999999, 1.000001)).alias("bad_probabilities"))


@query("version_transitions", oracle("f4_states", """
, n AS (SELECT model_version AS v, label AS f, lead(label) OVER w AS g, lead(start_idx) OVER w AS s, end_idx AS e FROM f4_states WINDOW w AS (PARTITION BY model_version, symbol ORDER BY start_idx, end_idx)), q AS (SELECT v, f, g, count(*) AS n FROM n WHERE g IS NOT NULL AND s <= e + 1 GROUP BY ALL), l AS (SELECT DISTINCT model_version AS v, label AS x FROM f4_states)
SELECT a.v AS model_version, a.x AS from_label, b.x AS to_label, coalesce(q.n, 0) AS n FROM l a JOIN l b USING (v) LEFT JOIN q ON q.v = a.v AND q.f = a.x AND q.g = b.x"""))
def version_transitions(spark, d):
    return labels.version_transitions(states(spark, d))


@query("weighted_robustness", oracle("f4_states", """
SELECT model_version, label, count(*) AS rows, sum(n_bars)::DOUBLE AS weight, round(sum(n_bars * prob_CLUSTER_A) / sum(n_bars), 6) AS "prob_CLUSTER_A", round(sum(n_bars * boundary_uncertainty) / sum(n_bars), 6) AS boundary_uncertainty FROM f4_states GROUP BY ALL"""))
def weighted_robustness(spark, d):
    return rounded(labels.weighted_summary(states(spark, d), ["prob_CLUSTER_A", "boundary_uncertainty"], "n_bars", ["model_version", "label"]))


@query("hsmm_sensitivity")
def hsmm_sensitivity(spark, d):
    return rounded(labels.duration_sensitivity(states(spark, d)))


@query("label_profiles", oracle("f4_states", """
, x AS (SELECT prob_CLUSTER_A AS a, prob_CLUSTER_B AS b, CAST(n_bars AS DOUBLE) AS n, boundary_uncertainty AS u FROM f4_states)
SELECT 'CLUSTER_A' AS label, 'n_bars' AS feature, round(sum(a * n) / sum(a), 6) AS mean FROM x UNION ALL SELECT 'CLUSTER_A', 'boundary_uncertainty', round(sum(a * u) / sum(a), 6) FROM x UNION ALL SELECT 'CLUSTER_B', 'n_bars', round(sum(b * n) / sum(b), 6) FROM x UNION ALL SELECT 'CLUSTER_B', 'boundary_uncertainty', round(sum(b * u) / sum(b), 6) FROM x"""))
def label_profiles(spark, d):
    return rounded(discovery.profiles(states(spark, d), ["n_bars", "boundary_uncertainty"], ["CLUSTER_A", "CLUSTER_B"]))


@query("descriptive_workflow")
def descriptive_workflow(spark, d):
    """Merged rows of the whole retrospective flow."""
    from .workflows import describe_bars

    return describe_bars(load(spark, d, "f1_event_bars"))["merged"].select("segment_id", "symbol", "label", "start_idx", "end_idx", "n_bars", "cumulative_return")


@query("causal_workflow_audit")
def causal_workflow_audit(spark, d):
    """Audit counts of out-of-sample states of the causal flow."""
    from .workflows import causal_states

    return audit.audit_states(causal_states(load(spark, d, "f1_event_bars"), min_rows=40)["states"])


# --- evidence, provenance and joins ---


@query("null_evidence_gates", oracle("f4_states", """
, s AS (SELECT segment_id, CAST(split_part(segment_id, ':', 2) AS INT) AS n, boundary_uncertainty AS u FROM f4_states),
e AS (SELECT segment_id, n, greatest(0, least(1, coalesce(CASE WHEN n % 3 <> 0 THEN u END, 1.0))) AS given, 1 - greatest(0, least(1, coalesce(CASE WHEN n % 3 <> 1 THEN 1.2 - u END, 0.0))) AS fallback, greatest(0, least(1, coalesce(CASE WHEN n % 4 <> 0 THEN (n % 5) / 4.0 END, 0))) AS conflict FROM s)
SELECT segment_id, round(given, 6) AS given, round(fallback, 6) AS fallback, round(conflict, 6) AS context_conflict, concat_ws(';', CASE WHEN given > 0.44 THEN 'boundary_unstable' END, CASE WHEN conflict > 0.75 THEN 'context_conflict' END) AS unknown_reason FROM e"""))
def null_evidence_gates(spark, d):
    """Missing boundary evidence closes the gate, whichever column it would stand in; a given conflict is kept."""
    n = F.split("segment_id", ":")[1].cast("int")
    u = F.col("boundary_uncertainty")
    rows = states(spark, d).select("segment_id", n.alias("n"), F.when(n % 3 != 0, u).alias("boundary_uncertainty"), F.when(n % 3 != 1, 1.2 - u).alias("boundary_probability"), F.when(n % 4 != 0, (n % 5) / 4.0).alias("multi_period_conflict"), F.lit("A").alias("candidate_label"))
    fallback = discovery.boundary_uncertainty(rows.drop("boundary_uncertainty")).select("segment_id", F.col("boundary_uncertainty").alias("fallback"))
    out = discovery.context_conflict(discovery.boundary_uncertainty(rows))
    gates = [g for g in labels.discovery_gates(GateConfig()) if g[0] in ("boundary_unstable", "context_conflict")]
    return rounded(labels.apply_gates(out, gates).join(fallback, "segment_id").select("segment_id", F.col("boundary_uncertainty").alias("given"), "fallback", "context_conflict", "unknown_reason"))


@query("walk_forward_provenance", oracle(("f3_fixed_segments", "f4_states"), SCHEDULE + """
, b AS (SELECT x.version, count(*) AS n, max(s.end_ts) AS a FROM (SELECT DISTINCT version FROM v WHERE version IS NOT NULL) x JOIN f3_fixed_segments s ON s.end_ts < x.version GROUP BY x.version),
l AS (SELECT s.segment_id, s.end_ts, s.start_ts, v.version, (SELECT max(p.end_ts) FROM f3_fixed_segments p WHERE p.symbol = s.symbol AND p.end_ts < v.version) AS e FROM f3_fixed_segments s LEFT JOIN v ON v.t = s.end_ts)
SELECT segment_id, end_ts AS state_available_at, l.version AS oos_model_trained_at, coalesce(b.n, 0) AS oos_train_rows, e AS oos_train_max_end, b.a AS oos_train_max_available_at,
       CASE WHEN l.version IS NULL THEN 'insufficient_history' WHEN start_ts <= e THEN 'purged_overlap' ELSE 'scored' END AS outcome FROM l LEFT JOIN b ON b.version = l.version"""))
def walk_forward_provenance(spark, d):
    """What each out-of-sample state was fitted on: the version, its rows, and the symbol's own last training end."""
    n = F.col("segment_no")
    rows = _timed(spark, d).select("segment_id", "symbol", "start", "end", "available_at", (n % 7).cast("double").alias("x"), (n * 37 % 11).cast("double").alias("y"))
    out = discovery.walk_forward(rows, ["x", "y"], GateConfig(n_clusters=2, ensemble_size=1, max_iter=5), min_rows=50, every=20)
    special = F.col("unknown_reason").isin("insufficient_history", "purged_overlap")
    return out.select("segment_id", "state_available_at", "oos_model_trained_at", "oos_train_rows", "oos_train_max_end", "oos_train_max_available_at", F.when(special, F.col("unknown_reason")).otherwise("scored").alias("outcome"))


@query("state_audit", oracle("f4_states", """
, s AS (SELECT CAST(split_part(segment_id, ':', 2) AS INT) AS n, label, available_at AS t FROM f4_states),
x AS (SELECT *, label = 'UNKNOWN' AS un, CASE WHEN n % 5 = 0 THEN NULL WHEN n % 11 = 3 THEN t + INTERVAL 1 DAY ELSE t - INTERVAL 1 DAY END AS m, CASE WHEN n % 13 = 7 THEN t + INTERVAL 2 DAY ELSE t - INTERVAL 2 DAY END AS a, CASE WHEN n % 17 = 1 THEN NULL ELSE t END AS sa, CASE WHEN n % 2 = 0 THEN 'low' ELSE '' END AS why FROM s)
SELECT 'model_after_state' AS code, count(*) FILTER (WHERE m > sa) AS n FROM x UNION ALL SELECT 'training_not_before_model', count(*) FILTER (WHERE a >= m) FROM x UNION ALL SELECT 'known_without_model', count(*) FILTER (WHERE NOT un AND m IS NULL) FROM x
UNION ALL SELECT 'state_without_time', count(*) FILTER (WHERE sa IS NULL) FROM x UNION ALL SELECT 'unknown_without_reason', count(*) FILTER (WHERE un AND why = '') FROM x"""))
def state_audit(spark, d):
    """The audit of out-of-sample states over rows with planted faults."""
    n, t = F.split("segment_id", ":")[1].cast("int"), F.col("available_at")
    day = lambda k: F.expr(f"available_at + INTERVAL '{k}' DAY")
    rows = states(spark, d).select(
        (F.col("label") == "UNKNOWN").alias("is_unknown"), F.when(n % 5 == 0, None).when(n % 11 == 3, day(1)).otherwise(day(-1)).alias("oos_model_trained_at"),
        F.when(n % 13 == 7, day(2)).otherwise(day(-2)).alias("oos_train_max_available_at"), F.when(n % 17 != 1, t).alias("state_available_at"), F.when(n % 2 == 0, "low").otherwise("").alias("unknown_reason"),
    )
    return audit.audit_states(rows)


@query("artifact_audit", oracle("f3_fixed_segments", """
, s AS (SELECT *, CAST(segment_no % 4 AS VARCHAR) AS bucket FROM f3_fixed_segments),
a AS (SELECT bucket, segment_id, CASE WHEN segment_no % 17 = 0 THEN n_bars + 1 ELSE n_bars END AS nb, start_idx, end_idx, CASE WHEN segment_no % 23 = 5 THEN 1.5 ELSE 0.5 END AS p FROM s UNION ALL SELECT '3', segment_id, n_bars, start_idx, end_idx, 0.5 FROM s WHERE segment_no % 19 = 0),
f AS (SELECT bucket, segment_id FROM s WHERE segment_no % 13 <> 0), r AS (SELECT bucket, segment_id, label FROM s UNION ALL SELECT bucket, segment_id, label FROM s WHERE segment_no % 29 = 0),
c AS (SELECT b.bucket, (SELECT count(*) FROM a WHERE a.bucket = b.bucket) AS na, (SELECT count(*) FROM f WHERE f.bucket = b.bucket) AS nf, (SELECT count(*) FROM r WHERE r.bucket = b.bucket) AS nr FROM (SELECT DISTINCT bucket FROM s) b),
u AS (SELECT bucket, segment_id FROM a UNION SELECT bucket, segment_id FROM f UNION SELECT bucket, segment_id FROM r)
SELECT bucket, 'duplicate_segment_id' AS code, 'review' AS artifact, count(*) - count(DISTINCT segment_id) AS n FROM r GROUP BY bucket HAVING count(*) > count(DISTINCT segment_id)
UNION ALL SELECT bucket, 'duplicate_segment_id', 'segments', count(*) - count(DISTINCT segment_id) FROM a GROUP BY bucket HAVING count(*) > count(DISTINCT segment_id)
UNION ALL SELECT bucket, 'premature_semantic_label', 'review', 1 FROM r GROUP BY bucket HAVING bool_or(label <> 'UNKNOWN')
UNION ALL SELECT bucket, 'segment_id_set_mismatch', NULL, count(*) FROM u WHERE NOT (EXISTS (SELECT 1 FROM a WHERE a.bucket = u.bucket AND a.segment_id = u.segment_id) AND EXISTS (SELECT 1 FROM f WHERE f.bucket = u.bucket AND f.segment_id = u.segment_id) AND EXISTS (SELECT 1 FROM r WHERE r.bucket = u.bucket AND r.segment_id = u.segment_id)) GROUP BY bucket
UNION ALL SELECT bucket, 'cross_bucket_duplicate_id', NULL, count(*) FROM (SELECT DISTINCT bucket, segment_id FROM a) x WHERE EXISTS (SELECT 1 FROM a y WHERE y.segment_id = x.segment_id AND y.bucket < x.bucket) GROUP BY bucket
UNION ALL SELECT bucket, 'row_count_mismatch', NULL, na FROM c WHERE bucket <> '2' AND (na <> nf OR na <> nr)
UNION ALL SELECT '2', 'bucket_incomplete', 'running', 1
UNION ALL SELECT bucket, 'invalid_segment_geometry', NULL, count(*) FROM a WHERE nb <> end_idx - start_idx + 1 GROUP BY bucket UNION ALL SELECT bucket, 'invalid_probability', 'boundary_probability', count(*) FROM a WHERE p > 1 GROUP BY bucket"""))
def artifact_audit(spark, d):
    """The audit of a build in buckets over artefacts with planted faults."""
    n = F.col("segment_no")
    rows = fixed(spark, d).withColumn("bucket", (n % 4).cast("string"))
    unlabelled = rows.drop("label").withColumn("boundary_probability", F.lit(0.5))
    bad = unlabelled.withColumns({"n_bars": F.when(n % 17 == 0, F.col("n_bars") + 1).otherwise(F.col("n_bars")), "boundary_probability": F.when(n % 23 == 5, 1.5).otherwise(0.5)})
    segs = bad.unionByName(unlabelled.where("segment_no % 19 = 0").withColumn("bucket", F.lit("3")))
    review = rows.select("bucket", "segment_id", "segment_no", F.col("label").alias("predicted_label"))
    review = review.unionByName(review.where("segment_no % 29 = 0"))
    told = segs.groupBy("bucket").agg(F.count(F.lit(1)).alias("segments")).withColumn("status", F.when(F.col("bucket") == "2", "running").otherwise("complete"))
    return audit.audit_artifacts(segs, rows.where("segment_no % 13 <> 0").select("bucket", "segment_id"), review, told, complete=True)


@query("states_with_regime", oracle(("f4_states", "f2b_supplier_panel"), """
, rg AS (SELECT CAST(timestamp AS DATE) AS d, CASE WHEN month(timestamp) % 3 = 0 THEN 'BULL_PROXY' ELSE 'BEAR_PROXY' END AS g FROM (SELECT DISTINCT timestamp FROM f2b_supplier_panel) WHERE month(timestamp) % 5 <> 0),
s AS (SELECT segment_id, TIMESTAMP '1994-01-01' + INTERVAL (CAST(split_part(segment_id, ':', 2) AS INT)) MONTH AS t FROM f4_states)
SELECT s.segment_id, coalesce(rg.g, 'UNKNOWN') AS market_proxy_regime FROM s LEFT JOIN rg ON rg.d = CAST(s.t AS DATE)"""))
def states_with_regime(spark, d):
    months = load(spark, d, "f2b_supplier_panel").select("timestamp").distinct().where(F.month("timestamp") % 5 != 0)
    regimes = months.withColumn("market_proxy_regime", F.when(F.month("timestamp") % 3 == 0, "BULL_PROXY").otherwise("BEAR_PROXY"))
    rows = states(spark, d).select("segment_id", F.add_months(F.lit("1994-01-01").cast("date"), F.split("segment_id", ":")[1].cast("int")).cast("timestamp_ntz").alias("state_available_at"))
    return labels.with_regimes(rows, regimes).select("segment_id", "market_proxy_regime")


@query("label_descriptions_by_version", oracle("f4_states", """
, u AS (SELECT model_version, label, unnest(['n_bars', 'boundary_uncertainty']) AS feature, unnest([CAST(n_bars AS DOUBLE), boundary_uncertainty]) AS x FROM f4_states), k AS (SELECT model_version, count(*) AS k FROM f4_states GROUP BY ALL)
SELECT model_version, label, feature, count(x) AS n, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max, count(*) AS segments, round(count(*) / any_value(k), 6) AS share FROM u JOIN k USING (model_version) GROUP BY model_version, label, feature"""))
def label_descriptions_by_version(spark, d):
    return rounded(labels.describe_labels(states(spark, d), ["n_bars", "boundary_uncertainty"], by="model_version"))


@query("inferred_features", "SELECT * FROM (VALUES ('unsupervised', 'duration_bars'), ('unsupervised', 'n_bars'), ('validation', 'boundary_uncertainty'), ('validation', 'duration_bars'), ('validation', 'n_bars')) x(layer, feature)")
def inferred_features(spark, d):
    """Columns that each layer takes as features where none are named."""
    from ..functions.checks import numeric_features, validation_features

    rows = states(spark, d).withColumns({"duration_bars": F.col("n_bars"), "max_probability": F.col("prob_CLUSTER_A"), "gate_low": F.lit(1), "recognizability": F.lit(0.5)})
    rows = rows.drop("start_idx", "end_idx")
    found = [("unsupervised", c) for c in numeric_features(rows)] + [("validation", c) for c in validation_features(rows.drop("gate_low"))]
    return spark.createDataFrame(found, "layer string, feature string")
