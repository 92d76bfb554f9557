"""Queries of the cross-sectional layer on the supplier panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import selection
from ..sources.fixtures import load, oracle
from .bars_queries import rounded

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
TARGET = "future_excess_3d"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def panel(spark, d):
    return load(spark, d, "f2_panel")


def targets(spark, d):
    return selection.forward_targets(panel(spark, d), horizons=(3,))


TARGETS = """
, cal AS (SELECT timestamp, row_number() OVER (ORDER BY timestamp) AS s FROM (SELECT DISTINCT timestamp FROM f2_panel)), b AS (SELECT p.*, cal.s FROM f2_panel p JOIN cal USING (timestamp)),
f AS (SELECT b.*, z.close / b.close - 1 AS ex, CASE WHEN (SELECT count(*) FROM b q WHERE q.symbol = b.symbol AND q.s BETWEEN b.s + 1 AND b.s + 3) = 3 THEN (SELECT min(low) FROM b q WHERE q.symbol = b.symbol AND q.s BETWEEN b.s + 1 AND b.s + 3) / b.close - 1 END AS mae, c3.timestamp AS av
      FROM b LEFT JOIN b z ON z.symbol = b.symbol AND z.s = b.s + 3 LEFT JOIN cal c3 ON c3.s = b.s + 3),
r AS (SELECT *, CASE WHEN ex IS NOT NULL THEN (rank() OVER (PARTITION BY timestamp, ex IS NULL ORDER BY ex) + (count(*) OVER (PARTITION BY timestamp, ex) - 1) / 2.0) / count(ex) OVER (PARTITION BY timestamp) END AS rk FROM f)
"""


@query("forward_targets", oracle("f2_panel", TARGETS + "SELECT symbol, timestamp, round(ex, 8) AS future_excess_3d, round(mae, 8) AS future_mae_3d, round(ex / nullif(abs(mae), 0), 5) AS future_reward_risk_3d, av AS target_available_at_3d FROM r"))
def forward_targets(spark, d):
    out = targets(spark, d).select("symbol", "timestamp", TARGET, "future_mae_3d", F.round("future_reward_risk_3d", 5).alias("future_reward_risk_3d"), "target_available_at_3d")
    return rounded(out, 8)


@query("forward_targets_benchmark", oracle("f2_panel", TARGETS + "SELECT r.symbol, r.timestamp, round(r.ex - q.ex, 8) AS future_excess_3d FROM r LEFT JOIN r q ON q.timestamp = r.timestamp AND q.symbol = 'Supplier#000000003'"))
def forward_targets_benchmark(spark, d):
    return rounded(selection.forward_targets(panel(spark, d), horizons=(3,), benchmark="Supplier#000000003").select("symbol", "timestamp", TARGET), 8)


@query("forward_rank", oracle("f2_panel", TARGETS + "SELECT symbol, timestamp, round(rk, 8) AS future_rank_3d FROM r"))
def forward_rank(spark, d):
    return rounded(targets(spark, d).select("symbol", "timestamp", "future_rank_3d"), 8)


@query("selection_states", oracle(("f1_event_bars", "f4_states"), "SELECT b.symbol, b.timestamp, s.label, s.available_at AS state_at FROM f1_event_bars b ASOF LEFT JOIN f4_states s ON b.symbol = s.symbol AND b.timestamp > s.available_at"))
def selection_states(spark, d):
    states = load(spark, d, "f4_states").withColumnRenamed("available_at", "timestamp").select("symbol", "timestamp", "label")
    return selection.join_states(load(spark, d, "f1_event_bars"), states, ["label", "state_at"]).select("symbol", "timestamp", "label", "state_at")


NEUTRAL = """
, v AS (SELECT *, ln(greatest(market_cap, 1)) AS x, avg({y}) OVER g AS my, avg(ln(greatest(market_cap, 1))) OVER g AS mx FROM {source} WHERE {y} IS NOT NULL WINDOW g AS (PARTITION BY timestamp, industry)),
bt AS (SELECT timestamp, sum((x - mx) * ({y} - my)) / nullif(sum((x - mx) * (x - mx)), 0) AS beta, count(*) AS n, count(DISTINCT industry) + 1 AS p FROM v GROUP BY timestamp),
nz AS (SELECT v.*, CASE WHEN n <= p THEN {y} ELSE ({y} - my) - coalesce(beta, 0) * (x - mx) END AS neutral FROM v JOIN bt USING (timestamp))
"""


@query("neutralized_score", oracle("f2_panel", NEUTRAL.format(y="signal", source="f2_panel") + "SELECT symbol, timestamp, round(neutral, 5) AS signal_neutral FROM nz"))
def neutralized_score(spark, d):
    return rounded(selection.neutralise(panel(spark, d), "signal").select("symbol", "timestamp", "signal_neutral"), 5)


RANKED = TARGETS + """
, y AS (SELECT timestamp, signal, ex FROM r WHERE ex IS NOT NULL), k AS (SELECT timestamp, rank() OVER (PARTITION BY timestamp ORDER BY signal) + (count(*) OVER (PARTITION BY timestamp, signal) - 1) / 2.0 AS a, rank() OVER (PARTITION BY timestamp ORDER BY ex) + (count(*) OVER (PARTITION BY timestamp, ex) - 1) / 2.0 AS b FROM y),
ic AS (SELECT timestamp, count(*) AS n, CASE WHEN count(*) >= 3 THEN covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) END AS ic FROM k GROUP BY timestamp)
"""


@query("rank_ic", oracle("f2_panel", RANKED + "SELECT timestamp, n, round(ic, 6) AS rank_ic FROM ic"))
def rank_ic(spark, d):
    return rounded(selection.rank_ic(targets(spark, d), "signal", TARGET))


@query("yearly_ic", oracle("f2_panel", RANKED + "SELECT CAST(year(timestamp) AS INT) AS year, round(avg(ic), 6) AS mean, round(stddev_samp(ic), 6) AS std, count(*) AS n, round(avg(ic) / nullif(stddev_samp(ic), 0), 6) AS icir FROM ic WHERE ic IS NOT NULL GROUP BY year(timestamp)"))
def yearly_ic(spark, d):
    return rounded(selection.yearly_ic(selection.rank_ic(targets(spark, d), "signal", TARGET)))


@query("hac_tstat", oracle("f2_panel", RANKED + """
, x AS (SELECT row_number() OVER (ORDER BY timestamp) AS i, ic AS x FROM ic WHERE ic IS NOT NULL), m AS (SELECT count(*) AS n, avg(x) AS m FROM x), c AS (SELECT i, x - m AS c, n, m FROM x, m),
g AS (SELECT j.j, sum(a.c * b.c) / any_value(a.n) AS g FROM range(3) j(j) JOIN c a ON true JOIN c b ON a.i - j.j = b.i GROUP BY j.j), s AS (SELECT sum(CASE WHEN j = 0 THEN g ELSE 2 * (1 - j / 3.0) * g END) AS s FROM g)
SELECT n, round(m, 6) AS mean, round(m / sqrt(greatest(s, 0) / n), 5) AS hac_t FROM m, s"""))
def hac_tstat(spark, d):
    out = selection.hac_t(selection.rank_ic(targets(spark, d), "signal", TARGET), "rank_ic", max_lag=2)
    return rounded(out.withColumn("hac_t", F.round("hac_t", 5)))


GROUPED = TARGETS + """
, q AS (SELECT *, row_number() OVER (PARTITION BY timestamp ORDER BY signal, symbol) AS rn, count(*) OVER (PARTITION BY timestamp) AS n FROM r), g AS (SELECT *, CASE WHEN n >= 5 THEN CAST(greatest(((rn - 1) * 5 + n - 2) // (n - 1), 1) - 1 AS INT) END AS grp FROM q),
gr AS (SELECT timestamp, grp, avg(ex) AS mr FROM g WHERE grp IS NOT NULL AND ex IS NOT NULL GROUP BY ALL)
"""


def grouped(spark, d):
    return selection.quantile_groups(targets(spark, d), "signal", 5)


@query("quantile_groups", oracle("f2_panel", GROUPED + 'SELECT symbol, timestamp, grp AS "group" FROM g'))
def quantile_groups(spark, d):
    return grouped(spark, d).select("symbol", "timestamp", "group")


@query("quantile_returns", oracle("f2_panel", GROUPED + 'SELECT timestamp, grp AS "group", round(mr, 8) AS mean_return FROM gr'))
def quantile_returns(spark, d):
    return rounded(selection.group_returns(grouped(spark, d), TARGET), 8)


@query("group_monotonicity", oracle("f2_panel", GROUPED + """
, a AS (SELECT grp, avg(mr) AS m FROM gr GROUP BY grp), k AS (SELECT rank() OVER (ORDER BY grp) AS x, rank() OVER (ORDER BY m) AS y FROM a) SELECT round(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)), 6) AS monotonicity FROM k"""))
def group_monotonicity(spark, d):
    return rounded(selection.monotonicity(grouped(spark, d), TARGET))


LONG_SHORT = GROUPED + """
, dd AS (SELECT timestamp FROM cal WHERE (s - 1) % 3 = 0), h AS (SELECT g.*, max(grp) OVER w AS hi, min(grp) OVER w AS lo FROM g JOIN dd USING (timestamp) WHERE grp IS NOT NULL WINDOW w AS (PARTITION BY g.timestamp)),
ws AS (SELECT timestamp, symbol, CASE WHEN grp = hi THEN 1.0 ELSE -1.0 END / count(*) OVER (PARTITION BY timestamp, grp) AS w FROM h WHERE grp = hi OR grp = lo),
o AS (SELECT timestamp, row_number() OVER (ORDER BY timestamp) AS j FROM (SELECT DISTINCT timestamp FROM ws)), sy AS (SELECT DISTINCT symbol FROM ws),
mv AS (SELECT o.j, o.timestamp, coalesce(ws.w, 0) - coalesce(lag(ws.w) OVER (PARTITION BY sy.symbol ORDER BY o.j), 0) AS d FROM o CROSS JOIN sy LEFT JOIN ws ON ws.timestamp = o.timestamp AND ws.symbol = sy.symbol),
tv AS (SELECT timestamp, CASE WHEN j = 1 THEN 0.0 ELSE sum(abs(d)) / 2 END AS turnover FROM mv GROUP BY j, timestamp),
gs AS (SELECT timestamp, max(CASE WHEN grp = (SELECT max(grp) FROM gr) THEN mr END) - max(CASE WHEN grp = (SELECT min(grp) FROM gr) THEN mr END) AS gross FROM gr JOIN dd USING (timestamp) GROUP BY timestamp),
ls AS (SELECT timestamp, coalesce(turnover, 0.0) AS turnover, gross, gross - coalesce(turnover, 0.0) * 20 / 1e4 AS net FROM gs LEFT JOIN tv USING (timestamp))
"""


@query("turnover_costs", oracle("f2_panel", LONG_SHORT + "SELECT timestamp, round(turnover, 8) AS turnover, round(gross, 8) AS gross, round(net, 8) AS net FROM ls"))
def turnover_costs(spark, d):
    return rounded(selection.long_short(grouped(spark, d), TARGET, every=3, cost_bps=20.0), 8)


@query("long_short_drawdown", oracle("f2_panel", LONG_SHORT + ", w AS (SELECT timestamp, product(1 + coalesce(net, 0)) OVER (ORDER BY timestamp) AS wealth FROM ls) SELECT timestamp, round(wealth, 8) AS wealth, round(wealth / max(wealth) OVER (ORDER BY timestamp) - 1, 8) AS drawdown FROM w"))
def long_short_drawdown(spark, d):
    return rounded(selection.drawdown(selection.long_short(grouped(spark, d), TARGET, every=3, cost_bps=20.0)), 8)


@query("ridge_walk_forward_1f", oracle("f2_panel", TARGETS + """
, t AS (SELECT timestamp AS t, signal AS x, ex AS y, av FROM r WHERE ex IS NOT NULL AND av IS NOT NULL AND signal IS NOT NULL), fk AS (SELECT t, min(av) AS fk FROM t GROUP BY t),
c AS (SELECT cal.timestamp AS d, cal.s, count(t.x) AS n, avg(t.x) AS mx, avg(t.y) AS my, var_pop(t.x) AS vx, covar_pop(t.x, t.y) AS cxy, (SELECT count(*) FROM fk WHERE fk.fk < cal.timestamp) AS dates FROM cal LEFT JOIN t ON t.av < cal.timestamp GROUP BY cal.timestamp, cal.s),
e AS (SELECT *, n >= 100 AND dates >= 12 AS ok FROM c), z AS (SELECT *, ok AND (s = (SELECT min(s) FROM e WHERE ok) OR (s - 1) % 5 = 0) AS fits FROM e),
m AS (SELECT d, last_value(CASE WHEN fits THEN {'t': d, 'b': n * cxy / sqrt(vx) / (n + 1.0) / sqrt(vx), 'mx': mx, 'my': my} END IGNORE NULLS) OVER (ORDER BY d) AS m FROM z)
SELECT b.symbol, b.timestamp, m.m.t AS model_trained_at, round(m.m.my + m.m.b * (b.signal - m.m.mx), 7) AS score FROM b JOIN m ON m.d = b.timestamp WHERE m.m IS NOT NULL"""))
def ridge_walk_forward_1f(spark, d):
    return rounded(selection.ridge_walk_forward(targets(spark, d), ["signal"], TARGET, min_dates=12, min_rows=100, refit_every=5), 7)


def _neutral(name: str, y: str, size: bool) -> str:
    """name: rows of r with the neutral value of y; NULL where y is."""
    x = "ln(greatest(market_cap, 1))" if size else "0.0"
    return f"""
, {name}_v AS (SELECT symbol, timestamp, industry, CAST({y} AS DOUBLE) AS y, {x} AS x, avg(CAST({y} AS DOUBLE)) OVER g AS my, avg({x}) OVER g AS mx FROM r WHERE {y} IS NOT NULL WINDOW g AS (PARTITION BY timestamp, industry)),
{name}_b AS (SELECT timestamp, CASE WHEN sum((x - mx) * (x - mx)) > 1e-12 THEN sum((x - mx) * (y - my)) / sum((x - mx) * (x - mx)) ELSE 0 END AS beta, count(*) AS n FROM {name}_v GROUP BY timestamp),
{name}_p AS (SELECT timestamp, greatest(count(DISTINCT industry), 1) + {int(size)} AS p FROM r GROUP BY timestamp),
{name} AS (SELECT symbol, timestamp, CASE WHEN n <= p THEN y ELSE y - my - beta * (x - mx) END AS v FROM {name}_v JOIN {name}_b USING (timestamp) JOIN {name}_p USING (timestamp))"""


def _summary(y: str, size: bool, k: str = "") -> str:
    """CTEs up to sm{k}: the summary of score y, rebalanced every three sessions, groups of the neutral score."""
    return _neutral(f"na{k}", y, size) + _neutral(f"nb{k}", "ex", size) + f"""
, pr{k} AS (SELECT a.timestamp, a.v AS s, b.v AS t FROM na{k} a JOIN nb{k} b USING (symbol, timestamp)), kk{k} AS (SELECT timestamp, rank() OVER (PARTITION BY timestamp ORDER BY s) + (count(*) OVER (PARTITION BY timestamp, s) - 1) / 2.0 AS x, rank() OVER (PARTITION BY timestamp ORDER BY t) + (count(*) OVER (PARTITION BY timestamp, t) - 1) / 2.0 AS y FROM pr{k}),
ic{k} AS (SELECT timestamp, CASE WHEN count(*) >= 3 THEN round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 12) END AS ic FROM kk{k} GROUP BY timestamp),
q{k} AS (SELECT r.symbol, r.timestamp, r.ex, a.v, row_number() OVER (PARTITION BY r.timestamp ORDER BY a.v, r.symbol) AS rn, count(*) OVER (PARTITION BY r.timestamp) AS n FROM r JOIN na{k} a USING (symbol, timestamp)),
g{k} AS (SELECT *, CASE WHEN n >= 5 THEN CAST(greatest(((rn - 1) * 5 + n - 2) // (n - 1), 1) - 1 AS INT) END AS grp FROM q{k}), gr{k} AS (SELECT timestamp, grp, avg(ex) AS mr FROM g{k} WHERE grp IS NOT NULL AND ex IS NOT NULL GROUP BY ALL),
dd{k} AS (SELECT timestamp FROM cal WHERE (s - 1) % 3 = 0), gs{k} AS (SELECT timestamp, max(CASE WHEN grp = (SELECT max(grp) FROM gr{k}) THEN mr END) - max(CASE WHEN grp = (SELECT min(grp) FROM gr{k}) THEN mr END) AS net FROM gr{k} JOIN dd{k} USING (timestamp) GROUP BY timestamp),
wl{k} AS (SELECT timestamp, product(1 + coalesce(net, 0)) OVER (ORDER BY timestamp) AS w FROM gs{k}), dr{k} AS (SELECT min(w / m - 1) AS dd FROM (SELECT w, max(w) OVER (ORDER BY timestamp) AS m FROM wl{k})),
mo{k} AS (SELECT covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) AS mono FROM (SELECT rank() OVER (ORDER BY grp) AS x, rank() OVER (ORDER BY m) AS y FROM (SELECT grp, avg(mr) AS m FROM gr{k} GROUP BY grp))),
xs{k} AS (SELECT row_number() OVER (ORDER BY timestamp) AS i, ic AS x FROM ic{k} WHERE ic IS NOT NULL), mm{k} AS (SELECT count(*) AS n, avg(x) AS m FROM xs{k}), cc{k} AS (SELECT i, x - m AS c, n, m FROM xs{k}, mm{k}),
ga{k} AS (SELECT j.j, sum(u.c * w.c) / any_value(u.n) AS g FROM range(3) j(j) JOIN cc{k} u ON true JOIN cc{k} w ON u.i - j.j = w.i GROUP BY j.j), hs{k} AS (SELECT m / sqrt(greatest((SELECT sum(CASE WHEN j = 0 THEN g ELSE 2 * (1 - j / 3.0) * g END) FROM ga{k}), 0) / n) AS t FROM mm{k}),
sm{k} AS (SELECT round(avg(ic), 6) AS rank_ic, round(avg(ic) / nullif(stddev_samp(ic), 0), 6) AS icir, round(avg(CASE WHEN ic > 0 THEN 1.0 WHEN ic <= 0 THEN 0.0 END), 6) AS rank_ic_positive_rate, round((SELECT t FROM hs{k}), 5) AS rank_ic_hac_t, (SELECT round(avg(net), 6) FROM gs{k}) AS mean_net_long_short,
 (SELECT round(dd, 6) FROM dr{k}) AS max_drawdown, (SELECT round(mono, 6) FROM mo{k}) AS monotonicity, (SELECT count(*) FROM r WHERE {y} IS NOT NULL AND ex IS NOT NULL) AS scored_rows FROM ic{k})"""


@query("selection_summary", oracle("f2_panel", TARGETS + _summary("signal", True) + "SELECT * FROM sm"))
def selection_summary(spark, d):
    out = selection.evaluate(targets(spark, d), "signal", TARGET)["summary"]
    return rounded(out.withColumn("rank_ic_hac_t", F.round("rank_ic_hac_t", 5)))


@query("regime_ic", oracle("f2_panel", TARGETS + """
, pr AS (SELECT CASE WHEN month(timestamp) % 3 = 0 THEN 'BULL' ELSE 'BEAR' END AS market_regime, signal AS s, ex AS t FROM r WHERE ex IS NOT NULL),
k AS (SELECT market_regime, rank() OVER (PARTITION BY market_regime ORDER BY s) + (count(*) OVER (PARTITION BY market_regime, s) - 1) / 2.0 AS x, rank() OVER (PARTITION BY market_regime ORDER BY t) + (count(*) OVER (PARTITION BY market_regime, t) - 1) / 2.0 AS y FROM pr)
SELECT market_regime, count(*) AS n, round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 6) AS rank_ic FROM k GROUP BY market_regime"""))
def regime_ic(spark, d):
    rows = targets(spark, d).withColumn("market_regime", F.when(F.month("timestamp") % 3 == 0, "BULL").otherwise("BEAR"))
    return rounded(selection.rank_ic(rows, "signal", TARGET, by="market_regime"))


@query("selection_dataset", oracle(("f2_panel", "f4_states"), TARGETS + """
, s AS (SELECT DISTINCT ON (symbol, timestamp) symbol, timestamp, signal + 1 AS st FROM f2_panel WHERE month(timestamp) % 2 = 0)
SELECT r.symbol, r.timestamp, s.st AS state, round(r.ex, 8) AS future_excess_3d, r.av AS target_available_at_3d FROM r ASOF LEFT JOIN s ON s.symbol = r.symbol AND r.timestamp > s.timestamp"""))
def selection_dataset(spark, d):
    """One call from bars and states, both with repeated keys of which the last as read counts."""
    rows = panel(spark, d).coalesce(1)
    stale = rows.withColumns({"close": F.col("close") * 3, "low": F.col("low") / 2})
    states = rows.where(F.month("timestamp") % 2 == 0).select("symbol", "timestamp", (F.col("signal") + 1).alias("state"))
    both = states.withColumn("state", F.lit(-1.0)).unionByName(states).coalesce(1)
    out = selection.selection_dataset(stale.unionByName(rows).coalesce(1), both, ["state"], horizons=(3,))
    return rounded(out.select("symbol", "timestamp", "state", TARGET, "target_available_at_3d"), 8)


@query("selection_compare", oracle("f2_panel", TARGETS + _summary("signal", False, "1") + _summary("market_cap", False, "2") + "SELECT *, 'signal' AS score FROM sm1 UNION ALL SELECT *, 'size_score' FROM sm2"))
def selection_compare(spark, d):
    rows = targets(spark, d).withColumn("size_score", F.col("market_cap"))
    out = selection.compare(rows, ["signal", "size_score"], TARGET, size=None)
    return rounded(out.withColumn("rank_ic_hac_t", F.round("rank_ic_hac_t", 5)))


@query("selection_incremental")
def selection_incremental(spark, d):
    rows = targets(spark, d).withColumn("volume_score", F.col("volume"))
    return rounded(selection.incremental_test(rows, ["signal"], ["volume_score"], TARGET, max_lag=2, min_dates=12, min_rows=100))


@query("evidence_gate", """
WITH s AS (SELECT s_suppkey AS id, (s_suppkey % 7 - 3) / 100.0 AS rank_ic, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey % 4 END AS rank_ic_hac_t, (s_suppkey % 10) / 10.0 AS rank_ic_positive_rate, (s_suppkey % 3) / 2.0 AS monotonicity, s_suppkey % 2 - 0.5 AS mean_net_long_short, s_suppkey * 100 AS scored_rows, (s_suppkey % 20) / 100.0 AS ece FROM supplier),
c AS (SELECT id, concat_ws(';', CASE WHEN NOT rank_ic > 0 THEN 'positive_rank_ic' END, CASE WHEN NOT coalesce(rank_ic_hac_t >= 2, false) THEN 'hac_significance' END, CASE WHEN NOT rank_ic_positive_rate >= 0.55 THEN 'positive_rate' END, CASE WHEN NOT monotonicity >= 0.5 THEN 'quantile_monotonicity' END,
 CASE WHEN NOT mean_net_long_short > 0 THEN 'positive_net_long_short' END, CASE WHEN NOT scored_rows >= 1000 THEN 'sample_size' END, CASE WHEN NOT ece <= 0.1 THEN 'classification_calibration' END) AS failed FROM s)
SELECT id, failed AS failed_checks, failed = '' AS passed, CASE WHEN failed = '' THEN 'research_candidate' ELSE 'insufficient_evidence' END AS status FROM c""")
def evidence_gate(spark, d):
    k = F.col("s_suppkey")
    rows = spark.read.parquet(f"{d}/supplier.parquet").select(
        k.alias("id"), ((k % 7 - 3) / 100.0).alias("rank_ic"), F.when(k % 5 != 0, k % 4).cast("double").alias("rank_ic_hac_t"), ((k % 10) / 10.0).alias("rank_ic_positive_rate"), ((k % 3) / 2.0).alias("monotonicity"),
        (k % 2 - 0.5).alias("mean_net_long_short"), (k * 100).alias("scored_rows"), ((k % 20) / 100.0).alias("ece"),
    )
    return selection.assess_evidence(rows).select("id", "failed_checks", "passed", "status")
