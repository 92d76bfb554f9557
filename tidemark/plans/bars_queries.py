"""Queries over bars: ingest, adjustment, point-in-time joins, indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import asof, bars, indicators
from ..sources.fixtures import load, oracle

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(
    "bars_normalized",
    oracle("f1_raw", """
, k AS (SELECT *, row_number() OVER (PARTITION BY ts_code, trade_date ORDER BY ord DESC) AS n FROM f1_raw WHERE close IS NOT NULL)
SELECT ts_code AS symbol, trade_date AS timestamp, open, high, low, close,
       coalesce(last_value(vol IGNORE NULLS) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS volume
FROM k WHERE n = 1"""),
)
def bars_normalized(spark, d):
    return bars.normalize(load(spark, d, "f1_raw"), "ord").select(*bars.BAR)


@query(
    "bars_resampled",
    oracle("f1_event_bars", """
SELECT symbol, CAST(date_trunc('day', timestamp) AS TIMESTAMP) AS timestamp, arg_min(open, timestamp) AS open, max(high) AS high, min(low) AS low, arg_max(close, timestamp) AS close, sum(volume) AS volume
FROM f1_event_bars GROUP BY ALL"""),
)
def bars_resampled(spark, d):
    return bars.resample(load(spark, d, "f1_event_bars"))


@query(
    "bars_latest_dedupe",
    oracle("f1_raw", "SELECT ts_code, trade_date, arg_max(vol, ord) AS vol, max(ord) AS ord FROM (SELECT * REPLACE (coalesce(vol, -1) AS vol) FROM f1_raw) GROUP BY ALL"),
)
def bars_latest_dedupe(spark, d):
    raw = load(spark, d, "f1_raw").withColumn("vol", F.coalesce("vol", F.lit(-1.0)))
    return raw.groupBy("ts_code", "trade_date").agg(F.max_by("vol", "ord").alias("vol"), F.max("ord").alias("ord"))


TR = """
, t AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY timestamp) - 1 AS INT) AS idx,
        greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM f1_event_bars WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)),
a AS (SELECT symbol, idx, tr AS atr FROM t WHERE idx = 0
      UNION ALL SELECT t.symbol, t.idx, (1 - CAST(1 AS DOUBLE) / 14) * a.atr + CAST(1 AS DOUBLE) / 14 * t.tr FROM a JOIN t ON t.symbol = a.symbol AND t.idx = a.idx + 1)"""


@query(
    "true_range",
    oracle("f1_event_bars", """
SELECT symbol, timestamp, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS true_range
FROM f1_event_bars WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)"""),
)
def true_range(spark, d):
    return indicators.true_range(load(spark, d, "f1_event_bars")).select("symbol", "timestamp", "true_range")


@query("atr_wilder", oracle("f1_event_bars", TR + "SELECT a.symbol, t.timestamp, round(a.atr, 4) AS atr FROM a JOIN t USING (symbol, idx)", recursive=True))
def atr_wilder(spark, d):
    return rounded(indicators.atr(load(spark, d, "f1_event_bars")), 4)


@query(
    "rolling_returns_20",
    oracle("f2_ship_bars", """
, r AS (SELECT symbol, timestamp, close / lag(close) OVER w - 1 AS r1, close / lag(close, 20) OVER w - 1 AS r20 FROM f2_ship_bars WINDOW w AS (PARTITION BY symbol ORDER BY timestamp))
SELECT symbol, CAST(timestamp AS TIMESTAMP) AS timestamp, round(r1, 8) AS return_1, round(r20, 8) AS return_20,
       round(CASE WHEN count(r1) OVER v = 20 THEN stddev_samp(r1) OVER v END, 8) AS volatility_20
FROM r WINDOW v AS (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""),
)
def rolling_returns_20(spark, d):
    return rounded(indicators.returns(load(spark, d, "f2_ship_bars")).select("symbol", "timestamp", "return_1", "return_20", "volatility_20"), 8)


@query(
    "relative_strength",
    oracle(("f2b_supplier_panel", "f2c_context"), """
, c AS (SELECT symbol, timestamp AS ctime, close / lag(close, 20) OVER (PARTITION BY symbol ORDER BY timestamp) - 1 AS cr FROM f2c_context),
o AS (SELECT symbol, timestamp, industry, close / lag(close, 20) OVER (PARTITION BY symbol ORDER BY timestamp) - 1 AS r FROM f2b_supplier_panel)
SELECT o.symbol, CAST(o.timestamp AS TIMESTAMP) AS timestamp, round(o.r - c.cr, 8) AS relative_strength
FROM o ASOF LEFT JOIN c ON o.industry = c.symbol AND o.timestamp >= c.ctime"""),
)
def relative_strength(spark, d):
    return rounded(asof.relative_strength(load(spark, d, "f2b_supplier_panel"), load(spark, d, "f2c_context"), on="industry").select("symbol", "timestamp", "relative_strength"), 8)


ASOF = """
SELECT b.symbol, b.timestamp, s.segment_id, s.label FROM f1_event_bars b ASOF LEFT JOIN f4_states s ON b.symbol = s.symbol AND b.timestamp {op} s.available_at"""


@query("asof_context_inclusive", oracle(("f1_event_bars", "f4_states"), ASOF.format(op=">=")))
def asof_context_inclusive(spark, d):
    out = asof.asof(load(spark, d, "f1_event_bars"), load(spark, d, "f4_states"), on="symbol", left_time="timestamp", right_time="available_at", take=["segment_id", "label"])
    return out.select("symbol", "timestamp", "segment_id", "label")


@query("asof_state_strict", oracle(("f1_event_bars", "f4_states"), ASOF.format(op=">")))
def asof_state_strict(spark, d):
    out = asof.asof(load(spark, d, "f1_event_bars"), load(spark, d, "f4_states"), on="symbol", left_time="timestamp", right_time="available_at", take=["segment_id", "label"], strict=True)
    return out.select("symbol", "timestamp", "segment_id", "label")


@query(
    "interval_membership",
    oracle(("f2b_supplier_panel", "f6_membership"), """
SELECT b.symbol, CAST(b.timestamp AS TIMESTAMP) AS timestamp, arg_max(m.l1_code, m.in_date) AS industry_code
FROM f2b_supplier_panel b LEFT JOIN f6_membership m ON m.symbol = b.symbol AND m.in_date <= CAST(b.timestamp AS DATE) AND (m.out_date IS NULL OR m.out_date >= CAST(b.timestamp AS DATE))
GROUP BY b.symbol, b.timestamp"""),
)
def interval_membership(spark, d):
    return asof.interval_membership(load(spark, d, "f2b_supplier_panel"), load(spark, d, "f6_membership")).select("symbol", "timestamp", "industry_code")


@query(
    "listed_on_day",
    oracle(("f6_adjusted_source", "f6_master"), """
SELECT b.ts_code, CAST(b.timestamp AS TIMESTAMP) AS timestamp, b.close FROM f6_adjusted_source b JOIN f6_master m ON m.ts_code = b.ts_code
WHERE m.list_date <= CAST(b.timestamp AS DATE) AND (m.delist_date IS NULL OR m.delist_date >= CAST(b.timestamp AS DATE))"""),
)
def listed_on_day(spark, d):
    return bars.listed_on_day(load(spark, d, "f6_adjusted_source"), load(spark, d, "f6_master")).select("ts_code", "timestamp", "close")


@query("universe_point_in_time", oracle("f6_master", "SELECT ts_code FROM f6_master WHERE list_date <= DATE '1995-12-31' AND (delist_date IS NULL OR delist_date >= DATE '1995-01-01')"))
def universe_point_in_time(spark, d):
    return bars.universe(load(spark, d, "f6_master"), "1995-01-01", "1995-12-31").select("ts_code")


@query(
    "announcement_alignment",
    oracle(("f2b_supplier_panel", "f6_announcements"), """
, e AS (SELECT symbol, end_date, source_order, roe, CAST(greatest(ann_date, f_ann_date) AS TIMESTAMP) AS eff FROM f6_announcements),
s AS (SELECT e.*, b.timestamp AS first_bar FROM e ASOF JOIN f2b_supplier_panel b ON e.symbol = b.symbol AND e.eff <= b.timestamp),
v AS (SELECT * FROM s WHERE end_date <= CAST(first_bar AS DATE))
SELECT b.symbol, CAST(b.timestamp AS TIMESTAMP) AS timestamp, CAST(arg_max(v.end_date, row(v.end_date, v.eff, v.source_order)) AS DATE) AS report_period, arg_max(v.roe, row(v.end_date, v.eff, v.source_order)) AS roe
FROM f2b_supplier_panel b LEFT JOIN v ON v.symbol = b.symbol AND v.eff <= b.timestamp GROUP BY b.symbol, b.timestamp"""),
)
def announcement_alignment(spark, d):
    return asof.align_announcements(load(spark, d, "f2b_supplier_panel"), load(spark, d, "f6_announcements"), ["roe"]).select("symbol", "timestamp", "report_period", "roe")


@query("adjust_hfq", oracle("f6_adjusted_source", "SELECT ts_code, CAST(timestamp AS TIMESTAMP) AS timestamp, round(close * adj_factor, 4) AS close, round(low * adj_factor, 4) AS low FROM f6_adjusted_source"))
def adjust_hfq(spark, d):
    return rounded(bars.adjust(load(spark, d, "f6_adjusted_source"), "hfq").select("ts_code", "timestamp", "close", "low"), 4)


@query(
    "adjust_qfq_anchor",
    oracle("f6_adjusted_source", """
, a AS (SELECT ts_code, arg_max(adj_factor, timestamp) AS anchor FROM f6_adjusted_source WHERE timestamp <= TIMESTAMP '1999-06-01' GROUP BY ts_code)
SELECT ts_code, CAST(timestamp AS TIMESTAMP) AS timestamp, round(close * (adj_factor / anchor), 3) AS close FROM f6_adjusted_source JOIN a USING (ts_code) WHERE timestamp <= TIMESTAMP '1999-06-01'"""),
)
def adjust_qfq_anchor(spark, d):
    rows = load(spark, d, "f6_adjusted_source")
    at = F.lit("1999-06-01").cast("timestamp_ntz")
    return rounded(bars.adjust(rows.where(F.col("timestamp") <= at), "qfq", bars.anchor_factors(rows, at)).select("ts_code", "timestamp", "close"), 3)


@query(
    "segmentation_price_policy",
    oracle("f6_adjusted_source", """
, a AS (SELECT ts_code, adj_factor AS anchor FROM f6_adjusted_source WHERE timestamp = TIMESTAMP '1998-03-01')
SELECT ts_code, CAST(timestamp AS TIMESTAMP) AS timestamp, round(close * (adj_factor / anchor), 3) AS close FROM f6_adjusted_source JOIN a USING (ts_code) WHERE timestamp >= TIMESTAMP '1998-03-01'"""),
)
def segmentation_price_policy(spark, d):
    return rounded(bars.segmentation_prices(load(spark, d, "f6_adjusted_source"), "qfq", F.lit("1998-03-01").cast("timestamp_ntz")).select("ts_code", "timestamp", "close"), 3)


PANEL = """
, p AS (SELECT b.symbol, b.timestamp, b.close, b.high, CASE WHEN CAST(volume AS INT) % 9 = 0 THEN b.high ELSE b.low END AS low, CASE WHEN CAST(volume AS INT) % 31 = 0 THEN 0.0 ELSE volume END AS volume,
        CASE WHEN CAST(volume AS INT) % 5 <> 0 THEN CASE WHEN CAST(volume AS INT) % 9 = 0 THEN b.close ELSE b.close * 1.1 END END AS up_limit, CASE WHEN CAST(volume AS INT) % 5 <> 0 THEN b.close * 0.9 END AS down_limit,
        CASE WHEN CAST(volume AS INT) % 7 = 0 THEN NULL ELSE CAST(volume AS INT) % 11 = 0 END AS is_suspended FROM f2b_supplier_panel b)"""


def _panel(spark, d):
    load(spark, d, "f2b_supplier_panel").createOrReplaceTempView("_f2b")
    return spark.sql("WITH" + PANEL.strip().removeprefix(",").replace("f2b_supplier_panel", "_f2b") + " SELECT * FROM p")


@query(
    "tradability_screen",
    oracle("f2b_supplier_panel", PANEL + """
, q AS (SELECT *, is_suspended IS NOT NULL AND up_limit IS NOT NULL AND down_limit IS NOT NULL AS known,
        coalesce(high = low AND (abs(close - up_limit) <= 1e-8 + 1e-5 * abs(up_limit) OR abs(close - down_limit) <= 1e-8 + 1e-5 * abs(down_limit)), false) AS locked FROM p)
SELECT symbol, CAST(timestamp AS TIMESTAMP) AS timestamp, known AS tradability_known, locked AS one_price_locked, known AND NOT coalesce(is_suspended, true) AND volume > 0 AND NOT locked AS tradability_eligible FROM q"""),
)
def tradability_screen(spark, d):
    return asof.tradability(_panel(spark, d)).select("symbol", "timestamp", "tradability_known", "one_price_locked", "tradability_eligible")


@query(
    "missingness_report",
    oracle("f2b_supplier_panel", PANEL + """
SELECT * FROM (SELECT 'up_limit' AS column, avg(CASE WHEN up_limit IS NULL THEN 1.0 ELSE 0.0 END) AS share FROM p UNION ALL SELECT 'down_limit', avg(CASE WHEN down_limit IS NULL THEN 1.0 ELSE 0.0 END) FROM p
UNION ALL SELECT 'is_suspended', avg(CASE WHEN is_suspended IS NULL THEN 1.0 ELSE 0.0 END) FROM p) WHERE share > 0""").replace("AS column,", 'AS "column",').replace("SELECT * FROM (", 'SELECT "column", round(share, 9) AS share FROM ('),
)
def missingness_report(spark, d):
    return rounded(asof.missing_shares(_panel(spark, d)), 9)


@query(
    "universe_gaps",
    oracle("f2b_supplier_panel", """
SELECT CAST(x.timestamp AS TIMESTAMP) AS timestamp, count(*) AS missing FROM (SELECT DISTINCT symbol FROM f2b_supplier_panel) s CROSS JOIN (SELECT DISTINCT timestamp FROM f2b_supplier_panel) x
WHERE NOT EXISTS (SELECT 1 FROM f2b_supplier_panel b WHERE b.symbol = s.symbol AND b.timestamp = x.timestamp) GROUP BY x.timestamp"""),
)
def universe_gaps(spark, d):
    rows = load(spark, d, "f2b_supplier_panel").select("symbol", "timestamp")
    expected = rows.select("symbol").distinct().crossJoin(F.broadcast(rows.select("timestamp").distinct()))  # a row a session
    return asof.missing_keys(expected, rows)


@query(
    "source_coverage",
    oracle(("f2b_supplier_panel", "f6_membership"), """
SELECT count(*) AS bars, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM f6_membership m WHERE m.symbol = b.symbol AND m.in_date <= CAST(b.timestamp AS DATE) AND (m.out_date IS NULL OR m.out_date >= CAST(b.timestamp AS DATE)))) AS matched FROM f2b_supplier_panel b"""),
)
def source_coverage(spark, d):
    rows = asof.interval_membership(load(spark, d, "f2b_supplier_panel"), load(spark, d, "f6_membership"))
    return rows.agg(F.count(F.lit(1)).alias("bars"), F.count("industry_code").alias("matched"))


@query("date_chunks", "SELECT CAST(s AS DATE) AS chunk_start, least(CAST(s + INTERVAL 5 MONTH - INTERVAL 1 DAY AS DATE), DATE '2001-11-20') AS chunk_end FROM generate_series(TIMESTAMP '1995-01-15', TIMESTAMP '2001-11-20', INTERVAL 5 MONTH) t(s)")
def date_chunks(spark, d):
    return bars.date_chunks(spark, "1995-01-15", "2001-11-20", 5)


@query("trade_calendar", "SELECT DISTINCT o_orderdate AS cal_date FROM orders WHERE o_orderkey % 3 = 1")
def trade_calendar(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    return bars.trade_calendar(orders.select(F.col("o_orderdate").alias("cal_date"), (F.col("o_orderkey") % 3).alias("is_open")))


@query(
    "market_regime_proxy",
    oracle("f2b_supplier_panel", """
, r AS (SELECT timestamp, close / lag(close) OVER (PARTITION BY symbol ORDER BY timestamp) - 1 AS r FROM f2b_supplier_panel),
m AS (SELECT timestamp, median(r) AS m FROM r GROUP BY timestamp HAVING median(r) IS NOT NULL),
t AS (SELECT timestamp, m, CASE WHEN count(*) OVER w = 20 THEN product(1 + m) OVER w - 1 END AS tr, CASE WHEN count(*) OVER w = 20 THEN stddev_samp(m) OVER w * sqrt(252.0) END AS tv FROM m WINDOW w AS (ORDER BY timestamp ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT CAST(timestamp AS TIMESTAMP) AS timestamp, round(m, 8) AS sample_market_return, round(tr, 8) AS market_proxy_trailing_return, round(tv, 8) AS market_proxy_trailing_volatility,
       CASE WHEN tr IS NULL THEN 'UNKNOWN' WHEN tr > 0.05 THEN 'BULL_PROXY' WHEN tr < -0.05 THEN 'BEAR_PROXY' ELSE 'SIDEWAYS_PROXY' END AS market_proxy_regime FROM t"""),
)
def market_regime_proxy(spark, d):
    return rounded(indicators.market_regimes(load(spark, d, "f2b_supplier_panel")), 8)


@query(
    "fractal_pivots",
    oracle("f1_event_bars", TR + """
, f AS (SELECT t.symbol, t.idx, a.atr, high, low, count(*) OVER (PARTITION BY t.symbol) AS n,
        greatest(max(high) OVER b, max(high) OVER c) AS nh, least(min(low) OVER b, min(low) OVER c) AS nl FROM t JOIN a USING (symbol, idx)
        WINDOW b AS (PARTITION BY t.symbol ORDER BY t.idx ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), c AS (PARTITION BY t.symbol ORDER BY t.idx ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)),
g AS (SELECT symbol, idx, greatest((high - nh) / greatest(atr, 1e-12), (nl - low) / greatest(atr, 1e-12)) AS p FROM f WHERE idx >= 2 AND idx < n - 2)
SELECT symbol, idx, round(p, 6) AS prominence, round(least(0.82, greatest(0.40, 0.38 + 0.18 * p)), 6) AS probability FROM g WHERE p >= 0.35""", recursive=True),
)
def fractal_pivots(spark, d):
    return rounded(indicators.fractal_pivots(load(spark, d, "f1_event_bars")))


@query(
    "structure_scores",
    oracle("f1_event_bars", """
, b AS (SELECT symbol, close, high, low, volume, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY symbol) AS n,
        coalesce(ln(greatest(close, 1e-12)) - lag(ln(greatest(close, 1e-12))) OVER w, 0) AS s0 FROM f1_event_bars WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)),
u AS (SELECT symbol, idx, n, greatest(4, CAST(floor(sqrt(n)) AS INT)) AS k, unnest([0, 1, 2, 3]) AS sig, unnest([s0, abs(s0), coalesce((high - low) / nullif(close, 0), 0), ln(1 + greatest(volume, 0))]) AS v FROM b),
m AS (SELECT symbol, sig, median(v) AS mid FROM u GROUP BY ALL), e AS (SELECT u.symbol, u.sig, median(abs(v - mid)) * 1.4826 + 1e-9 AS unit FROM u JOIN m USING (symbol, sig) GROUP BY ALL),
c AS (SELECT *, sum(v) OVER (PARTITION BY symbol, sig ORDER BY idx) AS cs FROM u),
x AS (SELECT a.symbol, a.idx, abs(((h.cs - a.cs) - (p.cs - coalesce(q.cs, 0))) / a.k) / e.unit AS shift FROM c a JOIN e USING (symbol, sig)
      JOIN c h ON h.symbol = a.symbol AND h.sig = a.sig AND h.idx = a.idx + a.k JOIN c p ON p.symbol = a.symbol AND p.sig = a.sig AND p.idx = a.idx - 1 LEFT JOIN c q ON q.symbol = a.symbol AND q.sig = a.sig AND q.idx = a.idx - a.k - 1
      WHERE a.n >= 2 * a.k + 1 AND a.idx >= a.k AND a.idx < a.n - a.k)
SELECT symbol, CAST(idx AS INT) AS idx, round(max(shift), 4) AS score FROM x GROUP BY symbol, idx"""),
)
def structure_scores(spark, d):
    return rounded(indicators.structure_scores(load(spark, d, "f1_event_bars")).where("score > 0"), 4)


@query(
    "exact_day_metadata",
    oracle(("f2b_supplier_panel", "f6_adjusted_source"), """
SELECT b.symbol, CAST(b.timestamp AS TIMESTAMP) AS timestamp, m.adj_factor AS meta_adj_factor FROM f2b_supplier_panel b LEFT JOIN (SELECT * FROM f6_adjusted_source WHERE month(timestamp) % 4 <> 0) m ON m.ts_code = b.symbol AND CAST(m.timestamp AS DATE) = CAST(b.timestamp AS DATE)"""),
)
def exact_day_metadata(spark, d):
    meta = load(spark, d, "f6_adjusted_source").withColumnRenamed("ts_code", "symbol").where(F.month("timestamp") % 4 != 0)
    return asof.exact_day(load(spark, d, "f2b_supplier_panel"), meta, ["adj_factor"], prefix="meta_").select("symbol", "timestamp", "meta_adj_factor")


@query(
    "suspension_tristate",
    oracle("f2b_supplier_panel", """
, e AS (SELECT symbol, timestamp FROM f2b_supplier_panel WHERE CAST(volume AS INT) % 13 = 0 AND month(timestamp) <> 6)
SELECT b.symbol, CAST(b.timestamp AS TIMESTAMP) AS timestamp, CASE WHEN e.symbol IS NOT NULL THEN true WHEN month(b.timestamp) <> 6 THEN false END AS is_suspended FROM f2b_supplier_panel b LEFT JOIN e ON e.symbol = b.symbol AND e.timestamp = b.timestamp"""),
)
def suspension_tristate(spark, d):
    rows = load(spark, d, "f2b_supplier_panel")
    covered = rows.where(F.month("timestamp") != 6)
    return asof.suspended(rows, covered.where(F.col("volume").cast("int") % 13 == 0), covered).select("symbol", "timestamp", "is_suspended")


@query("interval_overlaps")
def interval_overlaps(spark, d):
    """All fixed segments against all causal ones of the same bars; held to brute force in the tests."""
    from ..operators.segments import segment_causal

    rows = load(spark, d, "f3_fixed_segments").withColumnsRenamed({"start_ts": "start", "end_ts": "end"}).select("segment_id", "symbol", "start", "end")
    return asof.overlapping(rows, segment_causal(load(spark, d, "f1_event_bars")).select("symbol", "start", "end")).select("segment_id")
