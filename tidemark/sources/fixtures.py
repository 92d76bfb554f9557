"""Tables that stand for market data, derived from the driver's tables by SQL that runs alike on Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name: (names it builds on, SQL).
FIXTURES: dict[str, tuple[tuple[str, ...], str]] = {
    "f1_event_bars": (
        (),
        """
WITH walk AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS timestamp, event_id, value,
         CAST(10000000 + sum(CAST(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * round(value * 100) AS BIGINT))
              OVER (PARTITION BY event_type ORDER BY ts, event_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS px,
         row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn
  FROM events)
SELECT symbol, timestamp,
       CAST(min_by(px, rn) AS DOUBLE) AS open, CAST(max(px) AS DOUBLE) AS high,
       CAST(min(px) AS DOUBLE) AS low, CAST(max_by(px, rn) AS DOUBLE) AS close,
       CAST(count(*) AS DOUBLE) AS volume
FROM walk GROUP BY symbol, timestamp
""",
    ),
    "f2_ship_bars": (
        (),
        """
WITH w AS (
  SELECT concat(l_returnflag, l_linestatus) AS symbol, l_shipdate AS timestamp, l_quantity,
         CASE WHEN l_partkey % 2 = 0 THEN 1 ELSE -1 END * CAST(round(l_extendedprice * 100) AS BIGINT) AS step,
         row_number() OVER (PARTITION BY l_returnflag, l_linestatus
            ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn
  FROM lineitem),
walk AS (
  SELECT symbol, timestamp, l_quantity, rn,
         CAST(10000000000 + sum(step) OVER (PARTITION BY symbol ORDER BY rn
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS px FROM w)
SELECT symbol, timestamp,
       CAST(min_by(px, rn) AS DOUBLE) AS open, CAST(max(px) AS DOUBLE) AS high,
       CAST(min(px) AS DOUBLE) AS low, CAST(max_by(px, rn) AS DOUBLE) AS close,
       sum(l_quantity) AS volume
FROM walk GROUP BY symbol, timestamp
""",
    ),
    "f2b_supplier_panel": (
        (),
        """
WITH w AS (
  SELECT l_suppkey, date_trunc('month', l_shipdate) AS timestamp, l_quantity,
         CASE WHEN l_partkey % 2 = 0 THEN 1 ELSE -1 END * CAST(round(l_extendedprice * 100) AS BIGINT) AS step,
         row_number() OVER (PARTITION BY l_suppkey
            ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_returnflag, l_linestatus) AS rn
  FROM lineitem),
walk AS (
  SELECT l_suppkey, timestamp, l_quantity, rn,
         CAST(10000000000 + sum(step) OVER (PARTITION BY l_suppkey ORDER BY rn
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS px FROM w)
SELECT s.s_name AS symbol, walk.timestamp, CAST(max(px) AS DOUBLE) AS high, CAST(min(px) AS DOUBLE) AS low,
       CAST(max_by(px, rn) AS DOUBLE) AS close, sum(l_quantity) AS volume,
       max(n.n_name) AS nation, max(r.r_name) AS industry, max(s.s_acctbal) AS market_cap
FROM walk JOIN supplier s ON s.s_suppkey = walk.l_suppkey
          JOIN nation n ON n.n_nationkey = s.s_nationkey
          JOIN region r ON r.r_regionkey = n.n_regionkey
GROUP BY s.s_name, walk.timestamp
""",
    ),
    "f3_fixed_segments": (
        ('f1_event_bars',),
        """
WITH b AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY timestamp) - 1 AS INT) AS idx,
                  CAST(count(*) OVER (PARTITION BY symbol) AS INT) AS n FROM f1_event_bars),
e AS (SELECT * FROM b WHERE idx % 12 = 0 OR idx = n - 1),
p AS (SELECT symbol, idx AS start_idx, timestamp AS start_ts, close AS c0,
             lead(idx) OVER w AS end_idx, lead(timestamp) OVER w AS end_ts, lead(close) OVER w AS c1,
             CAST(row_number() OVER w - 1 AS INT) AS segment_no FROM e
      WINDOW w AS (PARTITION BY symbol ORDER BY idx))
SELECT concat(symbol, ':', CAST(segment_no AS STRING)) AS segment_id, symbol, segment_no, start_idx, end_idx,
       start_ts, end_ts, end_idx - start_idx + 1 AS n_bars,
       CASE WHEN segment_no % 7 = 3 THEN 'UNKNOWN' WHEN c1 > c0 THEN 'CLUSTER_A' ELSE 'CLUSTER_B' END AS label
FROM p WHERE end_idx IS NOT NULL
""",
    ),
    "f4_states": (
        ('f3_fixed_segments',),
        """
SELECT segment_id, symbol, start_idx, end_idx, n_bars, label, end_ts AS available_at,
       CAST(1 + (segment_no * 37) % 50 AS DOUBLE) / (CAST(1 + (segment_no * 37) % 50 AS DOUBLE) + CAST(1 + (segment_no * 61) % 50 AS DOUBLE)) AS prob_CLUSTER_A,
       CAST(1 + (segment_no * 61) % 50 AS DOUBLE) / (CAST(1 + (segment_no * 37) % 50 AS DOUBLE) + CAST(1 + (segment_no * 61) % 50 AS DOUBLE)) AS prob_CLUSTER_B,
       CAST((segment_no * 13) % 100 AS DOUBLE) / 100 AS boundary_uncertainty,
       CASE WHEN segment_no < 20 THEN 'V1' ELSE 'V2' END AS model_version
FROM f3_fixed_segments
""",
    ),
    "f7_annotations": (
        (),
        """
SELECT CAST(doc_id AS STRING) AS segment_id, 'r1' AS annotator, quality AS label, CASE WHEN doc_id % 2 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS sampling_probability,
       doc_id % 50 AS start_idx FROM labels
UNION ALL SELECT CAST(doc_id AS STRING), 'r2', CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END, CASE WHEN doc_id % 2 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END, doc_id % 50 + doc_id % 6 FROM labels
UNION ALL SELECT CAST(doc_id AS STRING), 'r3', CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END, CASE WHEN doc_id % 2 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END, doc_id % 50 + doc_id % 4 FROM labels WHERE doc_id % 3 <> 0
""",
    ),
    "f7_scored": (
        (),
        """
SELECT d.doc_id AS row_id, CASE WHEN l.quality = 1 THEN 'GOOD' ELSE 'BAD' END AS truth,
       CAST(5 + (d.n_chars * 7 + d.doc_id * 11) % 90 AS DOUBLE) / 100 AS p_good
FROM labels l JOIN documents d ON d.doc_id = l.doc_id
""",
    ),
    "f6_master": (
        (),
        """
SELECT s_name AS ts_code, DATE '1994-06-01' + CAST((s_suppkey * 17) % 700 AS INT) AS list_date,
       CASE WHEN s_suppkey % 9 = 0 THEN DATE '1999-01-01' + CAST((s_suppkey * 31) % 500 AS INT) END AS delist_date
FROM supplier
""",
    ),
    "f6_membership": (
        (),
        """
SELECT s_name AS symbol, DATE '1994-01-01' AS in_date, DATE '1998-06-30' AS out_date, concat('L', CAST(s_nationkey AS STRING)) AS l1_code FROM supplier
UNION ALL
SELECT s_name, DATE '1998-01-01' + CAST((s_suppkey * 7) % 365 AS INT), CAST(NULL AS DATE), concat('M', CAST(s_nationkey % 6 AS STRING)) FROM supplier
""",
    ),
    "f6_announcements": (
        (),
        """
SELECT s.s_name AS symbol, CAST(date_trunc('month', o.o_orderdate) AS DATE) AS end_date,
       CAST(date_trunc('month', o.o_orderdate) AS DATE) + CAST(20 + o.o_orderkey % 40 AS INT) AS ann_date,
       CASE WHEN o.o_orderkey % 4 <> 0 THEN CAST(date_trunc('month', o.o_orderdate) AS DATE) + CAST(25 + o.o_orderkey % 60 AS INT) END AS f_ann_date,
       o.o_orderkey AS source_order, o.o_totalprice AS roe
FROM orders o JOIN supplier s ON s.s_suppkey = o.o_custkey % 100
""",
    ),
    "f6_adjusted_source": (
        ('f2b_supplier_panel',),
        """
SELECT symbol AS ts_code, timestamp, close, low, volume,
       CAST(1 + (CAST(row_number() OVER (PARTITION BY symbol ORDER BY timestamp) AS INT) * 3) % 40 AS DOUBLE) / 10 AS adj_factor
FROM f2b_supplier_panel
""",
    ),
    # bars as they might arrive: gaps, repeats that came later, vendor names
    "f1_raw": (
        ("f1_event_bars",),
        """
WITH b AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY timestamp) - 1 AS INT) AS idx FROM f1_event_bars)
SELECT symbol AS ts_code, timestamp AS trade_date, open, high, low, CASE WHEN idx % 13 = 0 THEN NULL ELSE close END AS close, volume AS vol, 0 AS ord FROM b
UNION ALL SELECT symbol, timestamp, open + 1, high + 1, low, close, CASE WHEN idx % 2 = 0 THEN NULL ELSE volume + 5 END, 1 FROM b WHERE idx % 11 = 0
""",
    ),
    # each panel symbol's market context is its industry's daily mean
    "f2c_context": (
        ("f2b_supplier_panel",),
        """
SELECT industry AS symbol, timestamp, CAST(sum(floor(close / 1000000)) AS DOUBLE) AS close FROM f2b_supplier_panel GROUP BY industry, timestamp
""",
    ),
    "f2_panel": (
        ("f2b_supplier_panel",),
        """
SELECT symbol, CAST(timestamp AS TIMESTAMP) AS timestamp, high, low, close, volume, industry, market_cap,
       CAST((CAST(substr(symbol, 10) AS INT) * 37 + CAST(extract(month FROM timestamp) AS INT) * 101 + CAST(extract(year FROM timestamp) AS INT) * 13) % 1000 AS DOUBLE) AS signal
FROM f2b_supplier_panel
""",
    ),
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _order(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for n in names:
        out += [x for x in (*_order(FIXTURES[n][0]), n) if x not in out]
    return out


def ctes(*names: str) -> str:
    """"name AS (...), ..." of the tables and what they build on."""
    return ",\n".join(f"{n} AS ({FIXTURES[n][1].strip()})" for n in _order(names))


def oracle(names: tuple[str, ...] | str, body: str, recursive: bool = False) -> str:
    """DuckDB SQL: body over the tables. body may begin with more CTEs, as ', name AS (...) SELECT ...'."""
    names = (names,) if isinstance(names, str) else names
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes(*names)}\n{body.strip()}"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a DataFrame with timestamp_ntz times."""
    text = f"WITH {ctes(name)} SELECT * FROM {name}"
    text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", lambda m: f"{m[1]} parquet.`{sf_dir}/{m[2]}.parquet`", text)
    df = spark.sql(text)
    return df.withColumns({f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema if f.dataType.simpleString() == "timestamp"})
