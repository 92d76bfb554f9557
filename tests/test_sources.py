"""Files, builders and streams in temporary folders."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import labels, segments
from tidemark.sources import files, vendor
from tidemark.sources.fixtures import load
from tidemark.streaming import causal


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("A", "2020-01-01", 1.0, 2.0, 0.5, 1.5, 3.0), ("B", "2020-01-01", 1.0, 2.0, 0.5, 1.5, 3.0)], "symbol string, timestamp string, open double, high double, low double, close double, volume double")
    df.write.csv(str(tmp_path / "x.csv"), header=True)
    assert files.read_bars(spark, str(tmp_path / "x.csv")).count() == 2
    with pytest.raises(ValueError, match="unknown file type"):
        files.read_table(spark, "a.xlsx")
    files.write_buckets(df, str(tmp_path / "buckets"), 8)
    assert [r.symbol for r in files.read_symbol(spark, str(tmp_path / "buckets"), "B", 8).collect()] == ["B"]
    files.write_json(spark, str(tmp_path / "m.json"), {"a": 1})
    files.write_json(spark, str(tmp_path / "m.json"), {"a": 2})
    assert files.read_json(spark, str(tmp_path / "m.json")) == {"a": 2} == json.loads((tmp_path / "m.json").read_text())


def test_chunked_builder_resumes(spark, tmp_path):
    down = tmp_path / "down"
    down.touch()
    where, calls = str(down), str(tmp_path / "calls")

    def fetch(symbol, start, end):
        import os

        with open(calls, "a") as f:
            f.write(f"{symbol} {start}\n")
        if symbol == "B" and os.path.exists(where):
            raise RuntimeError("down")
        return pd.DataFrame({"day": [start], "close": [1.0]})

    b = vendor.ChunkedBuilder(spark, str(tmp_path / "out"), fetch, "symbol string, day string, close double", months=6, pause=0)
    symbols = spark.createDataFrame([("A",), ("B",)], "symbol string")
    first = {(r.symbol, r.status) for r in b.build(symbols, "2020-01-01", "2020-12-31").collect()}
    assert first == {("A", "complete"), ("B", "failed")} and b.load().count() == 2
    down.unlink()
    b.build(symbols, "2020-01-01", "2020-12-31")
    assert b.load().count() == 4
    assert sum(line.startswith("A") for line in open(calls)) == 2


class Client:
    """Three days; the first call fails once, limits are missing on one day, factors on another."""

    def __init__(self):
        self.broken = True
        self.asked = []

    def trade_cal(self, start_date, end_date):
        return pd.DataFrame({"cal_date": ["20200101", "20200102", "20200103", "20200104"], "is_open": ["1", "1", "1", "0"]})

    def daily(self, trade_date):
        self.asked.append(trade_date)
        if self.broken:
            self.broken = False
            raise OSError("once")
        return pd.DataFrame({"ts_code": ["A", "B"], "trade_date": trade_date, "close": [10.0, 20.0]})

    def adj_factor(self, trade_date):
        n = 0 if trade_date == "20200103" else 2
        return pd.DataFrame({"ts_code": ["A", "B"][:n], "trade_date": [trade_date] * n, "adj_factor": [2.0, 4.0][:n]})

    def daily_basic(self, trade_date):
        return pd.DataFrame({"ts_code": ["A"], "trade_date": [trade_date], "close": [9.0], "total_mv": [5.0]})

    def stk_limit(self, trade_date):
        raise OSError("no such endpoint")

    def suspend_d(self, trade_date):
        if trade_date == "20200102":
            raise OSError("down")
        return pd.DataFrame({"ts_code": ["B"], "trade_date": [trade_date]})


def test_daily_builder(spark, tmp_path):
    client = Client()
    b = vendor.DailyBuilder(spark, client, str(tmp_path / "d"), pause=0)
    m = b.build("20200101", "20200104", max_dates=1)
    assert m["dates"]["20200101"]["status"] == "complete" and not m["build_complete"]
    m = b.build("20200101", "20200104")
    assert m["dates"]["20200103"]["status"] == "incomplete" and m["dates"]["20200102"]["endpoints"]["stk_limit"]["status"] == "failed"
    assert client.asked.count("20200101") == 2
    rows = {(str(r.timestamp.date()), r.ts_code): r for r in vendor.load_daily(spark, str(tmp_path / "d"), "hfq").collect()}
    assert rows["2020-01-01", "A"].close == 20.0 and rows["2020-01-01", "B"].is_suspended is True and rows["2020-01-01", "A"].is_suspended is False
    assert rows["2020-01-02", "B"].is_suspended is None and rows["2020-01-01", "A"].total_mv == 5.0
    assert {r.close for r in vendor.load_daily(spark, str(tmp_path / "d"), "qfq", "20200101").collect()} == {10.0, 20.0}


def test_data_source(spark):
    vendor.register(spark, "vendor_bars", lambda s, a, b: pd.DataFrame({"symbol": [s], "close": [float(len(a))]}), "symbol string, close double")
    out = spark.read.format("vendor_bars").option("symbols", "A,B").option("start", "2020").load()
    assert sorted((r.symbol, r.close) for r in out.collect()) == [("A", 4.0), ("B", 4.0)]


def test_token(monkeypatch):
    monkeypatch.setenv("VENDOR_TOKEN", "t")
    assert vendor.resolve_token() == "t"
    monkeypatch.delenv("VENDOR_TOKEN")
    with pytest.raises(ValueError):
        vendor.resolve_token()


def test_stream_equals_batch(spark, tiny, tmp_path):
    bars = load(spark, tiny, "f1_event_bars").cache()
    edges = [0.0, 0.3, 0.7, 1.0]
    lo, hi = bars.agg(F.min("timestamp").cast("timestamp"), F.max("timestamp").cast("timestamp")).first()
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        t = F.col("timestamp").cast("timestamp").cast("double")
        span = hi.timestamp() - lo.timestamp()
        zone = bars.agg(F.min(F.col("timestamp").cast("timestamp").cast("double"))).first()[0]
        part = bars.where((t >= zone + a * span) & (t < zone + b * span + (1 if b == 1.0 else 0)))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = spark.readStream.schema(bars.schema).parquet(str(tmp_path / "in"))
        q = causal.stream_causal_segments(out).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).start(str(tmp_path / "out"))
        q.processAllAvailable()
        q.stop()
    got = spark.read.parquet(str(tmp_path / "out")).toPandas().sort_values("segment_id").reset_index(drop=True)
    want = segments.segment_causal(bars).toPandas().sort_values("segment_id").reset_index(drop=True)
    assert len(want) and got[want.columns].astype(str).equals(want.astype(str))


def test_stream_dwell_equals_batch(spark, tiny, tmp_path):
    rows = load(spark, tiny, "f4_states")
    want = {r.segment_id: r.causal_duration_label for r in labels.dwell_filter(rows, 20).collect()}
    for k in range(2):
        n = F.split("segment_id", ":")[1].cast("int")
        rows.where((n >= 7) if k else (n < 7)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = causal.stream_dwell(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), 20).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).start(str(tmp_path / "out"))
        q.processAllAvailable()
        q.stop()
    assert {r.segment_id: r.causal_duration_label for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want
