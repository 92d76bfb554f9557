"""Vendor data through injected clients: fetches as a data source, resumable chunked and daily builders.

A fetcher is fetch(symbol, start, end) -> pandas frame. Calls run on executors, one partition a (symbol, chunk), with
retries and growing pauses; failures are rows of the manifest and do not fail the job. Nothing here opens the network.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars as B
from . import files

#: Environment names of an access token, first found wins; the token is never written anywhere (fixed values).
TOKEN_NAMES = ("VENDOR_TOKEN", "MARKET_DATA_TOKEN")


def resolve_token(given: str | None = None, names: Iterable[str] = TOKEN_NAMES) -> str:
    token = given or next((os.environ[n] for n in names if os.environ.get(n)), None)
    if not token:
        raise ValueError(f"no token: set one of {list(names)}")
    return token


def with_retries(call: Callable, tries: int = 3, pause: float = 1.0):
    for k in range(tries):
        try:
            return call()
        except Exception:  # noqa: BLE001 - a client may raise anything
            if k == tries - 1:
                raise
            time.sleep(pause * (k + 1))


def register(spark: SparkSession, name: str, fetch: Callable[[str, str, str], pd.DataFrame], schema: str) -> None:
    """spark.read.format(name).option("symbols", "A,B").option("start", ...).option("end", ...).load()"""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class One(InputPartition):
        def __init__(self, symbol: str):
            self.symbol = symbol

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.options = options

        def partitions(self):
            return [One(s.strip()) for s in self.options.get("symbols", "").split(",") if s.strip()]

        def read(self, partition):
            rows = with_retries(lambda: fetch(partition.symbol, self.options.get("start", ""), self.options.get("end", "")), pause=float(self.options.get("pause", "1")))
            yield from rows.itertuples(index=False, name=None)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader(self.options)

    spark.dataSource.register(Source)


#: Listing states that make a universe without survivors' bias (fixed values).
LISTING_STATES = ("L", "D", "P")


def _frames(spark: SparkSession, calls: list[Callable[[], pd.DataFrame]], tries: int, pause: float) -> DataFrame | None:
    """All rows of the calls that gave any, in order of the calls and rows (column _place); columns by name. Calls are few:
    one a listing state, code or symbol asked for."""
    got = [rows for rows in (with_retries(c, tries, pause) for c in calls) if rows is not None and len(rows)]
    if not got:
        return None
    rows = pd.concat(got, ignore_index=True).reset_index(names="_place")
    return spark.createDataFrame(rows.astype(object).where(rows.notna(), None))


def fetch_securities(spark: SparkSession, client, *, tries: int = 3, pause: float = 1.0) -> DataFrame:
    """Listed, delisted and paused securities, a row each: of a code under several states the first in LISTING_STATES stays.
    The code is symbol, the vendor's own symbol local_symbol."""
    rows = _frames(spark, [lambda s=s: client.stock_basic(exchange="", list_status=s) for s in LISTING_STATES], tries, pause)
    if rows is None:
        raise RuntimeError("no securities were given")
    rows = rows.withColumnsRenamed({"symbol": "local_symbol"}).withColumnRenamed("ts_code", "symbol")
    rest = [c for c in rows.columns if c not in ("symbol", "_place")]
    return rows.groupBy("symbol").agg(F.min_by(F.struct(*rest), "_place").alias("_r")).select("symbol", "_r.*")


def fetch_membership(spark: SparkSession, client, codes: Iterable[str] | None = None, *, symbols: Iterable[str] | None = None, tries: int = 3, pause: float = 1.0) -> DataFrame | None:
    """Distinct membership intervals of industry codes, or of symbols, or (neither given) in one call; None without rows."""
    if codes is not None and symbols is not None:
        raise ValueError("give codes or symbols, not both")
    asked = [{"l1_code": c} for c in codes] if codes is not None else [{"ts_code": s} for s in symbols] if symbols is not None else [{}]
    rows = _frames(spark, [lambda a=a: client.index_member_all(**a) for a in asked], tries, pause)
    return None if rows is None else rows.drop("_place").distinct()


def fetch_index(spark: SparkSession, client, symbol: str, start: str, end: str, *, tries: int = 3, pause: float = 1.0) -> DataFrame:
    """Normalised bars of an index, as market context."""
    rows = _frames(spark, [lambda: client.index_daily(ts_code=symbol, start_date=start.replace("-", ""), end_date=end.replace("-", ""))], tries, pause)
    if rows is None:
        raise RuntimeError(f"no rows for {symbol}")
    return B.normalize(rows, "_place").drop("_place")


def fetch_metadata(spark: SparkSession, client, endpoint: str, symbols: Iterable[str], start: str, end: str, *, tries: int = 3, pause: float = 1.0, **more) -> DataFrame | None:
    """Rows of a per-symbol endpoint for each symbol, with (symbol, timestamp) keys, the last of equal keys kept."""
    ask = {"start_date": start.replace("-", ""), "end_date": end.replace("-", ""), **more}
    rows = _frames(spark, [lambda s=s: getattr(client, endpoint)(ts_code=s, **ask) for s in symbols], tries, pause)
    if rows is None:
        return None
    rows = rows.withColumnsRenamed({k: v for k, v in B.ALIASES.items() if k in rows.columns})
    rows = rows.withColumn("timestamp", B.as_timestamp(rows, "timestamp"))
    rest = [c for c in rows.columns if c not in ("symbol", "timestamp", "_place")]
    return rows.groupBy("symbol", "timestamp").agg(F.max_by(F.struct(*rest), "_place").alias("_r")).select("symbol", "timestamp", "_r.*")


class ChunkedBuilder:
    """Resumable download of symbols by date chunks into path/data (partitioned by symbol and chunk) with path/manifest."""

    def __init__(self, spark: SparkSession, path: str, fetch: Callable[[str, str, str], pd.DataFrame], schema: str, *, months: int = 12, tries: int = 3, pause: float = 1.0):
        self.spark, self.path, self.fetch, self.schema, self.months, self.tries, self.pause = spark, path.rstrip("/"), fetch, schema, months, tries, pause

    def manifest(self) -> DataFrame | None:
        p = f"{self.path}/manifest"
        return self.spark.read.parquet(p) if files.exists(self.spark, p) else None

    def pending(self, symbols: DataFrame, start: str, end: str) -> DataFrame:
        chunks = B.date_chunks(self.spark, start, end, self.months)
        jobs = symbols.select("symbol").distinct().crossJoin(F.broadcast(chunks))  # chunks are a handful of dates
        done = self.manifest()
        if done is None:
            return jobs
        return jobs.join(done.where("status = 'complete'").select("symbol", "chunk_start", "chunk_end").distinct(), ["symbol", "chunk_start", "chunk_end"], "left_anti")

    def build(self, symbols: DataFrame, start: str, end: str) -> DataFrame:
        """Fetch what is missing; the manifest after it. A chunk's folder is replaced as a whole, so a rerun is harmless."""
        fetch, tries, pause = self.fetch, self.tries, self.pause
        names = [c.strip().split()[0] for c in self.schema.split(",")]

        def run(batches):
            for pdf in batches:
                for job in pdf.itertuples(index=False):
                    try:
                        rows = with_retries(lambda j=job: fetch(j.symbol, str(j.chunk_start), str(j.chunk_end)), tries, pause)
                        rows = rows[[n for n in names if n != "symbol"]].assign(error=None)
                    except Exception as e:  # noqa: BLE001 - told in the manifest
                        rows = pd.DataFrame([{"error": f"{type(e).__name__}: {e}"[:500]}])
                    if not len(rows):
                        rows = pd.DataFrame([{"error": ""}])
                    rows = rows.assign(symbol=job.symbol, chunk_start=job.chunk_start, chunk_end=job.chunk_end).reindex(columns=[*names, "chunk_start", "chunk_end", "error"])
                    yield rows.astype(object).where(rows.notna(), None)

        jobs = self.pending(symbols, start, end).repartition("symbol", "chunk_start")
        got = jobs.mapInPandas(run, f"{self.schema}, chunk_start date, chunk_end date, error string").persist()
        key = ["symbol", "chunk_start", "chunk_end"]
        got.where("error IS NULL").drop("error").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "chunk_start").parquet(f"{self.path}/data")
        log = got.groupBy(*key).agg(F.count_if(F.col("error").isNull()).alias("rows"), F.max(F.nullif(F.col("error"), F.lit(""))).alias("error"))
        log.withColumn("status", F.when(F.col("error").isNull(), "complete").otherwise("failed")).withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{self.path}/manifest")
        got.unpersist()
        return self.manifest()

    def load(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/data")


#: Endpoints of a trading day: those that have to be there, and those that may fail (fixed values).
REQUIRED, OPTIONAL = ("daily", "adj_factor"), ("daily_basic", "stk_limit", "suspend_d")


class DailyBuilder:
    """Resumable build of one partition a trading day from a client with methods daily, adj_factor, daily_basic, stk_limit
    and suspend_d(trade_date=...) and trade_cal(start_date=..., end_date=...), each a pandas frame."""

    def __init__(self, spark: SparkSession, client, path: str, *, row_limit: int = 6000, tries: int = 3, pause: float = 1.0, optional: Sequence[str] = OPTIONAL, master: DataFrame | None = None):
        self.spark, self.client, self.path, self.row_limit, self.tries, self.pause, self.optional, self.master = spark, client, path.rstrip("/"), row_limit, tries, pause, tuple(optional), master

    @property
    def manifest_path(self) -> str:
        return f"{self.path}/manifest.json"

    def calendar(self, start: str, end: str) -> list[str]:
        rows = with_retries(lambda: self.client.trade_cal(start_date=start, end_date=end), self.tries, self.pause)
        return sorted({str(d) for d, o in zip(rows["cal_date"], rows["is_open"], strict=True) if str(o) == "1"})

    def day(self, date: str) -> tuple[DataFrame | None, dict]:
        """The joined rows of a day and what each endpoint said."""
        got, told = {}, {}
        for name in (*REQUIRED, *self.optional):
            try:
                rows = with_retries(lambda n=name: getattr(self.client, n)(trade_date=date), self.tries, self.pause)
                got[name], told[name] = rows, {"status": "complete", "rows": len(rows), "truncated": len(rows) >= self.row_limit}
            except Exception as e:  # noqa: BLE001 - told in the manifest
                told[name] = {"status": "failed", "error": f"{type(e).__name__}: {e}"[:500]}
        if any(told[n]["status"] != "complete" or not len(got[n]) for n in REQUIRED):
            return None, {"status": "incomplete", "endpoints": told}
        frame = lambda n: self.spark.createDataFrame(got[n].astype({"ts_code": str, "trade_date": str}))
        out = frame("daily")
        key = ["ts_code", "trade_date"]
        for n in ("adj_factor", "daily_basic", "stk_limit"):
            if n in got and len(got[n]):
                new = [c for c in got[n].columns if c not in (*key, *out.columns)]
                out = out.join(frame(n).select(*key, *new).dropDuplicates(key), key, "left")
        if "suspend_d" not in got:  # not known is not false
            out = out.withColumn("is_suspended", F.lit(None).cast("boolean"))
        elif not len(got["suspend_d"]):
            out = out.withColumn("is_suspended", F.lit(False))
        else:
            out = out.join(frame("suspend_d").select(*key, F.lit(True).alias("is_suspended")).distinct(), key, "left").withColumn("is_suspended", F.coalesce("is_suspended", F.lit(False)))
        if self.master is not None:
            m = self.master.select(F.col("ts_code").alias("_c"), "list_date", "delist_date")
            d = F.to_date("trade_date", "yyyyMMdd")
            out = out.join(m, (F.col("ts_code") == F.col("_c")) & (F.col("list_date") <= d) & (F.col("delist_date").isNull() | (F.col("delist_date") >= d)), "left_semi")
        return out, {"status": "complete", "endpoints": told}

    def build(self, start: str, end: str, max_dates: int | None = None, progress: Callable[[str, dict], None] | None = None) -> dict:
        """The manifest after the missing days (at most max_dates) were fetched. Days are fetched in turn on the driver, as
        a vendor's limit is by account; each is its own folder, replaced as a whole."""
        manifest = files.read_json(self.spark, self.manifest_path, {"dates": {}})
        days = self.calendar(start, end)
        todo = [d for d in days if manifest["dates"].get(d, {}).get("status") != "complete"]
        for date in todo[:max_dates]:
            rows, told = self.day(date)
            if rows is not None:
                rows = rows.persist()
                told["rows"] = rows.count()
                rows.drop("trade_date").write.mode("overwrite").parquet(f"{self.path}/data/trade_date={date}")
                rows.unpersist()
            manifest["dates"][date] = told
            manifest["build_complete"] = all(manifest["dates"].get(d, {}).get("status") == "complete" for d in days)
            files.write_json(self.spark, self.manifest_path, manifest)
            if progress:
                progress(date, told)
        return manifest


def load_daily(spark: SparkSession, path: str, adjustment: str = "raw", anchor: str | None = None) -> DataFrame:
    """Complete days up to the anchor (yyyymmdd), adjusted; qfq by each code's last known factor up to it."""
    manifest = files.read_json(spark, f"{path.rstrip('/')}/manifest.json", {"dates": {}})
    days = [d for d, told in manifest["dates"].items() if told.get("status") == "complete" and (anchor is None or d <= anchor)]
    if not days:
        raise ValueError("no complete day")
    df = spark.read.option("basePath", f"{path.rstrip('/')}/data").parquet(*[f"{path.rstrip('/')}/data/trade_date={d}" for d in sorted(days)])
    df = df.withColumn("timestamp", F.to_date(F.col("trade_date").cast("string"), "yyyyMMdd").cast("timestamp_ntz")).drop("trade_date")
    if adjustment == "qfq":
        if anchor is None:
            raise ValueError("qfq needs an anchor")
        return B.adjust(df, "qfq", B.anchor_factors(df, F.to_date(F.lit(anchor), "yyyyMMdd").cast("timestamp_ntz")))
    return B.adjust(df, adjustment)
