"""Files: bars by suffix, bucketed tables, JSON documents through the table's own file system."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bars import normalize


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file or folder, or CSV with a header, by suffix (none: a Parquet folder)."""
    low = path.rstrip("/").lower()
    if low.endswith((".csv", ".txt")):
        return spark.read.csv(path, header=True)
    if low.endswith((".parquet", ".pq")) or "." not in low.rsplit("/", 1)[-1]:
        return spark.read.parquet(path)
    raise ValueError(f"unknown file type: {path}")


def read_bars(spark: SparkSession, path: str, ordinal: str | None = None) -> DataFrame:
    return normalize(read_table(spark, path), ordinal)


def bucket_of(symbol, buckets: int):
    return F.pmod(F.xxhash64(symbol), F.lit(buckets)).cast("int")


def write_buckets(df: DataFrame, path: str, buckets: int = 64, symbol: str = "symbol", mode: str = "overwrite") -> None:
    """Symbols dealt over folders bucket=N by hash; one shuffle, one file a bucket and task."""
    df.withColumn("bucket", bucket_of(F.col(symbol), buckets)).repartition(buckets, "bucket").write.mode(mode).partitionBy("bucket").parquet(path)


def read_symbol(spark: SparkSession, path: str, symbol: str, buckets: int = 64, column: str = "symbol") -> DataFrame:
    """One symbol's rows: only its bucket's folder is opened, and the filter reaches the row groups."""
    bucket = spark.range(1).select(bucket_of(F.lit(symbol), buckets)).first()[0]
    return spark.read.parquet(path).where((F.col("bucket") == bucket) & (F.col(column) == symbol))


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    _, p, fs = _fs(spark, path)
    return fs.exists(p)


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """Written beside and renamed over the old one in one step, so a reader sees the old value or the new one."""
    jvm, p, fs = _fs(spark, path)
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part, True)
    out.write(json.dumps(value, indent=1, sort_keys=True, default=str).encode())
    out.close()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    part, p = fs.makeQualified(part), fs.makeQualified(p)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(part, p, how)


def read_json(spark: SparkSession, path: str, otherwise: dict | None = None) -> dict:
    _, p, fs = _fs(spark, path)
    if not fs.exists(p):
        return dict(otherwise or {})
    return json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))  # a small document of our own
