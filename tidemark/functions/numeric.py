"""Column expressions with the library's null rules: NaN, infinities and x/0 are null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def ratio(a: str | Column, b: str | Column) -> Column:
    return col(a) / F.nullif(col(b), F.lit(0.0))


def close_to(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def safe_ln(c: str | Column) -> Column:
    return F.ln(F.greatest(col(c), F.lit(1e-12)))


def pearson(x: str | Column, y: str | Column) -> Column:
    """Correlation of the pairs without nulls; null if either side is constant (corr() would divide by zero)."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def clip(c: str | Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(c)))


def average_rank(value: str, by: list[str]):
    """Rank from 1 in a group, ties share their mean rank, nulls have none."""
    from pyspark.sql import Window

    v = F.col(value)
    w = Window.partitionBy(*by, v.isNull()).orderBy(v)
    ties = Window.partitionBy(*by, v)
    return F.when(v.isNotNull(), F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)


def keep_last(df, keys: list[str], order: list[Column] = ()):
    """df with the last row of each key, by the columns of order and then by the place in the source (as read)."""
    place = F.struct(*order, F.monotonically_increasing_id().alias("_place"))
    rest = [c for c in df.columns if c not in keys]
    last = df.withColumn("_o", place).groupBy(*keys).agg(F.max_by(F.struct(*rest), "_o").alias("_last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in df.columns])


def dense_numbers(df, key: str, name: str, seed: int = 0, buckets: int = 1024):
    """df (distinct values of key) with numbers from 0 without gaps, in an order by hash. Values are numbered inside hash
    buckets, whose counts (a row a bucket) give the offsets."""
    from pyspark.sql import Window

    rows = df.withColumn("_b", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(buckets)))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    own = F.row_number().over(Window.partitionBy("_b").orderBy(F.xxhash64(key, F.lit(seed)), key)) - 1
    return rows.withColumn("_r", own).join(F.broadcast(counts), "_b").withColumn(name, F.col("_o") + F.col("_r")).drop("_b", "_r", "_o")
