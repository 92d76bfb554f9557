"""Rendezvous hashing of record keys over weighted shards, and gapless slots, in DataFrame functions only.

For a key and shard j, u is 52 bits of the MD5 of (key, seed, j), strictly between 0 and 1, and the shard with the largest
-weight / ln(u) wins. A shard's score does not depend on the other shards, so one more shard only takes rows into itself
(its share of each old shard), and taking one away deals only its own rows out anew.

Slots follow a hash of the whole row inside each shard. Equal rows are counted first and stand for a run of slots; each shard
is cut into ranges of the hash of a bounded mean size, their counts give offsets, and only a range of different rows is ever
sorted in one task. Runs are written out in parts of SPREAD, so a row repeated very often is many tasks' work.

Null keys hash like the empty text (one shard); repeated rows get slots of their own; an empty table gives an empty result;
input columns named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, without

#: Mean rows of a range that one task numbers; slots that one row of a task writes out.
BUCKET_ROWS, SPREAD = 4096, 8192


def hash52(*parts) -> F.Column:
    """The first 52 bits of the MD5 of the parts as text, joined by a bar; null counts as empty."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def shard_score(keys: Sequence[str], shard: int, weight: float, seed: int) -> F.Column:
    u = (hash52(*[F.col(f"`{k}`") for k in keys], F.lit(seed), F.lit(shard)).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return F.lit(-float(weight)) / F.ln(u)


def assign_shards(df: DataFrame, keys: Sequence[str], weights: Sequence[float], *, grown_weight: float | None = None, seed: int = 17) -> DataFrame:
    """df with shard int (0 to len(weights) - 1) and grown_shard int: the shard if one more, of grown_weight (the mean
    weight if None), were added. No shuffle. Weights have to be positive."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive and at least one")
    extra = sum(weights) / len(weights) if grown_weight is None else grown_weight
    df = without(df, ("shard", "grown_shard", "_best", "_new"))
    scored = [F.struct(shard_score(keys, j, w, seed).alias("score"), F.lit(-j).alias("minus")) for j, w in enumerate(weights)]
    best = F.greatest(*scored) if len(scored) > 1 else scored[0]
    df = df.withColumn("_best", best).withColumn("_new", shard_score(keys, len(weights), extra, seed))
    shard = (-F.col("_best.minus")).cast("int")
    return df.withColumns({"shard": shard, "grown_shard": F.when(F.col("_new") > F.col("_best.score"), F.lit(len(weights))).otherwise(shard).cast("int")}).drop("_best", "_new")


def number_slots(df: DataFrame, group: str, order: Sequence[str], slot: str = "slot") -> DataFrame:
    """df with a gapless number from 0 in each value of group (null is a value). Rows stand by a hash of all their columns and
    then by order. df should be narrow: its different rows are checkpointed."""
    rows = without(df, (slot, "_bucket", "_offset", "_g", "_b", "_n", "_h", "_run"))
    own = [F.col(f"`{c}`") for c in rows.columns]
    rows = cut(rows.groupBy(*own).agg(F.count(F.lit(1)).alias("_n")).withColumn("_h", hash52(*own)))
    n, groups, equal = rows.agg(F.sum("_n"), F.approx_count_distinct(group), F.max("_n")).first()
    buckets = max(1, -(-(n or 0) // (BUCKET_ROWS * max(1, groups))))
    rows = rows.withColumn("_bucket", F.floor(F.col("_h") / F.lit(float(1 << 52)) * buckets).cast("long"))
    counts = rows.groupBy(F.col(f"`{group}`").alias("_g"), F.col("_bucket").alias("_b")).agg(F.sum("_n").alias("_c"))
    before = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_g", "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(group, "_bucket").orderBy("_h", *[F.col(f"`{c}`") for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("_first", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    joined = numbered.join(offsets, numbered[group].eqNullSafe(offsets["_g"]) & (numbered["_bucket"] == offsets["_b"]))
    runs = joined.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / SPREAD))))
    if (equal or 0) > SPREAD:
        runs = runs.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_h", "_run")
    first = F.col("_run") * SPREAD
    places = F.sequence(first, F.least("_n", first + SPREAD) - 1)
    return runs.withColumn(slot, F.explode(places)).withColumn(slot, (F.col("_offset") + F.col("_first") + F.col(slot)).cast("long")).select(*own, slot)


def op10(docs: DataFrame, shards: int = 16) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.lit("key").alias("law")
    )
    return number_slots(assign_shards(rows, ["doc_id"], [1.0] * shards), "shard", ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


#: CRC-32 by its rule, byte by byte; shards and slots by MD5.
OP10_SQL = """
WITH tab AS (SELECT list(c ORDER BY i) AS l FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
bt AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM documents),
cr AS (SELECT doc_id, len(b) + 1 AS size, xor(4294967295, list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, l[(xor(c, x) & 255) + 1]))) AS text_crc32 FROM bt, tab),
u AS (SELECT *, list_transform(range(17), lambda j: ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|17|' || j), 1, 13))::BIGINT) AS u FROM cr),
s AS (SELECT doc_id, size, text_crc32, CAST(list_position(u[1:16], list_max(u[1:16])) - 1 AS INT) AS shard, u[17] > list_max(u[1:16]) AS more FROM u),
g AS (SELECT *, CASE WHEN more THEN 16 ELSE shard END AS grown_shard FROM s)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || size || '|' || text_crc32 || '|key|' || shard || '|' || grown_shard), 1, 13), doc_id NULLS FIRST, text_crc32, size) - 1 AS BIGINT) AS slot, CAST(grown_shard AS INT) AS grown_shard FROM g
"""
