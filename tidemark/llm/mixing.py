"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Sources in code point order (null last) weigh 1, 2, 3, 1, ... and share all words by weight; a source's target stops at
MOST times its size and the excess is shared again by weight (water filling, solved over sources sorted by the weight at
which they fill). A document of a source gets floor(target / size of source) copies and a fraction of one more.

Fractions are rounded by pivotal steps on words: of a pair with masses (fraction x words) one passes mass to the other at
random, in the proportion that keeps every expectation, until one of them is 0 or 1 and is settled; the other carries the
rest on. Documents of a source are dealt into hash chunks of about CHUNK, each chunk is folded in one row of one task and
leaves one residual; residuals are dealt into chunks again and so on, until one is left for a source, which has no
partner and is rounded to the nearest. Chunks are folded from large to small documents, as the residual of a pair of
unlike sizes is mostly the larger one. A source's taken words are so within half a document of its target, at any number
of chunks and machines.

Chunks do not follow sources' sizes: a source of a third of all rows has many chunks. Rows with equal doc_id, source and
text are one item with their number n: of n rows with a fraction f, floor(n f) get the copy for certain and the remainder is
the fraction that pivotal steps round, so a row repeated a million times is folded as one. Written out again, such rows are
dealt in runs of SPREAD. The result does not depend on row order or partitioning and reruns agree. Documents without words
take no mass and get floor copies. Null text: 0 words. A null
source is a source. An empty table gives an empty result. Input columns named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, word_count

#: Mean items folded by one row; most copies of a document; equal rows that one row of a task writes out.
CHUNK, MOST, SPREAD = 128, 3, 8192


def targets(stats: DataFrame) -> DataFrame:
    """stats(source, source_size, ...), one row a source, with target double. One row a source is sorted in one task."""
    size = F.col("source_size").cast("double")
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = stats.withColumn("_w", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    ranked = ranked.withColumn("_full", F.lit(float(MOST)) * size / F.col("_w"))
    order = Window.orderBy("_full", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0.0)
    # what is left for this source and the later ones, and their weight, if all earlier ones are full
    ranked = ranked.withColumns({
        "_left": F.sum(size).over(everything) - F.coalesce(F.sum(MOST * size).over(before), zero),
        "_weight": F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), zero),
    })
    ranked = ranked.withColumn("_pair", F.when(F.col("_full") * F.col("_weight") >= F.col("_left"), F.struct(F.row_number().over(order).alias("n"), "_left", "_weight")))
    first = F.min("_pair").over(everything)
    ranked = ranked.withColumns({"_l": first["_left"], "_o": first["_weight"]})
    return ranked.withColumn("target", F.least(MOST * size, F.col("_l") * F.col("_w") / F.col("_o"))).drop("_w", "_full", "_left", "_weight", "_pair", "_l", "_o")


#: An item in a chunk. h: hash of its key; m: mass, between 0 and size.
ITEM = "struct<size:bigint,h:bigint,doc_id:{id},source:{source},text_hash:bigint,m:double>"
KEY = ("size", "h", "doc_id", "source", "text_hash")


def _fold(id_type: str, source_type: str, seed: int) -> F.Column:
    """struct<rest: item, done: array<struct<..., extra int>>> of the column items."""
    keep = lambda of, extra: "named_struct(" + ", ".join(f"'{k}', {of}.{k}" for k in KEY) + f", 'extra', {extra})"
    moved = lambda of, mass: "named_struct(" + ", ".join(f"'{k}', {of}.{k}" for k in KEY) + f", 'm', {mass})"
    done = f"array<struct<size:bigint,h:bigint,doc_id:{id_type},source:{source_type},text_hash:bigint,extra:int>>"
    a, b = "s.rest", "t"
    up, down = f"least({a}.size - {a}.m, {b}.m)", f"least({a}.m, {b}.size - {b}.m)"
    u = f"(shiftrightunsigned(xxhash64({a}.h, {b}.h, {seed}L), 12) + 0.5D) / 4503599627370496D"
    item = ITEM.format(id=id_type, source=source_type)
    # the first item gains up with probability down / (up + down), else loses down
    step = f"""CASE
      WHEN {u} * ({up} + {down}) < {down} THEN
        CASE WHEN {a}.size - {a}.m <= {b}.m THEN named_struct('rest', {moved(b, f'{b}.m - ({a}.size - {a}.m)')}, 'one', {keep(a, '1')})
             ELSE named_struct('rest', {moved(a, f'{a}.m + {b}.m')}, 'one', {keep(b, '0')}) END
      ELSE
        CASE WHEN {b}.size - {b}.m <= {a}.m THEN named_struct('rest', {moved(a, f'{a}.m - ({b}.size - {b}.m)')}, 'one', {keep(b, '1')})
             ELSE named_struct('rest', {moved(b, f'{b}.m + {a}.m')}, 'one', {keep(a, '0')}) END END"""
    return F.expr(f"""aggregate(slice(items, 2, size(items)), named_struct('rest', CAST(items[0] AS {item}), 'done', CAST(array() AS {done})),
      (s, t) -> transform(array({step}), x -> CAST(named_struct('rest', x.rest, 'done', array_append(s.done, x.one)) AS struct<rest:{item},done:{done}>))[0])""")


def copies_of_equals(docs: DataFrame, *, seed: int = 3) -> tuple[DataFrame, int]:
    """The largest number of equal rows, and a row for each distinct (doc_id, source, text) of docs: doc_id, source, text_hash long, size long, n long (rows),
    source_size long, target double, h long, base int (copies of each row) and plus long (rows that get one more)."""
    id_type, source_type = (docs.schema[c].dataType.simpleString() for c in ("doc_id", "source"))
    read = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), word_count(F.col("text")).alias("size"))
    distinct = cut(read.groupBy("doc_id", "source", "text_hash", "size").agg(F.count(F.lit(1)).alias("n")))
    stats = distinct.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.lit(1)).alias("_docs"), F.max("n").alias("_most"))
    stats = cut(targets(stats).withColumn("_chunks", F.ceil(F.col("_docs") / CHUNK)))
    share = F.when(F.col("source_size") > 0, F.least(F.lit(float(MOST)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    of = stats.drop("_most").withColumnRenamed("source", "_source").withColumn("_share", share)
    items = distinct.join(of, distinct["source"].eqNullSafe(of["_source"])).drop("_source").withColumn("base", F.floor("_share").cast("int"))
    items = items.withColumn("_rows", (F.col("_share") - F.col("base")) * F.col("n")).withColumn("_whole", F.floor("_rows").cast("long"))
    items = items.withColumn("m", (F.col("_rows") - F.col("_whole")) * F.col("size")).withColumn("h", F.xxhash64("doc_id", "text_hash", F.lit(seed)))
    level = items.where("m > 0 AND m < size").select(
        "source", F.pmod("h", "_chunks").alias("chunk"), "_chunks", F.struct(*[F.col(c).cast(t).alias(c) for c, t in (("size", "long"), ("h", "long"), ("doc_id", id_type), ("source", source_type), ("text_hash", "long"), ("m", "double"))]).alias("item")
    )
    most, equal = (x or 0 for x in stats.agg(F.max("_chunks"), F.max("_most")).first())
    settled, depth = [], 0
    while most:
        folded = level.groupBy("source", "chunk", "_chunks").agg(F.sort_array(F.collect_list("item"), asc=False).alias("items")).select("source", "chunk", "_chunks", _fold(id_type, source_type, seed + depth).alias("f"))
        folded = cut(folded.select("source", "chunk", "_chunks", "f.rest", "f.done"))
        settled.append(folded.select(F.explode("done").alias("d")).select("d.*"))
        if most == 1:
            settled.append(folded.select(*[F.col(f"rest.{k}").alias(k) for k in KEY], (F.col("rest.m") * 2 >= F.col("rest.size")).cast("int").alias("extra")))
            break
        chunks = F.ceil(F.col("_chunks") / CHUNK)
        level = folded.select("source", F.floor(F.col("chunk") / CHUNK).alias("chunk"), chunks.alias("_chunks"), F.col("rest").alias("item"))
        most, depth = -(-most // CHUNK), depth + 1
    out = items.select("doc_id", "source", "text_hash", "size", "n", "h", "source_size", "target", "base", "_whole")
    extra = settled[0] if settled else None
    for more in settled[1:]:
        extra = extra.unionByName(more)
    out = out.withColumnRenamed("_whole", "plus") if extra is None else _with_extra(out, extra)
    return out.select("doc_id", "source", "text_hash", "size", "n", "source_size", "target", "h", "base", "plus"), equal


def _with_extra(out: DataFrame, extra: DataFrame) -> DataFrame:
    x = extra.select(*[F.col(k).alias(f"_{k}") for k in KEY], "extra")
    match = (out["size"] == x["_size"]) & (out["h"] == x["_h"])
    for k in ("doc_id", "source", "text_hash"):
        match = match & out[k].eqNullSafe(x[f"_{k}"])
    return out.join(x, match, "left").withColumn("plus", F.col("_whole") + F.coalesce("extra", F.lit(0)))


def copies(docs: DataFrame, *, seed: int = 3) -> DataFrame:
    """A row for each row of docs (doc_id, source, text): doc_id, source, text_hash long, occurrence long (from 1, among
    equal rows), size long, source_size long, target double, copies int."""
    each, equal = copies_of_equals(docs, seed=seed)
    runs = each.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / SPREAD))))
    if equal > SPREAD:
        runs = runs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "h", "_run")  # equal rows in many tasks
    first = F.col("_run") * SPREAD
    out = runs.withColumn("occurrence", F.explode(F.sequence(first + 1, F.least("n", first + SPREAD))))
    made = (F.col("base") + (F.col("occurrence") <= F.col("plus")).cast("int")).alias("copies")
    return out.select("doc_id", "source", "text_hash", "occurrence", "size", "source_size", "target", made)


def mix(docs: DataFrame, *, seed: int = 3) -> DataFrame:
    """docs with each row repeated as often as the mix takes it (0 to MOST times); docs has doc_id, source and text. Rows
    are shuffled once, for the join; only equal rows of which some get one copy more are written out and numbered, by the
    partition they stand in and their place there."""
    each, equal = copies_of_equals(docs, seed=seed)
    taken = each.select(F.struct("doc_id", "source", "text_hash").alias("key"), "n", "base", "plus")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.struct("doc_id", "source", F.xxhash64("text").alias("text_hash")).alias("key"))
    if equal <= 1:
        out = rows.join(taken, "key").select("row", (F.col("base") + F.col("plus")).cast("int").alias("times"))
    else:
        rows = rows.join(cut(taken), "key")
        alike = (F.col("plus") == 0) | (F.col("plus") == F.col("n"))
        out = rows.where(alike).select("row", (F.col("base") + (F.col("plus") > 0).cast("int")).alias("times"))
        some = cut(rows.where(~alike).withColumn("part", F.spark_partition_id()))
        before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        counts = some.groupBy("key", "part").agg(F.count(F.lit(1)).alias("c")).select("key", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
        at = F.col("before") + F.row_number().over(Window.partitionBy("key", "part").orderBy(F.lit(0)))
        placed = some.join(counts, ["key", "part"]).withColumn("at", at)
        out = out.unionByName(placed.select("row", (F.col("base") + (F.col("at") <= F.col("plus")).cast("int")).alias("times")))
    return out.where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def op3(docs: DataFrame) -> DataFrame:
    out = copies(docs.select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
