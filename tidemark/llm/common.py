"""Shared plumbing: bounded Arrow batches, lineage cuts, clash-free output columns."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an Arrow batch at most, and bytes of the part of a batch that a kernel sees at once (one row may be larger).
BATCH_ROWS, PART_BYTES = 512, 4 << 20
#: White space of the text contracts, inside a regular expression's brackets.
WS = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Texts vary from one to many thousand words, so a batch is kept to few rows (a session setting; it is only lowered)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def cut(df: DataFrame, *, compact: bool = False) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there, so that lost executors cost no recomputation.
    compact: for narrow rows made by scan tasks; files of the advisory size, not one for each scan task. Without a folder
    set, a local master takes a temporary one; a cluster's machines share none, so there it is an error."""
    if compact:
        df = df.hint("rebalance")
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def unsized(df: DataFrame) -> DataFrame:
    """df, cut, without the size estimated for it. A join is estimated as the product of its sides and checkpoints keep that,
    so in loops that join a cut table with itself the estimate gets digits without end, and planning takes longer than work."""
    df, spark = cut(df), df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False), spark)


def spread(df: DataFrame) -> DataFrame:
    """df for kernels that cost more than a shuffle of their rows: a table of fewer splits than cores is dealt to all."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def without(df: DataFrame, names) -> DataFrame:
    """df without columns that an output column would clash with (case does not count)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def parts(batch: pa.RecordBatch, limit: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    if batch.num_rows <= 1 or batch.nbytes <= limit:
        if batch.num_rows:
            yield batch
        return
    half = batch.num_rows // 2
    yield from parts(batch.slice(0, half), limit)
    yield from parts(batch.slice(half), limit)


def arrow_map(df: DataFrame, setup: Callable[[], Callable[[pa.RecordBatch], dict]], adds: str) -> DataFrame:
    """df with the columns of the DDL string adds. setup() runs once a task and gives the kernel; the kernel maps a part
    of a batch to a dict of the added columns, one value a row. A column of df with an added column's name is replaced."""
    added = T.StructType.fromDDL(adds)
    df = without(df, added.names)
    schema = T.StructType(df.schema.fields + added.fields)
    bound_batches(df.sparkSession)
    names = added.names

    def run(batches):
        kernel = setup()
        for batch in batches:
            for part in parts(batch):
                made = kernel(part)
                yield pa.RecordBatch.from_arrays([*part.columns, *(made[n] for n in names)], names=[*part.schema.names, *names])

    return df.mapInArrow(run, schema)


def hash_sample(df: DataFrame, keys: list[str], most: int, seed: int, n: int | None = None) -> DataFrame:
    """At most `most` rows of df, those with the smallest hash of keys. Rows are first kept by a threshold on the hash that
    leaves few more than that, so no task or driver gathers more; n is the number of rows, if known."""
    n = df.count() if n is None else n
    h = F.xxhash64(*[F.col(k) for k in keys], F.lit(seed))
    if n > most:
        share = min(1.0, (most + 6 * most**0.5 + 6) / n)
        # the order below is by signed hash: keep the smallest share of the signed range
        df = df.where(h < F.lit(int(-(1 << 63) + share * (1 << 64)) if share < 1 else (1 << 63) - 1))
    return df.orderBy(h, *keys).limit(most)


def text_values(spark: SparkSession, setup: Callable[[], Callable[[list], pa.Array]], kind: str) -> Callable[..., F.Column]:
    """A column function of texts. Only texts go to Python and only the values come back; all other columns wait in the JVM.
    setup() runs once a task and gives the kernel, which maps a list of texts to an array."""
    bound_batches(spark)

    def values(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kernel = setup()
        for batch in batches:
            yield kernel(batch.to_pylist())

    return F.arrow_udf(values, kind)


def held_out(doc_id) -> F.Column:
    """True for rows that no label may be learned from: crc32 of the id as text (null: empty) is 0 mod 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def word_count(text) -> F.Column:
    """Number of words [^\\x20\\x09-\\x0D]+ of a text (null: 0), inside generated code."""
    one_each = F.regexp_replace(text, f"[{WS}]*[^{WS}]+[{WS}]*", "x")
    return F.when(text.rlike(f"[^{WS}]"), F.length(one_each)).otherwise(0).cast("long")


def lower_ascii(text) -> F.Column:
    return F.translate(text, UPPER, LOWER)
