"""Corpus pipeline: quality, toxicity, near-duplicates, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns a DataFrame that is
written as Parquet and read again as the next stage's docs. All but the last return the columns of documents. Labels are
read from sf_dir. Near-duplicates are documents linked by fingerprints of five-word shingles at most two bits apart or by a
similarity of their five-word shingle sets of 0.8 or more; of a group the document of the smallest id stays.

Null, empty and very long texts, null ids, sources and labels, ties, repeated rows, columns named like the operators' own and
empty tables pass through every stage with the results that the operators' modules state: a row is judged by its text, rows
with one text are one group of near-duplicates, a null source is a source, and an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from tidemark.llm import mixing, packing, quality, simhash, toxicity
from tidemark.llm.common import cut, table


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.op9(docs)


STAGES = [("quality", drop_poor), ("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("mixing", mix_sources), ("packing", pack)]
#: The classifiers and the random rounding have no SQL counterpart; tests/llm holds each stage against its operator.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Stages hand on Parquet in the shared folder that spark.checkpoint.dir names; where it is
    unset a local master takes checkpoints in a temporary folder, and a cluster is told to set it. The folder before the last
    stage stays, as the returned DataFrame reads it."""
    docs, last = table(spark, sf_dir, "documents"), None
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    for name, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        if not shared:
            docs = cut(docs)
            continue
        path = f"{shared.rstrip('/')}/pipeline-{uuid.uuid4().hex}/{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        if last:  # the stage before is read no more
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(last).getParent()
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
