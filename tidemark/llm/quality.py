"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every whole text are computed once and checkpointed (a narrow table). The trees are fitted on the driver on
at most FIT_ROWS labelled rows that are not held out, those with the smallest hash of their id, and flattened into arrays
that a numpy kernel traverses for all rows and trees at once. Labels, lang, source and doc_id are never inputs.

Null text counts as empty; the empty text has statistics zero and a score like any other. Labels that are null are not
learned from; of repeated ids in labels the largest label counts, and in documents the least statistics. Without labels of
both kinds the score is the smoothed share of ones. Repeated rows get equal scores. An empty table gives an empty result.
Input columns named like an output column are replaced.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import arrow_map, cut, hash_sample, held_out, spread, text_values

#: Labelled rows the classifier is fitted on at most; score from which a document is kept.
FIT_ROWS, KEEP = 20_000, 0.3
NAMES = (
    "log_bytes", "log_words", "upper", "lower", "digit", "other_byte", "bar", "bang", "symbol", "punctuation", "control",
    "lines_per_word", "word_bytes", "word_bytes_sd", "longest_word", "distinct_words", "top_word", "repeated_next", "distinct_lines", "odd_ends", "single",
)


def _classes() -> np.ndarray:
    """Class of each byte: 0 white space, 1 upper, 2 lower, 3 digit, 4 above ASCII, 5 bar, 6 !, 7 symbols, 8 punctuation, 9 control."""
    out = np.full(256, 9, np.uint8)
    for members, k in ((b" \t\n\r\x0b\x0c", 0), (b"|", 5), (b"!", 6), (b"#$%&*@^~=<>\\_+{}[]/`", 7), (b".,;:?'\"()-", 8)):
        out[list(members)] = k
    out[65:91], out[97:123], out[48:58], out[128:] = 1, 2, 3, 4
    return out


CLASS = _classes()


def statistics(text: str | None) -> np.ndarray:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    out = np.zeros(len(NAMES))
    if not raw:
        return out
    kinds = CLASS[np.frombuffer(raw, np.uint8)]
    counts = np.bincount(kinds, minlength=10)
    n, solid = len(words), max(1, len(raw) - counts[0])
    out[0], out[1] = np.log1p(len(raw)), np.log1p(n)
    out[2:11] = counts[1:] / solid
    if not n:
        return out
    lines = raw.split(b"\n")
    sizes = np.fromiter(map(len, words), np.int64, n)
    seen = Counter(words)
    ends = kinds[np.flatnonzero((kinds != 0) & np.append(kinds[1:] == 0, True))]
    out[11] = (len(lines) - 1) / n
    out[12], out[13], out[14] = sizes.mean(), sizes.std(), np.log1p(sizes.max())
    out[15], out[16] = len(seen) / n, max(seen.values()) / n
    out[17] = sum(map(eq, words, words[1:])) / n
    out[18] = len(set(lines)) / len(lines)
    out[19], out[20] = np.isin(ends, (5, 6, 7)).mean(), (sizes == 1).mean()
    return out


def with_statistics(docs: DataFrame, *, text: str = "text", name: str = "stats") -> DataFrame:
    def setup():
        def kernel(batch):
            x = np.stack([statistics(t) for t in batch.column(text).to_pylist()]).astype(np.float32)
            return {name: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(NAMES), dtype=np.int32)), pa.array(x.ravel()))}

        return kernel

    return arrow_map(docs, setup, f"{name} array<float>")


def fit_rows(labels: DataFrame, label: str, most: int = FIT_ROWS) -> DataFrame:
    """(doc_id, label): at most `most` labelled ids that may be learned from, by the hash of the id."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias("label"))
    return hash_sample(known, ["doc_id"], most, 5)


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", *, most: int = FIT_ROWS, **settings) -> boosting.Boosted:
    """stats: doc_id, stats. The sample is broadcast (at most `most` pairs) and at most as many rows are collected."""
    chosen = fit_rows(labels, label, most)
    rows = stats.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("stats").alias("stats")).orderBy("doc_id").toArrow()
    x = np.array(rows.column("stats").to_pylist(), np.float64).reshape(-1, len(NAMES))
    return boosting.fit(x, np.array(rows.column("label").to_pylist(), np.float64), **settings)


def scored(stats: DataFrame, model: boosting.Boosted, *, name: str = "stats", out: str = "score") -> DataFrame:
    def setup():
        def kernel(batch):
            x = np.asarray(batch.column(name).flatten()).reshape(-1, len(NAMES)).astype(np.float64)
            return {out: pa.array(model.score(x))}

        return kernel

    return arrow_map(stats, setup, f"{out} double")


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = KEEP) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row of docs."""
    stats = cut(with_statistics(spread(docs.select("doc_id", "text"))).select("doc_id", "stats"), compact=True)
    out = scored(stats, fit(stats, labels)).drop("stats")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, *, threshold: float = KEEP) -> DataFrame:
    """The rows of docs, all columns, that the classifier keeps. Statistics for the fit come from the sampled documents
    only; then each document is judged where it is read, and nothing is shuffled."""
    chosen = F.broadcast(fit_rows(labels, "quality"))
    sample = cut(with_statistics(docs.join(chosen.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text")).select("doc_id", "stats"), compact=True)
    model = fit(sample, labels)

    def setup():
        return lambda texts: pa.array(model.score(np.stack([statistics(t) for t in texts]).astype(np.float32).astype(np.float64)) if texts else [], pa.float64())

    return docs.where(text_values(docs.sparkSession, setup, "double")(F.col("text")) >= threshold)


def op5(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, labels)
