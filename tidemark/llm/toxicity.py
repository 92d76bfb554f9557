"""Toxicity by maximum-scoring segments of token log-odds, calibrated by extreme values.

Fit. At most FIT_ROWS labelled documents that are not held out (smallest hash of the id) give document counts of tokens in
toxic and clean texts; a token is a word or its first 4, 5 or 6 bytes (marked with a star). Tokens of at least MIN_TOXIC
toxic documents and a clear excess by these counts are candidates. Their document counts over all documents are the
Dirichlet prior of a log-odds ratio with its standard error; tokens whose excess is clear and significant by it too form the
lexicon. Every candidate is tested: up to CARRIED of them travel to the counting tasks, more are counted in a join. The score of a word is the largest log-odds ratio of its tokens in the lexicon, or else that of all
other tokens together, which is just below zero.

Limits. What excess is clear (LIMITS) is chosen by cross-validation inside the fitted rows: texts are dealt into FOLDS by
their hash, each fold is scanned with lexicons that leave its counts out, and the pair of limits of the least log loss is
taken, the strictest of equals. K and the logistic curve come from the same out-of-fold scans. No label of a held-out row
is read for any of it.

Scan. The model is of words being there or not, so in a segment each word of the lexicon counts once and its repeats like
other words; in another segment it counts again. Passages are the best segment of a text, then those of the rests before
and after it, and so on. All maximal scoring segments with every occurrence counted are found in linear time; each passage
lies in one of them, and only those that hold a word twice are searched. A segment of score S in a text of n words has
E = K n exp(-S) (scores are natural log-odds, so lambda is 1); K comes from the largest segments of clean fitted
documents. Segments of E below PASSAGE_E are passages.

Score. A document's statistic joins its best segment with all its passages by the sum statistic of extreme values: the r
best segments of normalised scores with sum T have a chance of exp(-T) T^(r-1) / (r! (r-1)!), doubled for each segment
after the first, and the least chance of all r counts. A logistic curve makes it a score. Labels, lang, source and doc_id
are never inputs.

Null text counts as empty and has a score. Null labels are not learned from; of repeated ids in labels the largest counts.
Without both kinds of labels the lexicon is empty and the score is the smoothed share of ones. Repeated rows get equal
scores. An empty table gives an empty result. Input columns named like an output column are replaced.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bound_batches, cut, held_out, spread, text_values
from .quality import FIT_ROWS, fit_rows

#: Score from which a document is toxic; E below which a segment is a passage.
TOXIC, PASSAGE_E = 0.5, 0.01
#: Least toxic documents of a token, weight of the prior in documents' tokens, lengths of prefixes, folds.
MIN_TOXIC, PRIOR, PREFIXES, FOLDS = 3, 20_000.0, (4, 5, 6), 4
#: Pairs of least log-odds and least standard errors that cross-validation chooses from, strictest first.
LIMITS = ((4.0, 3.0), (4.0, 2.0), (3.0, 3.0), (3.0, 2.0), (2.0, 3.0), (2.0, 2.0))
#: Entries after which a task passes its counts on or forgets remembered words; candidates that are carried to tasks at most.
FLUSH, CARRIED = 400_000, 200_000

_SPACED = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters and characters above ASCII."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACED).split()


def tokens(distinct: set[bytes]) -> set[bytes]:
    out = set(distinct)
    for n in PREFIXES:
        out.update(w[:n] + b"*" for w in distinct if len(w) > n)
    return out


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score), in linear time."""
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[list] = []  # start, end, sum before, sum after, the last earlier one with a smaller sum before
    for k in at.tolist():
        new = [k, k + 1, total[k], total[k + 1]]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                found.append([*new, j])
                break
            new[0], new[2] = found[j][0], found[j][2]
            del found[j:]
    return [(s, e, float(after - before)) for s, e, before, after, _ in found]


class Lexicon:
    """Scores of tokens, the score of all others, K, and the logistic curve (a, b) of the statistic."""

    def __init__(self, odds: dict[bytes, float], other: float):
        self.odds, self.other, self.k, self.a, self.b = odds, other, 0.1, 0.0, 1.0

    def of(self, word: bytes) -> float:
        best = self.odds.get(word, 0.0)
        for n in PREFIXES:
            if len(word) > n:
                best = max(best, self.odds.get(word[:n] + b"*", 0.0))
        return best or self.other

    def memory(self) -> dict[bytes, float]:
        model = self

        class Remembered(dict):
            def __missing__(self, word):
                if len(self) > FLUSH:
                    self.clear()
                self[word] = score = model.of(word)
                return score

        return Remembered()

    def statistic(self, best, n):
        """-ln E of a segment."""
        return best - np.log(self.k * np.maximum(n, 1))

    def least(self, n: int) -> float:
        """Score from which a segment of a text of n words is a passage."""
        return math.log(self.k * max(n, 1) / PASSAGE_E)

    def joined(self, scores: list[float], n: int) -> float:
        """The statistic of a text of n words: its best segment, with all its passages by the sum statistic."""
        if not scores:
            return float(self.statistic(0.0, n))
        base = math.log(self.k * max(n, 1))
        ordered = sorted((x - base for x in scores), reverse=True)
        out = total = ordered[0]
        for r, x in enumerate(ordered[1:], 2):
            if x <= -math.log(PASSAGE_E):
                break
            total += x
            out = max(out, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r) - (r - 1) * math.log(2))
        return out

    def probability(self, statistic: float) -> float:
        return 1 / (1 + math.exp(-(self.a + self.b * max(-50.0, min(50.0, float(statistic))))))


def _parts(hits: list[tuple[int, float, bytes]], other: float, least: float) -> list[tuple[int, int, float]]:
    """Best segment of hits (place, score, word) with each word counted once, then the best ones of the rests before and
    after it, and so on down to a score of least. The first of all is given even if it is below least."""
    out, rests = [], [hits]
    while rests:
        some = rests.pop()
        # a best segment starts where its first word stands for the last time before its end
        last: dict[bytes, int] = {}
        top, ends = 0.0, []
        for j, (place, _, word) in enumerate(some):
            last.pop(word, None)
            last[word] = j
            got, start, count, sum_odds = 0.0, j, 0, 0.0
            for i in reversed(last.values()):
                count, sum_odds = count + 1, sum_odds + some[i][1]
                if (value := sum_odds + other * (place - some[i][0] + 1 - count)) > got + 1e-9:
                    got, start = value, i
            if got > top + 1e-9:
                top, ends = got, []
            if got >= top - 1e-9:
                ends.append((start, j, got))
        if out and top < least:
            continue
        after = 0  # equally good ones that do not meet, from the left
        for i, j, got in ends:
            if i >= after:
                out.append((some[i][0], some[j][0] + 1, got))
                if top >= least and i > after:
                    rests.append(some[after:i])
                after = j + 1
        if top >= least and after < len(some):
            rests.append(some[after:])
    return out


def passages(model: Lexicon, memory: dict[bytes, float], own: list[bytes], least: float) -> list[tuple[int, int, float]]:
    """Segments (start, end exclusive, score) in order: the best one, and all disjoint ones of a score of least or more."""
    scores = np.array([memory[w] for w in own])
    found, best = [], 0.0
    for s, e, score in sorted(segments(scores), key=lambda x: -x[2]):
        if score < least and score <= best:  # with every occurrence counted it is no less than any part with words once
            break
        at = (np.flatnonzero(scores[s:e] > 0) + s).tolist()
        once = len({own[i] for i in at}) == len(at)
        some = [(s, e, score)] if once else _parts([(i, float(scores[i]), own[i]) for i in at], model.other, least)
        found += some
        best = max(best, *(x[2] for x in some))
    return sorted(x for x in found if x[2] >= min(least, best))


def best_segment(model: Lexicon, memory: dict[bytes, float], own: list[bytes]) -> tuple[float, int]:
    """Score of the best segment (0: none) and number of words."""
    return max((x[2] for x in passages(model, memory, own, math.inf)), default=0.0) if own else 0.0, len(own)


def statistic(model: Lexicon, memory: dict[bytes, float], own: list[bytes]) -> float:
    """The joined statistic of a text's words."""
    return model.joined([x[2] for x in passages(model, memory, own, model.least(len(own)))] if own else [], len(own))


def _count(df: DataFrame, label: str | None = None, fold: str | None = None, only: frozenset[bytes] | None = None) -> DataFrame:
    """(token binary, docs array<long>, toxic array<long>): in how many documents of each fold (one without fold) each token
    (of only, if given) stands. The token of a blank stands for all tokens together."""
    bound_batches(df.sparkSession)

    def run(batches):
        seen, toxic, held = {}, {}, 0

        def emit(k):
            some, bad = seen.pop(k), toxic.pop(k, Counter())
            keys = list(some)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([k] * len(keys), pa.int32()), pa.array([some[t] for t in keys], pa.int64()), pa.array([bad[t] for t in keys], pa.int64())], names=["token", "fold", "docs", "toxic"])

        for batch in batches:
            labels = batch.column(label).to_pylist() if label else [0] * batch.num_rows
            folds = batch.column(fold).to_pylist() if fold else [0] * batch.num_rows
            for text, y, k in zip(batch.column("text").to_pylist(), labels, folds, strict=True):
                own = tokens(set(words(text)))
                size = len(own)
                if only is not None:
                    own &= only
                some = seen.setdefault(k, Counter())
                held -= len(some)
                some.update(own)
                some[b" "] += size
                held += len(some)
                if y:
                    bad = toxic.setdefault(k, Counter())
                    bad.update(own)
                    bad[b" "] += size
            if held > FLUSH:
                for k in list(seen):
                    yield emit(k)
                held = 0
        for k in list(seen):
            yield emit(k)

    counts = df.select("text", *[c for c in (label, fold) if c]).mapInArrow(run, "token binary, fold int, docs long, toxic long")
    n = FOLDS if fold else 1
    each = lambda c: F.array(*[F.coalesce(F.sum(F.when(F.col("fold") == k, F.col(c))), F.lit(0)) for k in range(n)]).alias(c)
    return counts.groupBy("token").agg(each("docs"), each("toxic"))


def _scan(df: DataFrame, model: Lexicon) -> DataFrame:
    """df with statistic double and passages."""

    def setup():
        memory = model.memory()

        def kernel(batch):
            statistics, significant = [], []
            for text in batch.column("text").to_pylist():
                own = words(text)
                least = model.least(len(own))
                found = passages(model, memory, own, least) if own else []
                statistics.append(model.joined([x[2] for x in found], len(own)))
                significant.append([{"start_word": s, "end_word": e, "score": x, "e_value": math.exp(min(50.0, -float(model.statistic(x, len(own)))))} for s, e, x in found if x > least])
            return {"statistic": pa.array(statistics, pa.float64()), "passages": pa.array(significant, _PASSAGES)}

        return kernel

    return arrow_map(df, setup, "statistic double, passages array<struct<start_word:int,end_word:int,score:double,e_value:double>>")


_PASSAGES = pa.list_(pa.struct([("start_word", pa.int32()), ("end_word", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, float]:
    """Intercept and slope by Newton steps on standardised x; a light ridge keeps separable data finite."""
    mean, sd = x.mean(), x.std() or 1.0
    z = np.stack([np.ones(len(x)), (x - mean) / sd], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag([1e-6, ridge])
        step = np.linalg.solve(hessian, z.T @ (y - p) - np.array([0, ridge]) * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] - w[1] * mean / sd), float(w[1] / sd)


def lexicons(docs: DataFrame, sample: DataFrame) -> tuple[list[dict], list[tuple[int, int]]]:
    """Rows (token; and for all fitted rows, then for those without fold 0, 1, ...: least of the log-odds by counts and with
    the prior, z, toxic and clean with the prior, enough) of the tokens that reach any pair of limits in any of them, and the
    numbers of all toxic and clean tokens."""
    counted = cut(_count(sample, "y", "fold").where(f"aggregate(toxic, 0L, (s, x) -> s + x) >= {MIN_TOXIC} OR token = X'20'"))
    total = counted.where("token = X'20'").first()
    if total is None:
        return [], [(0, 0)] * (FOLDS + 1)
    n = [(sum(total.toxic), sum(total.docs) - sum(total.toxic))]
    n += [(n[0][0] - t, n[0][1] - (d - t)) for t, d in zip(total.toxic, total.docs, strict=True)]
    if not all(n[0]):
        return [], n
    total_of = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    each = []  # toxic and clean documents of a token
    for k in range(FOLDS + 1):
        t = total_of("toxic") - (F.col("toxic")[k - 1] if k else 0)
        each.append((t, total_of("docs") - (F.col("docs")[k - 1] if k else 0) - t))
    odds = lambda t, c, k, more: F.ln(t / (n[k][0] + more - t)) - F.ln(c / (n[k][1] + more - c))
    lowest, calm = min(o for o, _ in LIMITS), min(z for _, z in LIMITS)
    own = F.array(*[F.when(t >= MIN_TOXIC, odds(t + 0.5, c + 0.5, k, 1.0)) for k, (t, c) in enumerate(each)])
    candidates = cut(counted.where("token != X'20'").withColumn("own", own).where(F.exists("own", lambda x: F.coalesce(x >= lowest, F.lit(False)))))
    few = candidates.select("token").limit(CARRIED + 1).toArrow().column(0).to_pylist()
    everywhere = cut(_count(docs, only=frozenset(few) if len(few) <= CARRIED else None).select(F.col("token").alias("_t"), F.col("docs")[0].alias("_all")))
    size = everywhere.where("_t = X'20'").first()["_all"]
    a = F.lit(PRIOR) * F.greatest("_all", total_of("docs")) / F.lit(float(max(size, 1)))
    made = []
    for k, (t, c) in enumerate(each):
        d = odds(t + a, c + a, k, PRIOR)
        made.append(F.struct(F.least(d, F.col("own")[k]).alias("odds"), (d / F.sqrt(1 / (t + a) + 1 / (c + a))).alias("z"), (t + a).alias("toxic"), (c + a).alias("clean"), (t >= MIN_TOXIC).alias("enough")))
    rows = candidates.join(everywhere, candidates["token"] == everywhere["_t"]).select("token", F.array(*made).alias("made"))
    rows = rows.where(F.exists("made", lambda x: x["enough"] & (x["odds"] >= lowest) & (x["z"] >= calm)))
    return sorted(rows.toArrow().to_pylist(), key=lambda r: r["token"]), n


def lexicon(rows: list[dict], n: tuple[int, int], which: int, limits: tuple[float, float]) -> Lexicon:
    """The lexicon of one pair of limits; which: 0 for all fitted rows, k for those without fold k - 1."""
    odds, in_toxic, in_clean = {}, 0.0, 0.0
    for r in rows:
        m = r["made"][which]
        if m["enough"] and m["odds"] >= limits[0] and m["z"] >= limits[1]:
            odds[bytes(r["token"])] = m["odds"]
            in_toxic, in_clean = in_toxic + m["toxic"], in_clean + m["clean"]
    rest_t, rest_c = 1 - in_toxic / (n[0] + PRIOR), 1 - in_clean / (n[1] + PRIOR)
    return Lexicon(odds, -max(1e-3, math.log(rest_c / rest_t)) if rest_t > 0 and rest_c > 0 else -1.0)


def _out_of_fold(sample: DataFrame, models: list[list[Lexicon]], whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels, sizes and, for each list of models (one a fold), the best segment's score of each text of the sample, or
    the joined statistic (whole). A row a fitted document."""
    bound_batches(sample.sparkSession)

    def run(batches):
        memories = [[m.memory() for m in some] for some in models]
        for batch in batches:
            out, sizes = [], []
            for text, k in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist(), strict=True):
                own = words(text)
                sizes.append(len(own))
                out.append([statistic(some[k], memory[k], own) if whole else best_segment(some[k], memory[k], own)[0] for some, memory in zip(models, memories, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(sizes, pa.int64()), pa.array(out, pa.list_(pa.float64()))], names=["y", "n", "s"])

    found = sample.select("text", "y", "fold").mapInArrow(run, "y int, n long, s array<double>").toArrow()
    y, n = (found.column(c).to_numpy().astype(float) for c in ("y", "n"))
    s = np.array(found.column("s").combine_chunks().flatten()).reshape(len(y), -1) if len(y) else np.zeros((0, len(models)))
    order = np.lexsort((*s.T, n, y))  # sums do not depend on the order of partitions
    return y[order], n[order], s[order]


def _extreme_k(best: np.ndarray, n: np.ndarray) -> float:
    """K of the largest segments of clean texts, by maximum likelihood."""
    return float(np.clip(len(n) / np.sum(np.maximum(n, 1) * np.exp(-best)), 1e-6, 1.0)) if len(n) else 0.1


def _loss(x: np.ndarray, y: np.ndarray) -> float:
    a, b = _logistic(x, y)
    p = np.clip(1 / (1 + np.exp(-(a + b * x))), 1e-9, 1 - 1e-9)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", *, most: int = FIT_ROWS) -> Lexicon:
    chosen = F.broadcast(fit_rows(labels, label, most).select(F.col("doc_id").alias("_id"), F.col("label").alias("_y")))
    # copies of one text are one observation
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number is not merged into few tasks
    sample = docs.join(chosen, F.col("doc_id") == F.col("_id")).groupBy("text").agg(F.max("_y").cast("int").alias("y"))
    sample = cut(sample.withColumn("fold", F.pmod(F.xxhash64("text", F.lit(5)), F.lit(FOLDS)).cast("int")).repartition(tasks))
    rows, n = lexicons(docs, sample)
    models = [[lexicon(rows, n[k + 1], k + 1, pair) for k in range(FOLDS)] for pair in LIMITS]
    y, sizes, best = _out_of_fold(sample, models if rows else [], False)
    clean = y == 0
    if not rows or clean.all() or not clean.any():
        model = Lexicon({}, -1e-3)
        share = (y.sum() + 1) / (len(y) + 2)
        model.a, model.b = math.log(share / (1 - share)), 0.0
        return model
    at = np.log(np.maximum(sizes, 1))
    losses = [round(_loss(np.clip(best[:, j] - at, -50, 50), y), 6) for j in range(len(LIMITS))]
    j = int(np.argmin(losses))
    k = _extreme_k(best[clean, j], sizes[clean])
    for m in models[j]:
        m.k = k
    y, sizes, joined = _out_of_fold(sample, [models[j]], True)
    model = lexicon(rows, n[0], 0, LIMITS[j])
    model.k = k
    model.a, model.b = _logistic(np.clip(joined[:, 0], -50, 50), y)
    return model


def score(model: Lexicon) -> F.Column:
    return 1 / (1 + F.exp(-(F.lit(model.a) + F.lit(model.b) * F.greatest(F.lit(-50.0), F.least(F.lit(50.0), F.col("statistic"))))))


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = TOXIC) -> DataFrame:
    """doc_id, held_out, score, predicted, passages array<struct<start_word, end_word, score, e_value>>: a row a document."""
    docs = spread(docs.select("doc_id", "text"))
    out = _scan(docs, model := fit(docs, labels)).withColumn("_score", score(model))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"), "passages")


def keep(docs: DataFrame, labels: DataFrame, *, threshold: float = TOXIC) -> DataFrame:
    """The rows of docs, all columns, that are not toxic."""
    model = fit(docs.select("doc_id", "text"), labels)

    def setup():
        memory = model.memory()

        def kernel(texts):
            return pa.array([model.probability(statistic(model, memory, words(x))) for x in texts], pa.float64())

        return kernel

    return docs.where(text_values(docs.sparkSession, setup, "double")(F.col("text")) < threshold)


def op6(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = classify(docs, labels)
    return out.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("passages"))
