"""Approximate nearest neighbours by learned partitions.

Fit, on the driver, from at most FIT_ROWS vectors (smallest hash of the id): a graph of nearest neighbours is cut into
balanced parts (recursive bisection, then moves to the part of most neighbours under a capacity), and a softmax classifier
learns the parts that a vector's neighbours lie in. A fifth of the sample is kept from it; the number of parts a query is
sent to is the least that finds RECALL of those rows' neighbours in the whole sample.

Deeper levels: a part of more than FULL vectors is fitted and cut again by the same method on a sample of its own, where the
sample meets in a task, and its vectors and queries, dealt by salt, are routed on; so parts keep their size at any number of
vectors. It ends when no part is full or cutting helps no more (copies of one vector).

Search: every vector goes to its most probable part, every query to its most probable parts. A part of more than BLOCK
vectors is dealt into blocks, so a hot part is searched by many tasks; a task holds one block and streams queries past it.
Blocks give each query's best, the best of all are ranked. A query whose parts hold fewer than k candidates while
there are more is sent to all parts. Candidates are screened by a matrix product and rescored by a
fixed-order sum in double precision, so equal vectors have equal scores wherever they lie; ties go to the smaller id.

Vectors that are null, zero, of another length than most, or hold null or non-finite components, and null ids, take no
part. Of repeated ids the least vector counts. With few vectors all of them are found. An empty table gives an empty
result. Only the id and vector columns are read.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, cut, hash_sample

#: Vectors a level is fitted on at most, parts of a level at most, neighbours in the graph, vectors of a block, queries scored at
#: once, recall that the number of parts searched is fitted to.
FIT_ROWS, PARTS, DEGREE, BLOCK, ASKED, RECALL = 6000, 64, 10, 16384, 128, 0.97
#: Vectors of a part that is cut further, and mean vectors of the parts it is cut into.
FULL, PART_ROWS = 65536, 16384


def parts_of(n: int) -> int:
    """Two parts at least; they grow as the root of the vectors, so that neither a part nor a query's candidates from all parts do faster."""
    return max(2, min(PARTS, round(n**0.5 / 16)))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of each row's k largest inner products, itself left out."""
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1000):
        s = x[at : at + 1000] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        near = np.argpartition(-s, k - 1, axis=1)[:, :k]
        out[at : at + 1000] = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 8) -> np.ndarray:
    """A part for each vertex, of at most 10 % over the mean size, with few edges cut."""
    label = np.zeros(len(x), np.int64)

    def halve(rows: np.ndarray, first: int, n: int) -> None:
        if n == 1 or len(rows) < 2:
            label[rows] = first
            return
        centred = x[rows] - x[rows].mean(axis=0)
        axis = np.linalg.svd(centred.T @ centred)[0][:, 0]
        order = rows[np.argsort(centred @ axis, kind="stable")]
        at = len(rows) * (n // 2) // n
        halve(order[:at], first, n // 2)
        halve(order[at:], first + n // 2, n - n // 2)

    halve(np.arange(len(x)), 0, parts)
    most = int(np.ceil(1.1 * len(x) / parts))
    for _ in range(rounds):
        votes = np.zeros((len(x), parts))
        np.add.at(votes, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 1)
        np.add.at(votes, (graph.ravel(), np.repeat(label, graph.shape[1])), 1)
        gain = votes.max(axis=1) - votes[np.arange(len(x)), label]
        size = np.bincount(label, minlength=parts)
        moved = 0
        for v in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())]:
            to = int(votes[v].argmax())
            if size[to] < most and size[label[v]] > 1:
                size[label[v]] -= 1
                size[to] += 1
                label[v], moved = to, moved + 1
        if not moved:
            break
    return label


class Router:
    """Softmax classifier of parts on standardised vectors, and the number of parts to search."""

    def __init__(self, x: np.ndarray, target: np.ndarray, epochs: int = 60, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.scale = x.std(axis=0) + 1e-12
        z = np.concatenate([x / self.scale, np.ones((len(x), 1))], axis=1)
        hidden = 128
        self.w1 = rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], hidden))
        self.w2 = np.zeros((hidden + z.shape[1], target.shape[1]))
        state = [[np.zeros_like(w), np.zeros_like(w)] for w in (self.w1, self.w2)]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(z))
            for at in range(0, len(z), 256):
                rows, step = order[at : at + 256], step + 1
                h, both, p = self._forward(z[rows])
                d = (p - target[rows]) / len(rows)
                g2 = both.T @ d + 1e-4 * self.w2
                g1 = z[rows].T @ ((d @ self.w2[:hidden].T) * (h > 0)) + 1e-4 * self.w1
                for w, g, s in ((self.w1, g1, state[0]), (self.w2, g2, state[1])):
                    s[0] = 0.9 * s[0] + 0.1 * g
                    s[1] = 0.999 * s[1] + 0.001 * g * g
                    w -= 0.003 * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.999**step)) + 1e-8)
        self.probes = target.shape[1]

    def _forward(self, z: np.ndarray):
        h = np.maximum(z @ self.w1, 0)
        both = np.concatenate([h, z], axis=1)
        s = both @ self.w2
        p = np.exp(s - s.max(axis=1, keepdims=True))
        return h, both, p / p.sum(axis=1, keepdims=True)

    def order(self, x: np.ndarray) -> np.ndarray:
        """Parts of each row, most probable first."""
        return np.argsort(-self._forward(np.concatenate([x / self.scale, np.ones((len(x), 1))], axis=1))[2], axis=1, kind="stable")


def fit(x: np.ndarray, parts: int, k: int, *, recall: float = RECALL) -> Router | None:
    """None if there is one part only."""
    parts = min(parts, len(x) // 50)
    if parts < 2:
        return None
    x = x.astype(np.float64)
    held = np.arange(len(x)) % 5 == 0  # the sample comes in order of a hash
    learn = x[~held]
    graph = neighbour_graph(learn, min(DEGREE, len(learn) - 1))
    label = balanced_parts(learn, graph, parts)
    target = np.zeros((len(learn), parts))
    np.add.at(target, (np.repeat(np.arange(len(learn)), graph.shape[1]), label[graph].ravel()), 1.0 / (graph.shape[1] + 1))
    target[np.arange(len(learn)), label] += 1.0 / (graph.shape[1] + 1)
    router = Router(learn, target)
    # rows that the router has not seen ask for their neighbours among all
    order = router.order(x)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(parts)[None, :].repeat(len(x), 0), 1)
    near = neighbour_graph(x, min(k, len(x) - 1))[held]
    found = np.take_along_axis(place[held], order[:, 0][near], 1)
    router.probes = next((n for n in range(1, parts + 1) if (found < n).mean() >= recall), parts)
    return router


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v array<double>): the vectors that take part, one for each id."""
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = df.select(F.col(f"`{key}`").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    return rows.where(fine).groupBy("id").agg(F.min("v").alias("v"))


def _placed(rows: DataFrame, router: Router | None, probes: int | None) -> DataFrame:
    """rows with part: the most probable one, or a row for each of the most probable ones."""
    if router is None:
        return rows.withColumn("part", F.lit(0))
    n = probes or 1

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                order = router.order(np.asarray(batch.column("v").flatten()).reshape(batch.num_rows, -1))[:, :n]
                take = pa.array(np.repeat(np.arange(batch.num_rows), order.shape[1]))
                yield pa.RecordBatch.from_arrays([*(c.take(take) for c in batch.columns), pa.array(order.ravel().astype(np.int32))], names=[*batch.schema.names, "part"])

    return rows.mapInArrow(run, "id long, v array<double>, part int")


def _deeper(index: DataFrame, asked: DataFrame, k: int, fit_rows: int) -> tuple[DataFrame, DataFrame]:
    """index and asked (id, v, part; checkpointed) with full parts cut by routers of their own, level by level."""
    before = None
    kinds = "id long, v array<double>, part long"
    index, asked = (df.select("id", "v", F.col("part").cast("long").alias("part")) for df in (index, asked))
    while True:
        full = cut(index.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FULL))
        work = full.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0.0
        if not work or (before is not None and work > 0.9 * before):
            return index, asked
        before = work
        full = full.select("part", "n", F.ceil(F.col("n") / FULL).cast("int").alias("salts"))
        share = F.least(F.lit(1.0), F.lit(float(fit_rows)) / F.col("n"))
        some = index.join(full, "part").where(F.pmod(F.xxhash64("id", F.lit(13)), F.lit(1 << 20)) < share * (1 << 20)).select("part", "n", "id", "v")

        def learn(key, pdf):
            pdf = pdf.sort_values("id", key=lambda c: c.map(lambda i: hash((int(i), 13))))
            router = fit(np.array(pdf["v"].tolist()), min(PARTS, max(2, -(-int(pdf["n"].iloc[0]) // PART_ROWS))), k)
            return pd.DataFrame({"part": [key[0]] if router else [], "router": [pickle.dumps(router)] if router else []})

        routers = cut(some.groupBy("part").applyInPandas(learn, "part long, router binary"))
        salted = routers.join(full, "part").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("n", "salts")
        cutting = full.join(routers.select("part"), "part").select("part", "salts")

        def moved(df, queries):
            both = df.join(cutting, "part", "left")
            stays = both.where("salts IS NULL").select("id", "v", (F.col("part") * PARTS).alias("part"))
            moves = both.where("salts IS NOT NULL").select("id", "v", "part", F.pmod(F.xxhash64("id", F.lit(17)), F.col("salts")).cast("int").alias("salt"))

            def onward(rows, model):
                if not len(rows) or not len(model):
                    return pd.DataFrame({"id": [], "v": [], "part": []})
                router = pickle.loads(model["router"].iloc[0])
                order = router.order(np.array(rows["v"].tolist()))[:, : router.probes if queries else 1]
                take = np.repeat(np.arange(len(rows)), order.shape[1])
                return pd.DataFrame({"id": rows["id"].to_numpy()[take], "v": rows["v"].to_numpy()[take], "part": int(model["part"].iloc[0]) * PARTS + order.ravel()})

            return cut(stays.unionByName(moves.groupBy("part", "salt").cogroup(salted.groupBy("part", "salt")).applyInPandas(onward, kinds)))

        index, asked = moved(index, False), moved(asked, True)


def best_of(queries: np.ndarray, ids: np.ndarray, have: np.ndarray, have_ids: np.ndarray, k: int):
    """For each query the rows (query number, id, score) of its k best in the block, ties to the smaller id."""
    s = queries @ have.T
    s[ids[:, None] == have_ids[None, :]] = -np.inf
    n = min(k, len(have_ids))
    least = -np.partition(-s, n - 1, axis=1)[:, n - 1]
    size = np.abs(queries).max(axis=1) * np.abs(have).max() * have.shape[1]
    for q in range(len(queries)):
        near = np.flatnonzero((s[q] >= least[q] - 1e-12 * size[q]) & np.isfinite(s[q]))
        exact = np.array([float(np.sum(have[i] * queries[q])) for i in near]) if len(near) < 64 else np.sum(have[near] * queries[q][None, :], axis=1)
        order = np.lexsort((have_ids[near], -exact))[:k]
        yield q, have_ids[near[order]], exact[order]


def search(df: DataFrame, query: F.Column, *, key: str = "vec_id", vector: str = "embedding", k: int = 20, fit_rows: int = FIT_ROWS, parts: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of df where query holds (a condition on the column id)."""
    spark = df.sparkSession
    bound_batches(spark)
    rows = cut(usable(df, key, vector))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("v") == (lengths["n"] if lengths else 0))
    total = lengths["count"] if lengths else 0
    sample = hash_sample(rows, ["id"], fit_rows, 11, total).select("v").toArrow()
    x = np.array(sample.column("v").combine_chunks().flatten()).reshape(sample.num_rows, -1) if sample.num_rows else np.zeros((0, 1))
    router = fit(x, parts or parts_of(total), k)
    index, asked = cut(_placed(rows, router, None)), _placed(rows.where(query), router, router.probes if router else None)
    if router is not None:
        index, asked = _deeper(index, cut(asked), k, fit_rows)
    near = _search(index, asked, k)
    if router is None:
        return near
    near = cut(near)
    found = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    short = rows.where(query).join(found, F.col("id") == F.col("query_id"), "left").where(F.coalesce("_n", F.lit(0)) < min(k, total - 1)).select("id", "v")
    short = cut(short)
    if not short.limit(1).count():
        return near
    # their parts hold too few: all parts are asked
    everywhere = short.crossJoin(index.select("part").distinct())
    return near.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(_search(index, everywhere, k))


def _search(index: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: of each query (id, v, part; a row for each part that it asks) the best k in index."""
    sizes = index.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    held = index.join(sizes, "part").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).select("part", "block", F.lit(0).alias("asks"), "id", "v")
    asked = asked.join(sizes, "part").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("part", "block", F.lit(1).alias("asks"), "id", "v")
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = held.unionByName(asked).repartition(tasks, "part", "block").sortWithinPartitions("part", "block", "asks")

    def run(batches):
        key_, have, have_ids = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("part", "block", "asks")]).T
            v = np.asarray(batch.column("v").flatten()).reshape(batch.num_rows, -1)
            ids = batch.column("id").to_numpy()
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
            for s, e in zip(starts, starts[1:], strict=False):
                if key_ != (at := tuple(keys[s][:2])):
                    key_, have, have_ids = at, [], []
                if keys[s][2] == 0:
                    have.append(v[s:e])
                    have_ids.append(ids[s:e])
                elif have:
                    have, have_ids = [np.concatenate(have)], [np.concatenate(have_ids)]
                    for q in range(s, e, ASKED):
                        asked_ids = ids[q : min(e, q + ASKED)]
                        made = list(best_of(v[q : q + len(asked_ids)], asked_ids, have[0], have_ids[0], k))
                        n = [len(m[1]) for m in made]
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked_ids, n)), pa.array(np.concatenate([m[1] for m in made])), pa.array(np.concatenate([m[2] for m in made]))], names=["query_id", "vec_id", "score"])

    near = ordered.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8(embeddings: DataFrame) -> DataFrame:
    return search(embeddings.select("vec_id", "embedding"), F.col("id") % 20 == 0)
