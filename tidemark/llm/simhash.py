"""SimHash near-duplicates by vantage-point trees over Hamming distance.

Fingerprints: a text's word shingles are hashed (XXH64, seed 42) and a bit is 1 if set in over half of the hashes, repeats
included. Only distinct fingerprints go on, so copies of a document meet as one row with their number.

Partition: a vantage-point tree is built on the driver from a bounded sample. A fingerprint's home is the leaf that its
distances to the vantage points lead to; a ball of the link radius around it may cross a boundary, and by the triangle
bound only then it also visits the leaf beyond. Of two linked fingerprints in different leaves the one of the lower leaf
visits the other's, so no link is lost and each is looked for once.

Deeper levels: a leaf of more than FULL home fingerprints gets a tree of its own, built where a sample of the leaf meets,
and its rows (dealt by salt, so a hot leaf is many tasks) are routed on. That goes on until no leaf is full or cutting helps
no more, so leaves keep their size at any number of fingerprints.

Search: a leaf is cut into blocks of bounded size; home fingerprints of a block are held, those that visit stream past in
chunks, and a local vantage-point tree finds all pairs within the radius. A block passes on a star for each local
component, not its pairs, so a dense group gives as many rows as it has members. Fingerprints of more than a HOT_SHARE of
all rows are few by that share; they are joined by broadcast, all others by a shuffle.

Components: least labels over the stars' edges with shortcuts, checkpointed each round, in DataFrame operations.

Near copies: texts of a word shingle similarity of 0.8 differ in about 9 of 64 bits, and no ball of that radius can be pruned
among 64 bits (unrelated texts lie at 32 give or take 4). deduplicate therefore adds to the tree's links those of similarity:
texts that share a band of MinHashes meet at a centre, pairs with it are verified on their whole shingle sets, and members
outside its component meet again where they share one more band, which parts those that only have a passage in common. A dense group
gives as many pairs as it has members. What is found is exact; two texts that never share a centre can be missed (the README
has the recall).

Null and empty texts have fingerprint zero and link like others. A null doc_id counts in no minimum; a component of such
rows only has a null id. Repeated rows stay. An empty table gives an empty result. Extra columns are not read; columns
named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, bound_batches, cut, hash_sample, spread, unsized

SEED, RADIUS, SHINGLE = 42, 2, 3
#: Fingerprints the partition tree is built from at most; mean fingerprints of a leaf; most of a block; most that visit at
#: once; fingerprints of a local leaf that are compared one by one; words hashed at once.
SAMPLE, LEAF, BLOCK, CHUNK, LOCAL, WORDS = 65536, 4096, 8192, 4096, 256, 1 << 18
#: Home fingerprints of a leaf that are cut further; leaves of a deeper tree and fingerprints sampled for each of them; share
#: of all rows from which a fingerprint is joined by broadcast.
FULL, FAN, TWIG, HOT_SHARE = 16384, 64, 16, 0.01
#: Words of a shingle and least similarity of near copies in deduplicate; bands of MinHashes and MinHashes of a band: two texts
#: of similarity s share a band with a chance of 1 - (1 - s^ROWS)^BANDS (.99 at .8); members of a centre in one task.
NEAR_WORDS, NEAR, BANDS, ROWS, MEMBERS = 5, 0.8, 16, 6, 4096
#: Pairs of a round (three numbers each) that are broadcast at most.
FEW = 200_000
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


# --- fingerprints ---------------------------------------------------------------------------------------------------


def _hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """Hashes of a whole text's shingles, repeats included, in parts of WORDS; A-Z lower-cased, words [^\\x20\\x09-\\x0D]+."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: just these six separators, just A-Z
    digest = xxhash.xxh64_intdigest
    for at in range(0, max(1, len(words) - width + 1) if words else 0, WORDS):
        some = words[at : at + WORDS + width - 1]
        grams = zip(*[some[k:] for k in range(width)], strict=False) if len(words) >= width else [tuple(some)]
        yield np.array([digest(b" ".join(g), SEED) for g in grams], np.uint64)


def sketch(text: str | None, width: int = SHINGLE, bands: bool = True) -> tuple[int, int, list[int]]:
    """Fingerprint, number of different shingles and, if asked for, a value for each band of MinHashes (none without words)."""
    n, ones, least, seen = 0, np.zeros(64, np.int64), None, 0
    for hashes in _hashes(text, width):
        n += len(hashes)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        if bands:
            distinct = np.unique(hashes)
            seen += len(distinct)
            for at in range(0, len(distinct), 4096):
                low = (distinct[at : at + 4096, None] * FACTORS[None, :]).min(axis=0)
                least = low if least is None else np.minimum(least, low)
    if not n:
        return 0, 0, []
    fp = int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")[0])
    return fp, seen, [] if least is None else [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))]


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a whole text."""
    return sketch(text, width, False)[0]


def shingle_set(text: str | None, width: int) -> np.ndarray:
    parts = list(_hashes(text, width))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def fingerprints(docs: DataFrame, *, text: str = "text", width: int = SHINGLE, name: str = "fp") -> DataFrame:
    """docs with the fingerprint as a signed long."""

    def setup():
        def kernel(batch):
            made = [fingerprint(t, width) for t in batch.column(text).to_pylist()]
            return {name: pa.array(np.array(made, np.uint64).view(np.int64))}

        return kernel

    return arrow_map(docs, setup, f"{name} long")


# --- vantage-point trees --------------------------------------------------------------------------------------------


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class PartitionTree:
    """Flat arrays of a vantage-point tree: vantage point, distance up to which one goes left, children, leaf number."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.point, self.bound, self.left, self.right, self.leaf = [], [], [], [], []
        self.leaves = 0
        self._grow(np.unique(sample), leaves)
        self.point = np.array(self.point, np.uint64)
        self.bound, self.left, self.right, self.leaf = (np.array(x, np.int64) for x in (self.bound, self.left, self.right, self.leaf))

    def _grow(self, some: np.ndarray, leaves: int) -> int:
        at = len(self.point)
        for x, v in ((self.point, 0), (self.bound, 0), (self.left, -1), (self.right, -1), (self.leaf, -1)):
            x.append(v)
        near = None
        if leaves > 1 and len(some) > 1:
            # of a few vantage points the one around whose median the fewest balls cross
            best = None
            for p in some[:: max(1, len(some) // 16)][:16]:
                d = distance(some, p)
                for b in {int(np.median(d)), int(np.median(d)) - 1}:
                    inside = d <= b
                    if 0 < inside.sum() < len(some):
                        crossing = (np.abs(d - b - 0.5) < RADIUS).mean() + abs(inside.mean() - 0.5)
                        if best is None or crossing < best[0]:
                            best = (crossing, p, b, inside)
            if best is not None:
                _, self.point[at], self.bound[at], near = best
        if near is None:
            self.leaf[at], self.leaves = self.leaves, self.leaves + 1
            return at
        self.left[at] = self._grow(some[near], leaves // 2)
        self.right[at] = self._grow(some[~near], leaves - leaves // 2)
        return at

    @classmethod
    def of(cls, point, bound, left, right, leaf) -> PartitionTree:
        """The tree of given arrays."""
        tree = cls.__new__(cls)
        tree.point = np.asarray(point, np.int64).view(np.uint64)
        tree.bound, tree.left, tree.right, tree.leaf = (np.asarray(x, np.int64) for x in (bound, left, right, leaf))
        return tree

    def route(self, fps: np.ndarray, radius: int, visits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row numbers, leaves and whether at home: each row's own leaf, and the later leaves that its ball reaches. Rows that
        only visit (their home is elsewhere) go to all leaves that their ball reaches."""
        visits = np.zeros(len(fps), bool) if visits is None else visits
        row, node, home = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.ones(len(fps), bool)
        own, out = np.zeros(len(fps), np.int64), []
        while len(row):
            ended = self.leaf[node] >= 0
            out.append((row[ended], self.leaf[node[ended]], home[ended]))
            row, node, home = row[~ended], node[~ended], home[~ended]
            d, b = distance(fps[row], self.point[node]).astype(np.int64), self.bound[node]
            left, right = d - radius <= b, d + radius > b
            row, home, node = np.concatenate([row[left], row[right]]), np.concatenate([home[left] & (d <= b)[left], home[right] & (d > b)[right]]), np.concatenate([self.left[node[left]], self.right[node[right]]])
        if not out:
            return row, node, home
        row, leaf, home = (np.concatenate(x) for x in zip(*out, strict=True))
        own[row[home]] = leaf[home]
        keep = home | (leaf > own[row]) | visits[row]
        return row[keep], leaf[keep], home[keep] & ~visits[row[keep]]


def close_pairs(have: np.ndarray, ask: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (in ask, in have) within radius, by recursion over a local vantage-point tree of have."""
    found = []

    def visit(h: np.ndarray, a: np.ndarray) -> None:
        if not len(h) or not len(a):
            return
        near = None
        if len(h) > LOCAL:
            p = have[h[len(h) // 2]]
            d = distance(have[h], p).astype(np.int64)
            b = int(np.median(d))
            near = d <= b
            if near.all():
                near = d < b
                b -= 1
            if not near.any():
                near = None
        if near is None:
            for at in range(0, len(a), 1024):
                x, y = np.nonzero(distance(have[h][None, :], ask[a[at : at + 1024]][:, None]) <= radius)
                found.append((a[at + x], h[y]))
            return
        e = distance(ask[a], p).astype(np.int64)
        visit(h[near], a[e - radius <= b])
        visit(h[~near], a[e + radius > b])

    visit(np.arange(len(have)), np.arange(len(ask)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def least_members(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least reachable index of each of n vertices, by hooking and pointer jumping."""
    label = np.arange(n)
    while True:
        old = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        if (old == label).all():
            return label


def _stars(have: np.ndarray, ask: np.ndarray, radius: int) -> np.ndarray:
    """Rows (fingerprint, least of its local component): for all members but the least."""
    both = np.unique(np.concatenate([have, ask]))
    i, j = close_pairs(have, ask, radius)
    label = least_members(len(both), np.searchsorted(both, ask[i]), np.searchsorted(both, have[j]))
    moved = label != np.arange(len(both))
    return np.stack([both[moved], both[label[moved]]])


# --- links and components -------------------------------------------------------------------------------------------


def _routed(fps: DataFrame, tree: PartitionTree, radius: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            f = batch.column("fp").to_numpy().view(np.uint64)
            row, leaf, home = tree.route(f, radius)
            yield pa.RecordBatch.from_arrays([pa.array(f[row].view(np.int64)), pa.array(leaf), pa.array(home)], names=["fp", "leaf", "home"])

    return fps.select("fp").mapInArrow(run, "fp long, leaf long, home boolean")


def _deeper(routed: DataFrame, radius: int) -> DataFrame:
    """routed (checkpointed) with full leaves cut by trees of their own, level by level. The order of leaves is kept."""
    before = None
    while True:
        full = cut(routed.where("home").groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FULL))
        work = full.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0.0  # as comparisons in a leaf go
        if not work or (before is not None and work > 0.9 * before):
            return routed
        before = work
        full = full.select("leaf", "n", F.ceil(F.col("n") / FULL).cast("int").alias("salts"))
        # fingerprints are distinct, so a share by hash is a sample of bounded size
        share = F.least(F.lit(1.0), F.lit(float(FAN * TWIG)) / F.col("n"))
        some = routed.where("home").join(full, "leaf").where(F.pmod(F.xxhash64("fp", F.lit(13)), F.lit(1 << 20)) < share * (1 << 20))

        def grow(key, pdf):
            tree = PartitionTree(pdf["fp"].to_numpy(np.int64).view(np.uint64), int(min(FAN, max(2, -(-int(pdf["n"].iloc[0]) // LEAF)))))
            return pd.DataFrame({"leaf": [key[0]], "point": [tree.point.view(np.int64)], "bound": [tree.bound], "left": [tree.left], "right": [tree.right], "number": [tree.leaf]})

        arrays = "point array<long>, bound array<long>, left array<long>, right array<long>, number array<long>"
        trees = cut(some.select("leaf", "n", "fp").groupBy("leaf").applyInPandas(grow, f"leaf long, {arrays}"))
        salted = trees.join(full, "leaf").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("n", "salts")
        cutting = full.join(trees.select("leaf"), "leaf")
        both = routed.join(cutting, "leaf", "left")
        stays = both.where("salts IS NULL").select("fp", (F.col("leaf") * FAN).alias("leaf"), "home")
        moves = both.where("salts IS NOT NULL").select("fp", "leaf", "home", F.pmod(F.xxhash64("fp", F.lit(17)), F.col("salts")).cast("int").alias("salt"))

        def onward(rows, tree):
            if not len(rows) or not len(tree):
                return pd.DataFrame({"fp": np.zeros(0, np.int64), "leaf": np.zeros(0, np.int64), "home": np.zeros(0, bool)})
            t, f = tree.iloc[0], rows["fp"].to_numpy(np.int64)
            row, leaf, home = PartitionTree.of(t["point"], t["bound"], t["left"], t["right"], t["number"]).route(f.view(np.uint64), radius, ~rows["home"].to_numpy(bool))
            return pd.DataFrame({"fp": f[row], "leaf": int(t["leaf"]) * FAN + leaf, "home": home})

        moved = moves.groupBy("leaf", "salt").cogroup(salted.groupBy("leaf", "salt")).applyInPandas(onward, "fp long, leaf long, home boolean")
        routed = cut(stays.unionByName(moved))


def links(fps: DataFrame, *, radius: int = RADIUS) -> DataFrame:
    """Edges (a long, b long) that connect exactly the distinct fingerprints (fp long) linked within radius."""
    spark = fps.sparkSession
    bound_batches(spark)
    n = fps.count()
    sample = [r[0] for r in hash_sample(fps.select("fp"), ["fp"], SAMPLE, 7, n).collect()]
    tree = PartitionTree(np.array(sample, np.int64).view(np.uint64), min(max(2, n // LEAF), SAMPLE // 16))
    routed = _deeper(cut(_routed(fps, tree, radius)), radius)
    sizes = routed.where("home").groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = routed.join(sizes, "leaf", "left").withColumn("blocks", F.coalesce("blocks", F.lit(0)))
    placed = placed.withColumn("own", F.when(F.col("home"), F.pmod(F.xxhash64("fp"), F.greatest("blocks", F.lit(1))).cast("int")).otherwise(-1))
    first = F.greatest("own", F.lit(0))
    placed = placed.where("blocks > 0").withColumn("block", F.explode(F.sequence(first, F.col("blocks") - 1)))
    placed = placed.select("leaf", "block", (F.col("own") != F.col("block")).cast("int").alias("visits"), "fp")

    def run(batches):
        key, have, ask = None, [], []

        def search(last: bool):
            nonlocal ask, have
            out, held = [], np.concatenate(have) if have else np.zeros(0, np.uint64)
            if len(held) and (ask or last):
                out.append(_stars(held, np.concatenate([held, *ask]) if last else np.concatenate(ask), radius))
            ask, have = [], [held]
            return out

        def emit(made):
            for e in made:
                if e.shape[1]:
                    yield pa.RecordBatch.from_arrays([pa.array(e[0].view(np.int64)), pa.array(e[1].view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("leaf", "block")]).T
            f, visits = batch.column("fp").to_numpy().view(np.uint64), batch.column("visits").to_numpy()
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(f)]
            for s, e in zip(starts, starts[1:], strict=False):
                if key != (k := tuple(keys[s])):
                    yield from emit(search(True))
                    key, have, ask = k, [], []
                have.append(f[s:e][visits[s:e] == 0])
                ask.append(f[s:e][visits[s:e] == 1])
                if sum(map(len, ask)) >= CHUNK:
                    yield from emit(search(False))
        yield from emit(search(True))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartition(parts, "leaf", "block").sortWithinPartitions("leaf", "block", "visits")
    return ordered.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(v long, label long): the least vertex, as a signed number, that each vertex of edges(a, b) reaches."""
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = cut(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("label")))
    while True:
        seen = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("label").alias("m"))
        near = labels.join(seen, labels["v"] == seen["a"]).select("v", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        onward = labels.select(F.col("v").alias("w"), F.col("label").alias("next"))
        new = unsized(near.join(onward, near["label"] == onward["w"], "left").select("v", "old", F.least("label", "next").alias("label")))
        labels, changed = new.select("v", "label"), new.where("old != label").limit(1).count()
        if not changed:
            return labels


def near_duplicates(docs: DataFrame, *, text: str = "text", key: str = "doc_id", width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id: a row for each row of docs."""
    read = spread(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))
    rows = cut(fingerprints(read, text="text", width=width).select("doc_id", "fp"), compact=True)
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    labels = components(links(distinct, radius=radius))
    labelled = distinct.join(labels, distinct["fp"] == labels["v"], "left").select("fp", "least", "n", F.coalesce("label", "fp").alias("label"))
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    by_fp = cut(labelled.select("fp", "n", "label").join(least, "label").select("fp", "n", "component_id"))
    total = by_fp.agg(F.sum("n")).first()[0] or 0
    hot = by_fp.where(F.col("n") > HOT_SHARE * total).select("fp", F.col("component_id").alias("_c"), F.lit(True).alias("_hot"))
    marked = rows.join(F.broadcast(hot), "fp", "left")  # at most 1 / HOT_SHARE rows
    many = marked.where("_hot").select("doc_id", "fp", F.col("_c").alias("component_id"))
    rest = marked.where("_hot IS NULL").select("doc_id", "fp").join(by_fp.select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
    return many.unionByName(rest).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs.select("doc_id", "text"))


def similar_links(sketches: DataFrame, sets: Callable[[DataFrame], DataFrame], similarity: float, labels: DataFrame) -> DataFrame:
    """Edges (a long, b long) between fingerprints of texts of at least that similarity of shingle sets, which with labels
    connect what is found. sketches: fp, size, bands (checkpointed); sets gives (fp, shingles binary: sorted unsigned 64-bit
    hashes) of a table of fp; labels (v, label): components known before. There are at most BANDS rounds. A bucket whose
    members are all of one component goes no further, as links in it would join nothing. The centre of a bucket is the one of the
    least hash with it, so that texts which share many buckets meet many centres."""
    spark = sketches.sparkSession
    bound_batches(spark)
    named = sketches.join(labels, sketches["fp"] == labels["v"], "left").withColumn("label", F.coalesce("label", "fp"))
    left = named.select("fp", "size", "label", F.posexplode("bands").alias("last", "value")).select("fp", "size", "label", "last", F.xxhash64("last", "value").alias("bucket"))
    edges, have = None, None
    while True:
        centres = left.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("fp", "bucket"), "fp", "size", "label")).alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("bucket", F.col("c.fp").alias("centre"), F.col("c.size").alias("other"), F.col("c.label").alias("home"))
        met = cut(left.join(centres, "bucket").where("fp != centre"))
        if not met.limit(1).count():
            return edges if edges is not None else spark.createDataFrame([], "a long, b long")
        if have is None:
            have = cut(sets(met.select("fp").union(met.select("centre")).distinct()))
        fits = F.least("size", "other") >= F.lit(similarity) * F.greatest("size", "other")
        pairs = cut(met.where(fits & (F.col("label") != F.col("home"))).select("centre", "fp", "home", "label").distinct())
        # up to FEW pairs go to the sets, so that sets are not shuffled again in each round; more are joined by a shuffle
        small = F.broadcast if pairs.count() <= FEW else (lambda df: df)
        salts = pairs.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("salts"))
        pairs = pairs.join(salts, "centre").withColumn("salt", F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int")).drop("salts")
        own = have.select(F.col("fp").alias("centre"), F.col("shingles").alias("theirs")).join(small(salts), "centre").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        both = have.join(small(pairs), "fp").join(own, ["centre", "salt"]).select("centre", "fp", "home", "label", "shingles", "theirs")

        def verify(batches):
            for batch in batches:
                keep = []
                for x, y in zip(batch.column("shingles").to_pylist(), batch.column("theirs").to_pylist(), strict=True):
                    x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(common >= similarity * (len(x) + len(y) - common))
                take = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(take) for c in ("centre", "fp", "home", "label")], names=["a", "b", "home", "label"])

        found = cut(both.mapInArrow(verify, "a long, b long, home long, label long"))
        edges = found.select("a", "b") if edges is None else edges.unionByName(found.select("a", "b"))
        # centres and members of their component are done in this bucket; the others meet again where they share a later band too
        joined = components(found.select(F.col("home").alias("a"), F.col("label").alias("b")))
        of = lambda c: joined.select(F.col("v").alias(c), F.col("label").alias(f"_{c}"))
        rest = met.join(of("label"), "label", "left").join(of("home"), "home", "left").withColumn("label", F.coalesce("_label", "label"))
        rest = cut(rest.where(F.col("label") != F.coalesce("_home", "home")).select("fp", "label", "last", "bucket"))
        mixed = rest.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("bucket")
        later = rest.join(mixed, "bucket", "left_semi").join(sketches.select("fp", "size", F.posexplode("bands").alias("band", "value")), "fp").where("band > last")
        left = unsized(later.select("fp", "size", "label", F.col("band").alias("last"), F.xxhash64("bucket", "band", "value").alias("bucket")))


def deduplicate(docs: DataFrame, *, text: str = "text", key: str = "doc_id", width: int = NEAR_WORDS, radius: int = RADIUS, similarity: float | None = NEAR) -> DataFrame:
    """The rows of docs, all columns, that stay: one of each component, with the smallest key (nulls last). Documents are linked
    by fingerprints of width-word shingles within radius, and by a similarity of their shingle sets if given."""
    narrow = spread(docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text")))

    def setup():
        def kernel(batch):
            made = [sketch(t, width, similarity is not None) for t in batch.column("_text").to_pylist()]
            return {"fp": pa.array(np.array([m[0] for m in made], np.uint64).view(np.int64)), "size": pa.array([m[1] for m in made], pa.int64()), "bands": pa.array([np.array(m[2], np.uint64).view(np.int64) for m in made], pa.list_(pa.int64()))}

        return kernel

    rows = cut(arrow_map(narrow, setup, "fp long, size long, bands array<long>").drop("_text"), compact=True)
    first = F.min(F.struct(F.col("_key").isNull().alias("no"), "_key", "_hash", "size", "bands")).alias("first")
    distinct = cut(rows.groupBy("fp").agg(first))
    edges = links(distinct, radius=radius)
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct(F.col(key).alias("_key"), F.xxhash64(text).alias("_hash")).alias("id"))
    if similarity is not None:
        named = F.struct("first._key", "first._hash").alias("id")

        def sets(wanted: DataFrame) -> DataFrame:
            """Shingles of the text that stands for each fingerprint; rows with one key and text have the same."""
            of = distinct.join(wanted, "fp").select(named, "fp")

            def setup():
                return lambda batch: {"shingles": pa.array([shingle_set(t, width).astype("<u8").tobytes() for t in batch.column("_text").to_pylist()], pa.binary())}

            texts = docs.select(F.struct(F.col(key).alias("_key"), F.xxhash64(text).alias("_hash")).alias("id"), F.col(text).alias("_text"))
            if rows.groupBy("_key", "_hash").count().where("count > 1").limit(1).count():
                texts = texts.join(of, "id", "left_semi").groupBy("id").agg(F.first("_text").alias("_text"))
            return arrow_map(texts.join(of, "id").select("fp", "_text"), setup, "shingles binary").select("fp", "shingles")

        known = components(edges)
        more = similar_links(cut(distinct.select("fp", "first.size", "first.bands")), sets, similarity, known)
        edges = known.select(F.col("v").alias("a"), F.col("label").alias("b")).unionByName(more)
    labels = components(edges)
    labelled = distinct.join(labels, distinct["fp"] == labels["v"], "left").select(F.struct("first.no", "first._key", "first._hash").alias("first"), F.coalesce("label", "fp").alias("label"))
    stays = labelled.groupBy("label").agg(F.min("first").alias("first")).select(F.struct("first._key", "first._hash").alias("id"))
    repeated = rows.groupBy(F.struct("_key", "_hash").alias("id")).agg((F.count(F.lit(1)) > 1).alias("many")).where("many")
    if not repeated.limit(1).count():
        return marked.join(stays, "id", "left_semi").select("row.*")
    # of rows with one key and text one stays: those of the least partition are numbered, and only those
    kept = marked.join(cut(stays.join(repeated, "id", "left")), "id")
    some = cut(kept.where("many").select("row", "id", F.spark_partition_id().alias("part")))
    least = some.groupBy("id").agg(F.min("part").alias("part"))
    one = some.join(least, ["id", "part"]).withColumn("at", F.row_number().over(Window.partitionBy("id").orderBy(F.lit(0)))).where("at = 1")
    return kept.where("many IS NULL").select("row.*").unionByName(one.select("row.*"))
