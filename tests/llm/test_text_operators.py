"""Operators over documents against brute force, and on awkward rows."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import media, mixing, packing, quality, sharding, simhash, toxicity
from tidemark.llm.queries import QUERIES

LONG = "alpha beta gamma " * 40_000
ROWS = [
    (1, "one two three four five", "s1"), (2, "one two three four five", "s1"), (2, "one two three four five", "s1"), (3, "", "s2"), (4, None, None),
    (None, "lonely words here", "s2"), (None, None, None), (5, "   \n\t ", "s3"), (6, LONG, "s3"), (7, "été ünïcode   日本語 <|endoftext|> x", "s1"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like the operators' own."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit("clash") for c in ("score", "shard", "slot", "media", "payload", "fp", "size", "stats", "ids", "target", "copies", "label", "best", "a", "Codec")})


@pytest.fixture(scope="module")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def empty(df):
    return df.where("false")


def words(text):
    return (text or "").encode().split()


# --- media ---


def check_media(out, rows):
    by = {}
    for r in out:
        by.setdefault(r.doc_id, r)
    for doc_id, text in rows:
        raw = (text or "").encode()
        full = raw + bytes(-len(raw) % 64 if raw else 64)
        r = by[doc_id]
        if sum(x[0] == doc_id for x in rows) == 1:
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))


def test_media_round_trip(spark, awkward, docs):
    out = media.op1(awkward).collect()
    assert len(out) == len(ROWS)
    check_media(out, [r[:2] for r in ROWS])
    assert {r.feature for r in out if r.doc_id in (1, 2)}.__len__() == 1
    check_media(media.op1(docs).collect(), [tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert media.op1(empty(awkward)).count() == 0


def test_codecs_by_definition():
    mu, al = media.mulaw_table(), media.alaw_table()
    assert (mu[0], mu[127], mu[128], mu[255]) == (-32124, 0, 32124, 0) and len(set(mu.tolist())) == 255
    assert (al[0x55], al[0xD5], al[0x2A], al[0xAA]) == (-8, 8, -32256, 32256) and len(set(al.tolist())) == 256
    rng = np.random.default_rng(0)
    blocks = rng.integers(0, 256, (5, 64), np.uint8)
    steps = list(map(int, media.STEPS.split()))
    for block, got in zip(blocks, media.decode_ima(blocks), strict=True):
        value, index = int.from_bytes(bytes(block[:2]), "little", signed=True), min(int(block[2]), 88)
        want = [value]
        for byte in block[4:]:
            for code in (int(byte) & 15, int(byte) >> 4):
                step = steps[index]
                d = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - d if code & 8 else value + d))
                index = max(0, min(88, index + media.MOVES[code & 7]))
                want.append(value)
        assert got.tolist() == want
    assert media.resample(np.array([0, 10, -4], np.int16), 8000, 16000).tolist() == [0, 5, 10, 3, -4, -4]
    assert media.resample(np.array([0, 10, 20, 30], np.int16), 8000, 4000).tolist() == [0, 20]


# --- near-duplicates ---


def brute_fingerprint(text, width=3):
    w = [x for x in words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    if not w:
        return 0
    grams = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs, radius=2):
    parent = list(range(len(pairs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= radius:
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(pairs):
        groups[root(i)].append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return [least[root(i)] for i in range(len(pairs))]


def test_simhash_against_all_pairs(spark, docs, awkward):
    for df in (docs, awkward):
        rows = [(r.doc_id, brute_fingerprint(r.text)) for r in df.select("doc_id", "text").collect()]
        want = sorted(zip([d or -1 for d, _ in rows], [f"{f:016x}" for _, f in rows], [c or -1 for c in brute_components(rows)], strict=True))
        got = sorted((r.doc_id or -1, r.fingerprint, r.component_id or -1) for r in simhash.op4(df).collect())
        assert got == want
    assert simhash.op4(empty(awkward)).count() == 0


def test_simhash_partition_tree_loses_no_link(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 64, 600, np.uint64)
    flips = (np.uint64(1) << rng.integers(0, 64, (600, 2), np.uint64)).astype(np.uint64)
    fps = np.unique(np.concatenate([base, base ^ flips[:, 0], base ^ flips[:, 0] ^ flips[:, 1]]))
    for name, value in (("LEAF", 40), ("BLOCK", 30), ("CHUNK", 20), ("LOCAL", 8)):
        monkeypatch.setattr(simhash, name, value)
    df = spark.createDataFrame(pd.DataFrame({"fp": fps.view(np.int64)}))
    labels = {r.v: r.label for r in simhash.components(simhash.links(df)).collect()}
    i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2, 1))
    least = simhash.least_members(len(fps), i, j)
    groups = defaultdict(set)
    for k, f in enumerate(fps.view(np.int64).tolist()):
        groups[int(least[k])].add(labels.get(f, f))
    assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)


def test_simhash_deeper_trees_lose_no_link(spark, monkeypatch):
    """Far more fingerprints than the first tree has leaves for: full leaves are cut again and every link is found."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 64, 1500, np.uint64)
    flips = (np.uint64(1) << rng.integers(0, 64, (1500, 2), np.uint64)).astype(np.uint64)
    dense = base[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))  # a tight group that no tree can cut
    fps = np.unique(np.concatenate([base, base ^ flips[:, 0], base ^ flips[:, 0] ^ flips[:, 1], dense]))
    for name, value in (("SAMPLE", 64), ("LEAF", 40), ("BLOCK", 60), ("CHUNK", 20), ("LOCAL", 8), ("FULL", 80), ("FAN", 4), ("TWIG", 8)):
        monkeypatch.setattr(simhash, name, value)
    df = spark.createDataFrame(pd.DataFrame({"fp": fps.view(np.int64)})).repartition(8)
    first = simhash.cut(simhash._routed(df, simhash.PartitionTree(fps[::60], 4), 2))
    deep = simhash._deeper(first, 2)
    assert deep.where("home").count() == len(fps) and deep.select("leaf").distinct().count() > 16
    assert deep.where("home").groupBy("leaf").count().agg(F.max("count")).first()[0] < first.where("home").groupBy("leaf").count().agg(F.max("count")).first()[0]
    i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2, 1))
    home = {r.fp: r.leaf for r in deep.where("home").collect()}
    visits = {(r.fp, r.leaf) for r in deep.where("not home").collect()}
    signed = fps.view(np.int64)
    for a, b in zip(signed[i].tolist(), signed[j].tolist(), strict=True):  # of two linked ones the one of the lower leaf visits
        low, high = sorted((a, b), key=lambda f: home[f])
        assert home[low] == home[high] or (low, home[high]) in visits
    labels = {r.v: r.label for r in simhash.components(simhash.links(df)).collect()}
    least = simhash.least_members(len(fps), i, j)
    groups = defaultdict(set)
    for k, f in enumerate(signed.tolist()):
        groups[int(least[k])].add(labels.get(f, f))
    assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)


def brute_groups(texts, width=5, radius=2, similarity=0.8):
    """Group number of each text by all pairs: fingerprints within radius, or shingle sets of that similarity."""
    fps = [brute_fingerprint(t, width) for t in texts]
    sets = []
    for t in texts:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            near = (fps[i] ^ fps[j]).bit_count() <= radius
            if not near and min(len(a), len(b)) >= similarity * max(len(a), len(b), 1) and a:
                near = len(a & b) >= similarity * len(a | b)
            if near:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(texts))]


def test_deduplicate_keeps_one_of_each_group(spark, docs, awkward):
    for df in (docs, awkward):
        kept = simhash.deduplicate(df)
        assert kept.columns == df.columns
        rows = df.select("doc_id", "text").collect()
        least = {}
        for r, g in zip(rows, brute_groups([r.text for r in rows]), strict=True):
            least[g] = min(least.get(g, (True, 0)), (r.doc_id is None, r.doc_id or 0))
        stays = [(r.doc_id is None, r.doc_id or 0) for r in kept.collect()]
        assert sorted(stays) == sorted(least.values())
    assert simhash.deduplicate(empty(awkward)).count() == 0


def test_near_copies_are_one_group(spark, monkeypatch):
    """Edited copies beyond the fingerprints' radius, a chain of them, a hot group, and texts that share a passage only."""
    monkeypatch.setattr(simhash, "MEMBERS", 16)
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    texts = []

    def edited(own, n):
        own = list(own)
        for at in rng.choice(len(own), n, replace=False):
            own[at] = word()
        return own

    passage = [word() for _ in range(60)]
    for _ in range(25):
        own = [word() for _ in range(200)]
        texts += [own, edited(own, 3), edited(own, 3)]
    hot = [word() for _ in range(300)]
    texts += [edited(hot, 2) for _ in range(120)]
    texts += [[word() for _ in range(100)] + passage + [word() for _ in range(100)] for _ in range(30)]
    texts = [" ".join(t) for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    groups = brute_groups(texts)
    least = {g: min(i for i, x in enumerate(groups) if x == g) for g in set(groups)}
    assert len(least) == 25 + 1 + 30
    got = [r.doc_id for r in simhash.deduplicate(df).collect()]
    assert sorted(got) == sorted(least.values())
    without = simhash.deduplicate(df, similarity=None)
    assert without.count() > len(got)


# --- classifiers ---


def auc(score, y):
    order = pd.Series(score).rank()
    n = int(y.sum())
    return (order[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_quality_on_held_out_rows(spark, tiny, docs, labels, awkward):
    got = quality.op5(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert got.held_out.equals(got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0))
    held = got[got.held_out]
    assert auc(held.score.to_numpy(), held.quality.to_numpy()) > 0.97
    assert ((held.score >= 0.3).astype(int) == held.predicted).all()
    out = quality.op5(awkward, labels).collect()
    assert len(out) == len(ROWS) and all(0 <= r.score <= 1 for r in out)
    assert quality.op5(empty(awkward), labels).count() == 0
    assert {r.score for r in quality.op5(awkward, empty(labels)).collect()} == {0.5}
    assert quality.keep(awkward, labels).columns == awkward.columns


def test_quality_never_sees_held_out_labels(spark, docs, labels):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.op5(docs, x).select("doc_id", "score").toPandas().sort_values("doc_id").score.to_numpy() for x in (labels, turned))
    assert (a == b).all()


def test_toxicity_on_held_out_rows(spark, docs, labels, awkward):
    got = toxicity.op6(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    clean = got[got.toxic == 0]
    assert clean.predicted.mean() < 0.02
    english = docs.select("doc_id", "lang").toPandas().merge(got, on="doc_id").query("lang == 'en' and held_out")
    assert auc(english.score.to_numpy(), english.toxic.to_numpy()) > 0.8
    out = toxicity.op6(awkward, labels).collect()
    assert len(out) == len(ROWS) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.op6(empty(awkward), labels).count() == 0
    assert {r.score for r in toxicity.op6(awkward, empty(labels)).collect()} == {0.5}
    assert toxicity.keep(awkward, labels).columns == awkward.columns


def test_toxicity_never_sees_held_out_labels(spark, docs, labels):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.op6(docs, x).select("doc_id", "score").toPandas().sort_values("doc_id").score.to_numpy() for x in (labels, turned))
    assert (a == b).all()


def brute_scores(rows, y, fold):
    """Scores of texts rows by the definition: fitted texts are those of y (text: label) and fold (text: number)."""
    t = toxicity
    sets = {x: t.tokens(set(t.words(x))) for x in y}

    def model(without, limits):
        use = [x for x in y if fold[x] != without]
        size = {k: sum(len(sets[x]) for x in use if y[x] == k) for k in (0, 1)}
        everything = sum(len(t.tokens(set(t.words(x)))) for x in rows)
        odds, a_toxic, a_clean = {}, 0.0, 0.0
        for token in sorted(set().union(*(sets[x] for x in y))):
            n = {k: sum(token in sets[x] for x in use if y[x] == k) for k in (0, 1)}
            if n[1] < t.MIN_TOXIC:
                continue
            raw = np.log((n[1] + 0.5) / (size[1] + 0.5 - n[1])) - np.log((n[0] + 0.5) / (size[0] + 0.5 - n[0]))
            a = t.PRIOR * max(sum(token in t.tokens(set(t.words(x))) for x in rows), sum(token in sets[x] for x in y)) / everything
            p, q = n[1] + a, n[0] + a
            d = np.log(p / (size[1] + t.PRIOR - p)) - np.log(q / (size[0] + t.PRIOR - q))
            if min(d, raw) >= limits[0] and d / np.sqrt(1 / p + 1 / q) >= limits[1]:
                odds[token] = min(d, raw)
                a_toxic, a_clean = a_toxic + p, a_clean + q
        return t.Lexicon(odds, -max(1e-3, np.log((1 - a_clean / (size[0] + t.PRIOR)) / (1 - a_toxic / (size[1] + t.PRIOR)))))

    fitted, n = sorted(y), {x: max(1, len(t.words(x))) for x in y}
    labels = np.array([y[x] for x in fitted], float)
    best, losses, models = [], [], []
    for limits in t.LIMITS:
        models.append({k: model(k, limits) for k in range(t.FOLDS)})
        best.append(np.array([t.best_segment(models[-1][fold[x]], models[-1][fold[x]].memory(), t.words(x))[0] for x in fitted]))
        losses.append(round(t._loss(np.clip(best[-1] - np.log([n[x] for x in fitted]), -50, 50), labels), 6))
    j = int(np.argmin(losses))
    clean = [i for i, x in enumerate(fitted) if y[x] == 0]
    k = min(1.0, max(1e-6, len(clean) / sum(n[fitted[i]] * np.exp(-best[j][i]) for i in clean)))

    def joined(m, text):
        m.k, own = k, t.words(text)
        own_k = k * max(1, len(own))
        found = sorted((x[2] for x in t.passages(m, m.memory(), own, np.log(own_k / t.PASSAGE_E))), reverse=True) if own else []
        sizes = [x - np.log(own_k) for x in found] or [-np.log(own_k)]
        chances = [np.exp(-sizes[0])]
        for r in range(2, len(sizes) + 1):
            if own_k * np.exp(-found[r - 1]) >= t.PASSAGE_E:
                break
            total = sum(sizes[:r])
            chances.append(2 ** (r - 1) * np.exp(-total) * total ** (r - 1) / (math.factorial(r) * math.factorial(r - 1)))
        return -np.log(min(chances))

    a, b = t._logistic(np.clip([joined(models[j][fold[x]], x) for x in fitted], -50, 50), labels)
    last = model(None, t.LIMITS[j])
    return [1 / (1 + np.exp(-(a + b * np.clip(joined(last, x), -50, 50)))) for x in rows], last


def test_toxicity_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(7)
    usual, bad = [f"w{chr(97 + k // 5)}{chr(97 + k % 5)}lo" for k in range(25)], ["scum", "vermin", "filthy", "rotten", "filthier"]
    rows = []
    for i in range(150):
        own = rng.choice(usual, rng.integers(1, 40)).tolist()
        if i % 4 == 0:
            for _ in range(rng.integers(1, 3)):
                at = rng.integers(0, len(own) + 1)
                own[at:at] = rng.choice(bad, rng.integers(1, 5)).tolist()
        rows.append((i, " ".join(own), int(i % 4 == 0 and i % 11 != 0)))
    rows += [(150, rows[0][1], 0), (151, "", 0), (152, None, None), (153, "scum " * 30 + "walo " * 300 + "vermin filthy scum rotten", None)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "PRIOR", 50.0)
    folds = {r.text: r.fold for r in docs.select("text", F.pmod(F.xxhash64("text", F.lit(5)), F.lit(toxicity.FOLDS)).alias("fold")).collect()}
    y = {}
    for i, text, label in rows:
        if label is not None and zlib.crc32(str(i).encode()) % 5:
            y[text] = max(label, y.get(text, 0))
    want, model = brute_scores([t or "" for _, t, _ in rows], y, folds)
    assert model.odds
    for carried in (toxicity.CARRIED, 0):  # candidates in tasks, and in a join
        monkeypatch.setattr(toxicity, "CARRIED", carried)
        got = {r.doc_id: r.score for r in toxicity.op6(docs, labels).collect()}
        assert np.allclose([got[i] for i, _, _ in rows], want, rtol=1e-6, atol=1e-9)


def test_segments_are_maximal():
    rng = np.random.default_rng(2)

    def brute(scores, lo, hi, out):
        best = None
        for i in range(lo, hi):
            for j in range(i + 1, hi + 1):
                s = round(float(scores[i:j].sum()), 9)
                if s > 0 and (best is None or s > best[0] or (s == best[0] and j - i < best[2] - best[1])):
                    best = (s, i, j)
        if best:
            out.append((best[1], best[2], best[0]))
            brute(scores, lo, best[1], out)
            brute(scores, best[2], hi, out)

    for _ in range(60):
        scores = rng.normal(-0.3, 1, 14)
        want = []
        brute(scores, 0, len(scores), want)
        got = [(s, e, round(x, 9)) for s, e, x in toxicity.segments(scores)]
        assert got == sorted(want)
    assert toxicity.segments(np.zeros(0)) == []


def test_words_count_again_in_another_passage(spark):
    words = [f"bad{c}".encode() for c in "abcde"]
    model = toxicity.Lexicon(dict.fromkeys(words, 4.0), -0.05)
    memory, dense, gap = model.memory(), words, [b"fine"] * 700
    at = lambda own: [x[:2] for x in toxicity.passages(model, memory, own, 12.0) if x[2] >= 12]
    assert at([*dense, *gap, *dense]) == [(0, 5), (705, 710)]
    assert at([*dense, *gap[:30], *dense]) == [(0, 5), (35, 40)]
    alone = [x for w in words for x in (w, *gap[:70])]  # 4 - 3.5 each: below significance, but never back at nothing
    for apart in (alone, [x for w in words for x in (w, *gap)]):
        assert at(apart) == [] and at([*apart, *dense]) == [(len(apart), len(apart) + 5)]
    assert at([words[0], *gap[:3]] * 500) == [] and toxicity.best_segment(model, memory, words[:1] * 500) == (4.0, 500)
    assert len(at((dense + gap[:9]) * 3000)) == 3000
    text = b" ".join([*dense, *gap, *dense]).decode()
    out = toxicity._scan(spark.createDataFrame([(text,)], "text string"), model).first()
    assert [(x.start_word, x.end_word) for x in out.passages] == [(0, 5), (705, 710)]


def test_passages_against_all_segments():
    rng = np.random.default_rng(4)
    model = toxicity.Lexicon({b"a": 3.0, b"b": 2.5, b"c": 3.7}, -0.8)

    def value(own):
        return sum(model.odds[w] for w in set(own) & set(model.odds)) + model.other * (len(own) - len(set(own) & set(model.odds)))

    for _ in range(200):
        own = [bytes([c]) for c in rng.choice(list(b"abcxxxxx"), 30)]
        best = max(value(own[i:j]) for i in range(30) for j in range(i + 1, 31))
        assert abs(toxicity.best_segment(model, model.memory(), own)[0] - max(best, 0)) < 1e-6
        found = toxicity.passages(model, model.memory(), own, 4.0)
        assert all(abs(value(own[s:e]) - x) < 1e-6 for s, e, x in found)
        edges = [0, *(p for s, e, x in found if x >= 4 for p in (s, e)), 30]
        for lo, hi in zip(edges[::2], edges[1::2], strict=True):  # nothing of that score is left between them
            assert all(value(own[i:j]) < 4 for i in range(lo, hi) for j in range(i + 1, hi + 1))


# --- mixing ---


def brute_targets(sizes):
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    full, left = set(), float(sum(sizes.values()))
    while True:
        free = [s for s in sizes if s not in full]
        rest = left - sum(3 * sizes[s] for s in full)
        want = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free} if free else {}
        over = {s for s in free if want[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else want[s] for s in sizes}
        full |= over


def test_mixing(spark, docs, awkward):
    for df in (docs, awkward):
        out = mixing.op3(df).toPandas()
        assert len(out) == df.count()
        src = df.select("doc_id", "source", "text").toPandas()
        src["n"] = [len(words(t)) for t in src.text]
        sizes = {None if s != s or s is None else s: int(n) for s, n in src.groupby("source", dropna=False).n.sum().items()}
        want = brute_targets(sizes)
        got = mixing.copies(df).toPandas()
        for s, g in got.groupby("source", dropna=False):
            s = None if s != s else s
            assert abs(g.target.iloc[0] - want[s]) < 1e-6 * max(1, want[s]) and g.source_size.iloc[0] == sizes[s] == g["size"].sum()
            assert abs((g["size"] * g.copies).sum() - want[s]) <= g["size"].max() / 2 + 1e-6
        assert (got.copies.between(0, 3)).all()
        again = mixing.op3(df.repartition(5)).toPandas()
        key = ["doc_id", "size", "target", "taken"]
        assert out.sort_values(key)[key].reset_index(drop=True).equals(again.sort_values(key)[key].reset_index(drop=True))
        mixed = mixing.mix(df)
        assert mixed.columns == df.columns and mixed.count() == int(got.copies.sum())
    assert mixing.op3(empty(awkward)).count() == 0


def test_mixing_many_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 4)
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', 1 + cast(id % 7 as int))").alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    g = mixing.op3(df).toPandas().groupby("source_size").agg(t=("target", "first"), k=("taken", "sum"))
    assert (g.t - g.k).abs().max() <= 3.5


def test_pivotal_steps_keep_expectations(spark, monkeypatch):
    """Over many seeds a document's mean number of copies is its target's share, and a fold's steps keep the mass."""
    monkeypatch.setattr(mixing, "CHUNK", 8)
    df = spark.createDataFrame([(i, "w " * (1 + i % 3), "a" if i % 2 else "b") for i in range(40)], "doc_id long, text string, source string")
    runs = 16
    every = None
    for k in range(runs):
        one = mixing.copies(df, seed=100 + 7 * k).select("doc_id", "source", "size", "copies", "source_size", "target")
        every = one if every is None else every.unionByName(one)
    got = every.toPandas()
    got["share"] = got.target / got.source_size
    got["base"] = np.floor(got.share)
    assert ((got.copies - got.base).isin([0, 1])).all()
    for _, g in got.groupby("source"):
        share = g.share.iloc[0]
        sd = np.sqrt((share % 1) * (1 - share % 1) / runs)
        means = g.groupby("doc_id").copies.mean()
        assert abs(means.mean() - share) < 0.08 and (abs(means - share) < 5 * sd + 1e-9).all()


def test_one_row_repeated_very_often(spark, monkeypatch):
    """A third of all rows are one row: folded as one item, written out by many tasks, each source near its target."""
    monkeypatch.setattr(mixing, "SPREAD", 1000)
    hot = spark.range(100_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("same few words").alias("text"), F.lit("hot").alias("source"), F.col("id").alias("row"))
    cold = spark.range(2_000).select((F.col("id") + 10).alias("doc_id"), F.expr("repeat('w ', 1 + cast(id % 90 as int))").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("source"), F.col("id").alias("row"))
    df = hot.unionByName(cold)
    out = mixing.copies(df)
    got = out.toPandas()
    assert len(got) == 102_000 and got.copies.between(0, 3).all()
    for _, g in got.groupby("source"):
        assert abs((g["size"] * g.copies).sum() - g.target.iloc[0]) <= 45
    same = got[got.doc_id == 5]
    assert sorted(same.occurrence) == list(range(1, 100_001)) and same.copies.max() - same.copies.min() <= 1
    assert out.where("doc_id = 5").select(F.spark_partition_id()).distinct().count() > 1
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() == int(got.copies.sum())
    assert mixed.where("doc_id = 5").count() == int(same.copies.sum())
    assert mixed.where("doc_id = 5").groupBy("row").count().agg(F.max("count")).first()[0] <= 3


# --- packing ---


def test_packing(spark, docs, awkward):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for df in (docs, awkward):
        rows = df.select("doc_id", "text").collect()
        want = sorted((r.doc_id or -1, [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in rows)
        out = packing.op9(df).toPandas()
        out["doc_id"] = out.doc_id.fillna(-1).astype(int)
        pieces = out.sort_values(["doc_id", "start"])
        by = defaultdict(list)
        for d, ids in want:
            by[d].append(ids)
        for d, g in pieces.groupby("doc_id"):
            if len(by[d]) == 1:
                ids, at = by[d][0], 0
                for p in g.itertuples():
                    assert p.start == at and p.doc_tokens == len(ids)
                    assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
                    at += p.length
                assert at == len(ids)
        assert out.length.sum() == sum(len(i) for _, i in want)
        padded = 0
        for _, g in out.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
            assert (g.offset.to_numpy() == np.concatenate([[0], g.length.cumsum()[:-1]])).all()
            n = int(g.length.sum())
            assert n <= 2048
            padded += 0 if n & (n - 1) == 0 else 2048 - n
        assert padded <= 2048 * max(8, df.rdd.getNumPartitions())
        windows = out.groupby("sequence_id").agg(tier=("tier", "first"), step=("step", "first"), steps=("step", "nunique"))
        assert (windows.steps == 1).all()
        for tier, w in windows.groupby("tier"):  # all steps of a tier but its last are full, over all tasks
            sizes = w.groupby("step").size().sort_index()
            room = max(1, packing.STEP_TOKENS // tier)
            assert sizes.index.tolist() == list(range(len(sizes))) and (sizes.iloc[:-1] == room).all() and sizes.iloc[-1] <= room
    assert packing.op9(empty(awkward)).count() == 0


def test_encoders_agree():
    import public_tokenizers as p

    both = packing.Encoder(p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN)
    for text in ("", "a", "Hello  world\n\n x\t", "é" * 50, "don't we'll  I'M", "x" * 5000, "a" * 1999 + " b", "1234 !!?? \r\n", "Ünï çàß   "):
        assert both(text).tolist() == both.whole.encode(text, add_special_tokens=False).ids, text[:40]


def test_encoders_agree_on_random_texts():
    import public_tokenizers as p

    both = packing.Encoder(p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN)
    rng = np.random.default_rng(3)
    kinds = ["abcdefghijklmnopqrstuvwxyz", "ABCXYZ", "0123456789", "!?.,;:'\"-_()[]{}<|>/\\@#$%^&*~`+=", " ", "\n\r\t ", "¡¢£«»°·¿×÷", "àéîõüßñÆØþ", "ĀđĤŁŒŽſ", "日本語 😀\u00a0\u200b\u0301"]
    for _ in range(300):  # words, runs and spaces of all classes
        text = "".join("".join(rng.choice(list(kinds[rng.integers(len(kinds))]), rng.integers(1, 12))) for _ in range(rng.integers(1, 60)))
        assert both(text).tolist() == both.whole.encode(text, add_special_tokens=False).ids, text
    for kind in kinds:  # runs around the limit of the faster encoder
        for n in (1998, 1999, 2000, 2001, 2200):
            for before, after in (("", ""), ("a ", " b"), ("x1", "'s")):
                text = before + "".join(rng.choice(list(kind), n)) + after
                assert both(text).tolist() == both.whole.encode(text, add_special_tokens=False).ids, (kind, n)


# --- sharding ---


def test_sharding(spark, docs, awkward):
    for df in (docs, awkward):
        out = sharding.op10(df).toPandas()
        assert len(out) == df.count() and set(out.shard) <= set(range(16))
        for _, g in out.groupby("shard"):
            assert sorted(g.slot) == list(range(len(g)))
        assert ((out.grown_shard == out.shard) | (out.grown_shard == 16)).all()
        assert (out.groupby("doc_id").shard.nunique() == 1).all()
        want = sorted((len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in df.select("text").collect())
        assert sorted(zip(out["size"], out.text_crc32, strict=True)) == want
    assert sharding.op10(empty(awkward)).count() == 0
    seventeen = sharding.assign_shards(docs.select("doc_id"), ["doc_id"], [1.0] * 17).toPandas().set_index("doc_id").shard
    sixteen = sharding.op10(docs).toPandas().set_index("doc_id").grown_shard
    assert (seventeen.sort_index() == sixteen.sort_index()).all()


def test_slots_of_a_row_repeated_very_often(spark, monkeypatch):
    for name, value in (("BUCKET_ROWS", 64), ("SPREAD", 500)):
        monkeypatch.setattr(sharding, name, value)
    rows = spark.range(20_000).select(F.lit(7).cast("long").alias("k"), F.lit(0).alias("g")).unionByName(spark.range(3000).select((F.col("id") % 900).alias("k"), (F.col("id") % 3).cast("int").alias("g")))
    out = sharding.number_slots(rows, "g", ["k"])
    got = out.toPandas()
    assert len(got) == 23_000 and all(sorted(x.slot) == list(range(len(x))) for _, x in got.groupby("g"))
    assert out.where("k = 7 AND g = 0").select(F.spark_partition_id()).distinct().count() > 1


def test_winner_is_the_largest_score(spark):
    """Each key's shard recomputed from the definition."""
    weights = [1.0, 0.5, 3.0]
    out = sharding.assign_shards(spark.range(300), ["id"], weights, grown_weight=2.0, seed=5).collect()
    for r in out:
        u = [(int(hashlib.md5(f"{r.id}|5|{j}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for j in range(4)]
        scores = [-w / math.log(x) for w, x in zip([*weights, 2.0], u, strict=True)]
        assert r.shard == int(np.argmax(scores[:3])) and r.grown_shard == (3 if scores[3] > max(scores[:3]) else r.shard)


def test_sharding_follows_weights(spark):
    out = sharding.assign_shards(spark.range(40_000), ["id"], [1.0, 2.0, 5.0]).groupBy("shard").count().orderBy("shard").collect()
    assert [abs(r["count"] / 40_000 - w / 8) < 0.01 for r, w in zip(out, (1, 2, 5), strict=True)] == [True] * 3


def test_sharding_slots_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 16)
    rows = spark.range(3000).select((F.col("id") % 500).alias("k"), (F.col("id") % 3).cast("int").alias("g")).unionByName(spark.range(1500).select(F.lit(7).cast("long").alias("k"), F.lit(0).alias("g")))
    out = sharding.number_slots(rows, "g", ["k"]).toPandas()
    assert len(out) == 4500 and all(sorted(x.slot) == list(range(len(x))) for _, x in out.groupby("g"))


def test_queries_run_whole(spark, tiny):
    n = spark.read.parquet(f"{tiny}/documents.parquet").count()
    for name in ("op1_media", "op3_mixing", "op4_simhash", "op5_quality", "op6_toxicity", "op10_sharding"):
        assert QUERIES[name](spark, tiny).count() == n
