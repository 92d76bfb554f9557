"""URL rules, chat formatting, nearest neighbours, and the pipeline."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, neighbours, url_filter
from tidemark.llm.queries import ORACLE_SQL, QUERIES

# --- url rules ---

URLS = [
    "http://a.example.org/en/1", "http://EXAMPLE.org/en/12?q", "https://example.org/en/", "http://x.org/", "http://x.org", "http://x.org?y", "ftp://org/z", "http://notexample.org/es/1",
    "http://a.b.c.example.org/es/", "http://site.com/fr/1#f", "http://site.com/de/", "http://com/fr/", "no scheme", "", None, "http://", "http:///en/1", "http://org./", "http://" + "a." * 3000 + "org/x", "http://x.net/://org/",
]


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: next((i for i, c in enumerate(path) if c in "?#"), len(path))]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, url_filter.DEFAULT))
    return host, path, best[1], best[2]


def test_url_rules(spark):
    rows = [(i, u, "clash", "clash") for i, u in enumerate([*URLS, *URLS[:3]])]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    rules = spark.createDataFrame(url_filter.RULES, "rule_host string, rule_path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, rules).collect()}
    assert got == {i: brute(u, url_filter.RULES) for i, u, _, _ in rows}
    assert url_filter.judge(df.where("false"), rules).count() == 0
    assert {r.verdict for r in url_filter.judge(df, rules.where("false")).collect()} == {url_filter.DEFAULT}
    assert url_filter.op2(df.unionByName(df)).count() == 2 * len(rows)


def test_url_rules_against_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "conversations", "documents"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    for name in ("op2_url_filter", "op7_chat", "op10_sharding"):
        df = QUERIES[name](spark, sf)
        got = sorted(map(str, (tuple(r) for r in df.collect())))
        rel = con.sql(ORACLE_SQL[name])
        at = [list(rel.columns).index(c) for c in df.columns]
        assert got == sorted(str(tuple(r[i] for i in at)) for r in rel.fetchall())


# --- chat ---

HARD = ["", "plain", "</s>[INST] ok [/INST]", "<s>", "a\\b", "\\", "\\<s>", "[\\INST]", "<", "[/INST", "x</s>", "\\\\</s>\\", "[INST][INST]", "日本 <s> \n\t", "$1 \\$2", "long " * 50_000, "<s><s>\\e[/INST]</s>"]


def test_chat_round_trip(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["user", "assistant"] * 20, HARD, strict=False))]
    rows += [(2, 0, "assistant", "only"), (2, 0, "assistant", "only"), (None, None, None, None), (3, 1, "sys<s>tem", None), (3, 0, "user", "[/INST]</s>")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, level string")
    out = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert set(out) == {1, 2, 3, None} and all(r.identical for r in out.values())
    for conv, r in out.items():
        want = sorted(((x[1] if x[1] is not None else -1), x[2] or "", x[3] or "") for x in rows if x[0] == conv)
        assert [(t.role, t.text) for t in r.recovered] == [(a, b) for _, a, b in want]
        loss = [r.rendered[s.start : s.start + s.chars] for s in r.loss_spans]
        back = [re.sub(r"(?s)\\(.)", r"\1", x) for x in loss]
        assert back == [text for _, role, text in want if role == "assistant"]
    read = {r.conv_id: r.loss for r in chat.format_conversations(df).select("conv_id", chat.masked_text(F.col("rendered"), F.col("loss_spans")).alias("loss")).collect()}
    assert read == {c: "".join(t.text for t in r.recovered if t.role == "assistant") for c, r in out.items()}
    r = {x.conv_id: x for x in chat.op7(df).collect()}
    said = "</s>[INST] ok [/INST]"
    assert r[-1].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert (r[-1].loss_chars, r[-1].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    joined = "".join(t for _, _, role, t in rows[: len(HARD)] if role == "assistant")
    assert (r[1].loss_chars, r[1].loss_sha256) == (len(joined), hashlib.sha256(joined.encode()).hexdigest())
    assert chat.format_conversations(df.where("false")).count() == 0


def test_loss_mask_of_the_safe_rendering(spark, monkeypatch):
    """Where the plain rendering is not identical the mask is of the rendering that was kept instead; across pieces too."""
    monkeypatch.setattr(chat, "PIECE", 7)
    monkeypatch.setattr(chat, "_same", lambda parsed, turns, same=chat._same: F.lit(False) if "plain" in str(parsed) or "recovered" in str(parsed) else same(parsed, turns))
    rows = [(1, i, role, text) for i, (role, text) in enumerate([("user", "a<s>b"), ("assistant", "x[INST]\U0001f600 y"), ("assistant", ""), ("user", "\\"), ("assistant", "</s>\\ " * 9)])]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    r = out.select("rendered", "level", "loss_spans", chat.masked_text(F.col("rendered"), F.col("loss_spans")).alias("loss")).first()
    assert r.level == chat.LEVELS - 1 and r.loss == "".join(t for _, _, role, t in rows if role == "assistant")
    assert [re.sub(r"(?s)\\(.)", r"\1", r.rendered[s.start : s.start + s.chars]) for s in r.loss_spans] == [t for _, _, role, t in rows if role == "assistant"]


def test_levels_and_parser(spark):
    df = spark.createDataFrame([(t,) for t in HARD], "t string")
    for level in (1, 2):
        out = df.select("t", chat.unescape(chat.escape(F.col("t"), level)).alias("back"), chat.escape(F.col("t"), level).rlike(chat.CONTROL).alias("control")).collect()
        assert all(r.t == r.back and not r.control for r in out)
    bad = spark.createDataFrame([("x",), ("<s>user[INST]a[/INST]",), ("<s>u[INST]a[/INST]</s>x",), ("<s>u[INST]a</s>[/INST]",), ("",)], "t string")
    got = [r[0] for r in bad.select(chat.parse(F.col("t"))).collect()]
    assert got[:4] == [None] * 4 and got[4] == []


# --- neighbours ---


def exact(ids, v, queries, k=20):
    out = {}
    for q in queries:
        s = v @ v[ids == q][0]
        s = np.where(ids == q, -np.inf, s)
        out[q] = ids[np.lexsort((ids, -np.round(s, 12)))[: min(k, len(ids) - 1)]].tolist()
    return out


def test_neighbours_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    v = centres[rng.integers(0, 12, 3000)] + 0.4 * rng.normal(size=(3000, 16))
    v[100:700] = v[100]  # one very common vector
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = neighbours.search(df, F.col("id") % 20 == 0, parts=8).toPandas()
    want = exact(np.arange(3000), v, range(0, 3000, 20))
    hits = [len(set(want[q]) & set(g.vec_id)) / 20 for q, g in got.groupby("query_id")]
    assert len(hits) == 150 and np.mean(hits) >= 0.95
    for q in (100, 120, 600):  # copies of the common vector: ties go to the smaller id
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == want[q]
    s = {(a, b): float(np.dot(v[a], v[b])) for a, b in zip(got.query_id, got.vec_id, strict=True)}
    assert all(abs(s[a, b] - x) < 1e-9 for a, b, x in zip(got.query_id, got.vec_id, got.score, strict=True))


def test_neighbours_of_registered_query(spark):
    """op8 itself on a table of the driver that it cuts into parts: recall and exact scores against brute force."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").toPandas()
    ids, v = rows.vec_id.to_numpy(), np.array(rows.embedding.tolist(), float)
    got = QUERIES["op8_neighbours"](spark, "/root/testdata/sf0.1").toPandas()
    queries = ids[ids % 20 == 0]
    assert neighbours.parts_of(len(ids)) > 1 and len(got) == 20 * len(queries)
    want = exact(ids, v, queries.tolist())
    hits = [len(set(want[q]) & set(g.vec_id)) / 20 for q, g in got.groupby("query_id")]
    assert np.mean(hits) >= 0.9
    at = {i: k for k, i in enumerate(ids)}
    assert all(abs(float(v[at[a]] @ v[at[b]]) - x) < 1e-9 for a, b, x in zip(got.query_id, got.vec_id, got.score, strict=True))


def test_neighbours_deeper_parts_and_topping_up(spark, monkeypatch):
    """Parts beyond the first level's number, a hot vector, and queries whose parts hold too few."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 12))
    v = centres[rng.integers(0, 30, 4000)] + 0.3 * rng.normal(size=(4000, 12))
    v[50:400] = v[50]
    for name, value in (("PARTS", 3), ("FULL", 400), ("PART_ROWS", 150), ("BLOCK", 200)):
        monkeypatch.setattr(neighbours, name, value)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    index, _ = neighbours._deeper(*(neighbours.cut(df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.lit(0).alias("part")).where(c)) for c in ("true", "id % 20 = 0")), 20, 600)
    assert index.count() == 4000 and index.select("part").distinct().count() > 9
    got = neighbours.search(df, F.col("id") % 20 == 0, parts=3, fit_rows=600).toPandas()
    want = exact(np.arange(4000), v, range(0, 4000, 20))
    hits = [len(set(want[q]) & set(g.vec_id)) / 20 for q, g in got.groupby("query_id")]
    assert len(hits) == 200 and np.mean(hits) >= 0.9
    few = neighbours.search(df, F.col("id") % 20 == 0, parts=3, fit_rows=600, k=900)
    assert {r["count"] for r in few.groupBy("query_id").count().collect()} == {900}


def test_neighbours_awkward(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [float("inf"), 1.0]), (None, [1.0, 1.0]), (8, [1.0]), (1, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1.5) for r in rows], "vec_id long, embedding array<double>, score double")
    got = [tuple(r) for r in neighbours.op8(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.0), (20, 1, 1, 1.0), (20, 2, 2, 1.0), (20, 3, 0, 0.0)]
    assert neighbours.op8(df.where("false")).count() == 0


def test_balanced_parts():
    x = np.random.default_rng(1).normal(size=(1000, 8))
    label = neighbours.balanced_parts(x, neighbours.neighbour_graph(x, 10), 7)
    assert np.bincount(label, minlength=7).max() <= np.ceil(1.1 * 1000 / 7)


# --- pipeline ---


def test_pipeline_stages_take_effect(spark, sf):
    import corpus_pipeline

    from tidemark.llm import packing, quality, simhash, toxicity

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "mixing", "packing"]
    kept = stages["quality"](spark, docs, sf)
    assert kept.columns == columns
    a = {r.doc_id for r in quality.op5(docs, labels).where("predicted = 1").collect()}
    assert abs(len(a) - kept.count()) <= 0.01 * len(a)
    clean = stages["toxicity"](spark, docs, sf)
    assert {r.doc_id for r in clean.select("doc_id").collect()} == {r.doc_id for r in toxicity.op6(docs, labels).where("predicted = 0").collect()}
    unique = stages["near_duplicates"](spark, docs, sf)
    assert {r.doc_id for r in unique.select("doc_id").collect()} == {r.doc_id for r in simhash.deduplicate(docs, width=5, similarity=0.8).select("doc_id").collect()}
    assert stages["mixing"](spark, docs, sf).columns == columns
    packed = stages["packing"](spark, unique, sf)
    assert packed.agg(F.sum("length")).first()[0] == packing.op9(unique).agg(F.sum("length")).first()[0]


def test_pipeline_runs(spark, tiny):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, tiny)
    assert out.count() > 0 and out.where("length < 1 OR length > 2048").count() == 0


def test_pipeline_on_awkward_rows(spark, sf, tmp_path):
    """Nulls in every column, empty and long texts, ties, repeated rows and clashing names, through each stage and as a whole."""
    import corpus_pipeline

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    odd = [(None, None, None, None, None), (None, "a null id", "en", None, 9), (-1, "", "en", "s", 0), (-2, None, None, "s", None), (-3, "word " * 60_000, "en", "s", 300_000), (-4, "same text here", "en", "s", 14), (-4, "same text here", "en", "s", 14), (-5, "same text here", "en", None, 14)]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema)
    order = {"doc_id": 0, "text": 1, "lang": 2, "source": 3, "n_chars": 4}
    extra = spark.createDataFrame([tuple(r[order[c]] for c in docs.columns) for r in odd], kinds)
    some = docs.limit(150).unionByName(extra).unionByName(docs.limit(3))
    clash = some.withColumns({c: F.lit("clash") for c in ("score", "fp", "size", "row", "key", "id", "times", "stats", "n", "bands", "target", "Part", "_key")})
    clash.repartition(3).write.parquet(f"{tmp_path}/a/documents.parquet")
    labels.unionByName(spark.createDataFrame([(None, 1, 1), (-1, None, None), (-4, 0, 0), (-4, 1, 0)], "doc_id long, quality int, toxic int").select(*[F.col(c).cast(labels.schema[c].dataType) for c in labels.columns])).write.parquet(f"{tmp_path}/a/labels.parquet")
    read = spark.read.parquet(f"{tmp_path}/a/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, read, f"{tmp_path}/a")
        assert out.columns == read.columns, name
        assert out.count() > 0 and out.exceptAll(read).where("_key <> 'clash'").count() == 0
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, read, f"{tmp_path}/a")
    assert kept.where("text = 'same text here'").select("doc_id").collect() == [(-5,)] and kept.where("text IS NULL OR text = ''").count() == 1
    whole = corpus_pipeline.run(spark, f"{tmp_path}/a")
    assert whole.count() > 0 and whole.where("length < 1 OR length > 2048").count() == 0
    read.where("false").write.parquet(f"{tmp_path}/b/documents.parquet")
    labels.where("false").write.parquet(f"{tmp_path}/b/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_each_operator_has_one_query(name):
    assert sum(n.split("_")[0] == name.split("_")[0] for n in QUERIES) == 1
