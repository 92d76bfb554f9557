"""Behaviour of the operators that SQL counterparts do not pin: invariances, nulls, guards, gates."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.config import GateConfig, PipelineConfig, SegmentationConfig
from tidemark.functions import checks
from tidemark.operators import agreement, asof, bars, calibration, discovery, labels, review, segments, selection

from .test_kernels import walk


def frame(n=240, symbols=("A", "B"), seed=3):
    rows = []
    for k, s in enumerate(symbols):
        b = walk(n, seed + k)
        rows.append(pd.DataFrame({"symbol": s, "timestamp": pd.date_range("2020-01-01", periods=n), **b}))
    return pd.concat(rows, ignore_index=True)


@pytest.fixture(scope="module")
def made(spark):
    return spark.createDataFrame(frame()).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")).cache()


def test_causal_segments_only_grow(spark, made):
    whole = segments.segment_causal(made).toPandas()
    assert len(whole) > 6
    cut = dt.datetime(2020, 6, 1)
    part = segments.segment_causal(made.where(F.col("timestamp") <= F.lit(cut))).toPandas()
    want = whole[whole.available_at <= cut].sort_values("segment_id").reset_index(drop=True)
    assert part.sort_values("segment_id").reset_index(drop=True).equals(want)
    assert (whole.end <= whole.available_at).all() and (whole.n_bars >= 5).all()


def test_offline_segments_cover_the_bars(made):
    out = segments.segment_bars(made, change_points=True).toPandas()
    for _, g in out.groupby("symbol"):
        g = g.sort_values("segment_no")
        assert g.start_idx.iloc[0] == 0 and g.end_idx.iloc[-1] == 239
        assert (g.end_idx.to_numpy()[:-1] == g.start_idx.to_numpy()[1:]).all()
    one = segments.segment_bars(made.where("timestamp = '2020-01-01'")).collect()
    assert [(r.start_idx, r.end_idx) for r in one] == [(0, 0)] * 2


def test_bootstrap_does_not_depend_on_other_symbols(made):
    a = segments.bootstrap_stability(made, iterations=3).where("symbol = 'A'").toPandas()
    b = segments.bootstrap_stability(made.where("symbol = 'A'"), iterations=3).toPandas()
    key = ["boundary_idx"]
    assert a.sort_values(key).reset_index(drop=True).equals(b.sort_values(key).reset_index(drop=True))
    assert a.frequency.between(0, 1).all()
    causal = segments.bootstrap_stability(made, iterations=3, causal=True).where("boundary_idx = 0").toPandas()
    assert (causal.frequency == 1).all()


def test_bootstrap_takes_a_hundred_draws(made, spark, tiny, monkeypatch):
    from tidemark.functions import kernels as K
    from tidemark.plans.catalog import QUERIES

    cfg = SegmentationConfig()
    pdf = made.where("symbol = 'A'").toPandas().sort_values("timestamp")
    b = {c: pdf[c].to_numpy(float) for c in ("open", "high", "low", "close", "volume")}
    find = lambda b: [(i, c) for i, _, c in K.causal_pivots(b["high"], b["low"], b["close"], cfg.atr_period, cfg.atr_reversal)]
    noisy = [find(K.perturb(b, K.keyed_rng(0, "A", k), cfg.bootstrap_price_noise, cfg.bootstrap_volume_noise)) for k in range(100)]
    want = {i: sum(i == 0 or any(abs(i - j) <= cfg.bootstrap_tolerance and d <= c for j, d in x) for x in noisy) / 100 for i, c in find(b)}
    got = segments.bootstrap_stability(made, causal=True).where("symbol = 'A'").collect()
    assert {r.boundary_idx: r.frequency for r in got} == pytest.approx(want)
    draws, real = [], segments.bootstrap_stability
    monkeypatch.setattr(segments, "bootstrap_stability", lambda *a, iterations=100, **b: draws.append(iterations) or real(*a, iterations=iterations, **b))
    for name in ("bootstrap_stability", "bootstrap_stability_causal"):
        assert "boundary_uncertainty" in QUERIES[name](spark, tiny).columns
    assert draws == [100, 100]


def test_whole_interval_tables_overlap(spark, tiny):
    from tidemark.plans.catalog import QUERIES
    from tidemark.sources.fixtures import load

    left = load(spark, tiny, "f3_fixed_segments").toPandas()
    right = segments.segment_causal(load(spark, tiny, "f1_event_bars")).toPandas()
    want = [r.segment_id for r in left.itertuples() if ((right.symbol == r.symbol) & (right.start <= r.end_ts) & (right.end >= r.start_ts)).any()]
    assert 0 < len(want) < len(left)
    assert sorted(r.segment_id for r in QUERIES["interval_overlaps"](spark, tiny).collect()) == sorted(want)


def test_normalize_reads_vendor_types(spark):
    df = spark.createDataFrame([("A", 20200102, "1", "2", "1", "1.5", None), ("A", 20200101, "1", "2", "1", "x", "3"), ("A", 20200101, "1", "2", "1", "2", "4")], "ts_code string, trade_date int, open string, high string, low string, close string, vol string")
    out = [(r.timestamp, r.close, r.volume) for r in bars.normalize(df).orderBy("timestamp").collect()]
    assert out == [(dt.datetime(2020, 1, 1), 2.0, 4.0), (dt.datetime(2020, 1, 2), 1.5, 4.0)]
    with pytest.raises(ValueError, match="missing"):
        bars.normalize(df.drop("open"))


def test_adjustment_needs_an_anchor(spark):
    df = spark.createDataFrame([("A", 10.0, 2.0)], "ts_code string, close double, adj_factor double")
    assert bars.adjust(df, "hfq").first().close == 20.0 and bars.adjust(df, "qfq", 4.0).first().close == 5.0
    with pytest.raises(ValueError, match="anchor"):
        bars.adjust(df, "qfq")


def test_asof_null_keys_and_ties(spark):
    l = spark.createDataFrame([(None, 5), ("k", 5), ("k", 1)], "k string, t int")
    r = spark.createDataFrame([("k", 5, "same"), ("k", 3, "before"), (None, 0, "never")], "k string, u int, v string")
    get = lambda strict: {(x.k, x.t): x.v for x in asof.asof(l, r, on="k", left_time="t", right_time="u", take=["v"], strict=strict).collect()}
    assert get(False) == {(None, 5): None, ("k", 5): "same", ("k", 1): None}
    assert get(True) == {(None, 5): None, ("k", 5): "before", ("k", 1): None}


def test_announcements_as_by_brute_force(spark):
    rng, day = np.random.default_rng(5), lambda k: dt.date(2020, 1, 1) + dt.timedelta(int(k))
    noon = lambda k: dt.datetime.combine(day(k), dt.time(int(k) % 2 * 12))
    times = {s: [noon(k) for k in sorted(rng.choice(120, 40, replace=False))] for s in "AB"} | {"C": [noon(3)]}
    events = []
    for order, s in enumerate(rng.choice(list("ABD"), 600)):
        end = rng.integers(0, 130)
        ann, f_ann = [None if rng.random() < 0.2 else day(end + rng.integers(-15, 20)) for _ in range(2)]
        events.append((str(s), day(end), ann, f_ann, order, float(order)))
    want = {}
    for s, ts in times.items():
        known = []
        for symbol, end, ann, f_ann, order, roe in events:
            at = max((x for x in (ann, f_ann) if x), default=None)
            first = next((t for t in ts if at and symbol == s and t >= dt.datetime.combine(at, dt.time())), None)
            if first and end <= first.date():
                known.append((end, at, order, roe, first))
        for t in ts:
            want[s, t] = max((k[:4] for k in known if k[4] <= t), default=(None,) * 4)
    df = spark.createDataFrame([(s, t) for s, ts in times.items() for t in ts], "symbol string, timestamp timestamp_ntz")
    e = spark.createDataFrame(events, "symbol string, end_date date, ann_date date, f_ann_date date, source_order int, roe double")
    got = {(r.symbol, r.timestamp): (r.report_period, r.effective_at and r.effective_at.date(), r.roe) for r in asof.align_announcements(df, e, ["roe"]).collect()}
    assert got == {k: (v[0], v[1], v[3]) for k, v in want.items()} and len(got) == 81
    assert sum(v[2] is not None for v in got.values()) > 60


def test_unknown_suspension_is_not_false(spark):
    df = spark.createDataFrame([(10.0, 11.0, 9.0, 5.0, 12.0, 8.0, None), (10.0, 11.0, 9.0, 5.0, 12.0, 8.0, False), (12.0, 12.0, 12.0, 5.0, 12.0, 8.0, False)], "close double, high double, low double, volume double, up_limit double, down_limit double, is_suspended boolean")
    assert [(r.tradability_known, r.tradability_eligible) for r in asof.tradability(df).collect()] == [(False, False), (True, True), (True, False)]


def test_look_ahead_is_refused(spark):
    for columns, tokens in ((["future_x"], checks.DISCOVERY_TOKENS), (["fwd_1"], checks.VALIDATION_TOKENS), (["hsmm_label"], checks.STATE_TOKENS)):
        with pytest.raises(ValueError, match="look ahead"):
            checks.reject_look_ahead(columns, tokens)
    with pytest.raises(ValueError, match="look ahead"):
        calibration.CalibratedClassifier(["future_return"])


def panel(spark, n=60, symbols=6):
    rng = np.random.default_rng(1)
    rows = [(f"S{s}", dt.datetime(2021, 1, 1) + dt.timedelta(days=d), float(100 + s + d * 0.1 * (s - 2) + rng.normal()), float(s + rng.normal() * 0.1)) for d in range(n) for s in range(symbols)]
    return spark.createDataFrame(rows, "symbol string, timestamp timestamp_ntz, close double, x double").withColumn("low", F.col("close") - 1)


def test_missing_session_is_not_skipped(spark):
    df = panel(spark, 6, 2).where("NOT (symbol = 'S1' AND timestamp = '2021-01-03')")
    out = selection.forward_targets(df, (2,)).where("symbol = 'S1'").orderBy("timestamp").collect()
    assert out[0].future_excess_2d is None and out[0].target_available_at_2d == dt.datetime(2021, 1, 3)
    assert out[1].future_excess_2d is not None and out[1].future_mae_2d is None


def test_ridge_never_uses_later_targets(spark):
    df = selection.forward_targets(panel(spark), (3,)).cache()
    settings = {"min_dates": 5, "min_rows": 20, "refit_every": 3}
    a = selection.ridge_walk_forward(df, ["x"], "future_excess_3d", **settings)
    cut = F.lit(dt.datetime(2021, 2, 1))
    b = selection.ridge_walk_forward(df.withColumn("future_excess_3d", F.when(F.col("target_available_at_3d") >= cut, F.col("future_excess_3d") * -9).otherwise(F.col("future_excess_3d"))), ["x"], "future_excess_3d", **settings)
    get = lambda r: sorted((x.symbol, x.timestamp, round(x.score, 12)) for x in r.where(F.col("timestamp") <= cut).collect())
    assert get(a) == get(b) and len(get(a)) > 50


def test_ridge_with_two_features_against_numpy(spark):
    df = selection.forward_targets(panel(spark).withColumn("y2", F.col("x") * F.col("x")), (3,)).cache()
    out = selection.ridge_walk_forward(df, ["x", "y2"], "future_excess_3d", min_dates=5, min_rows=20, refit_every=1).toPandas()
    at = sorted(out.timestamp.unique())[10]
    p = df.toPandas()
    t = p[p.target_available_at_3d.notna() & (p.target_available_at_3d < at) & p.future_excess_3d.notna()]
    x, y = t[["x", "y2"]].to_numpy(), t.future_excess_3d.to_numpy()
    m, s = x.mean(0), x.std(0)
    z = (x - m) / s
    beta = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y - y.mean()))
    q = p[p.timestamp == at].sort_values("symbol")
    want = y.mean() + ((q[["x", "y2"]].to_numpy() - m) / s) @ beta
    assert np.allclose(out[out.timestamp == at].sort_values("symbol").score, want)


def test_gates_fail_closed(spark):
    df = spark.createDataFrame([(0.9, 0.1, 0.0, True, False, True, 0.9, "A"), (0.9, 0.1, 0.0, False, False, True, 0.9, "A"), (0.9, 0.1, 0.0, True, False, False, 0.9, "A"), (0.9, None, 0.0, True, None, True, 0.9, "A")], "max_probability double, posterior_entropy double, model_disagreement double, mixture_converged boolean, is_low_density boolean, cluster_supported boolean, recognizability double, candidate_label string")
    out = [(r.unknown_reason, r.label) for r in labels.apply_gates(df, labels.discovery_gates(GateConfig())).collect()]
    assert out == [("", "A"), ("mixture_nonconverged", "UNKNOWN"), ("insufficient_cluster_support", "UNKNOWN"), ("", "A")]


def groups(spark, n=60):
    rng = np.random.default_rng(9)
    rows = [(f"g:{i}", f"S{i % 6}", dt.datetime(2018 + i % 3, 1, 1) + dt.timedelta(days=i), dt.datetime(2018 + i % 3, 1, 1) + dt.timedelta(days=i + 3), dt.datetime(2022, 1, 1) + dt.timedelta(days=i), float((i % 3 - 1) * 0.1 + rng.normal(0, 0.01)), float(5 + 5 * (i % 3) + rng.normal(0, 0.2))) for i in range(n)]
    return spark.createDataFrame(rows, "segment_id string, symbol string, start timestamp_ntz, end timestamp_ntz, available_at timestamp_ntz, cumulative_return double, duration_bars double")


def test_discovery_labels_are_closed_and_sum_to_one(spark):
    out = discovery.discover(groups(spark), ["cumulative_return", "duration_bars"], GateConfig(n_clusters=3)).toPandas()
    ps = [c for c in out if c.startswith("prob_")]
    assert np.allclose(out[ps].sum(axis=1), 1) and set(out.label) <= {"CLUSTER_A", "CLUSTER_B", "CLUSTER_C", "UNKNOWN"}
    assert out[out.label != "UNKNOWN"].groupby("candidate_label").cumulative_return.mean().is_monotonic_increasing
    base = discovery.discover(groups(spark), ["cumulative_return", "duration_bars"], GateConfig(n_clusters=3), backend="gmm").toPandas()
    assert np.allclose(base[ps].sum(axis=1), 1) and (base.label != "UNKNOWN").any()
    alone = discovery.discover(groups(spark).drop("symbol"), ["cumulative_return"], GateConfig(n_clusters=2)).toPandas()
    assert (alone.label == "UNKNOWN").all() and alone.unknown_reason.str.contains("insufficient_cluster_support").all()


def test_soft_assignment_reads_whole_vectors(spark, tiny):
    from tidemark.plans.catalog import QUERIES

    p = spark.read.parquet(f"{tiny}/embeddings.parquet").toPandas().sort_values("vec_id")
    x, names = np.stack(p.embedding).astype(float), sorted(p.label.unique())
    assert x.shape[1] == 64
    lj = np.stack([np.log((p.label == n).mean()) - 0.5 * ((x - (g := x[(p.label == n).to_numpy()]).mean(0)) ** 2 / (s := g.var(0) + 1e-4) + np.log(2 * np.pi * s)).sum(1) for n in names], axis=1)
    e = np.exp(lj - lj.max(axis=1, keepdims=True))
    got = QUERIES["gaussian_soft_assign"](spark, tiny).toPandas().sort_values("vec_id")
    assert got.candidate_label.tolist() == [names[k] for k in lj.argmax(axis=1)]
    assert np.allclose(got.max_probability, (e / e.sum(axis=1, keepdims=True)).max(axis=1), atol=1e-6)


def test_walk_forward_trains_on_the_past(spark):
    out = discovery.walk_forward(groups(spark), ["cumulative_return", "duration_bars"], GateConfig(n_clusters=3), min_rows=20, every=10).toPandas()
    assert (out[out.oos_model_trained_at.isna()].unknown_reason == "insufficient_history").all()
    known = out[out.oos_model_trained_at.notna()]
    assert len(known) and (known.oos_train_max_available_at < known.oos_model_trained_at).all() and (known.oos_model_trained_at <= known.state_available_at).all()


def test_model_survives_json(spark, tmp_path):
    from tidemark.sources.models import load_ensemble, save_ensemble

    x = np.random.default_rng(0).normal(size=(80, 2))
    m = discovery.fit_ensemble(x, ["a", "b"], GateConfig(n_clusters=2))
    save_ensemble(spark, str(tmp_path / "m.json"), m)
    assert np.allclose(load_ensemble(spark, str(tmp_path / "m.json")).score(x)["p"], m.score(x)["p"])


def test_noise_is_a_function_of_the_row(spark):
    df = groups(spark)
    a, b = (discovery.perturb_features(x, ["cumulative_return", "duration_bars"], 0.1, fixed=("duration_bars",)).orderBy("segment_id").toPandas() for x in (df, df.repartition(7)))
    assert np.allclose(a.cumulative_return, b.cumulative_return) and (a.duration_bars == df.orderBy("segment_id").toPandas().duration_bars).all()
    draws = discovery.bootstrap_symbols(df, 4).groupBy("draw").agg(F.sum("multiplicity").alias("n")).collect()
    assert len(draws) == 4 and all(r.n == 6 for r in draws)


def test_label_alignment():
    assert discovery.align_labels([("a", "x", 0.1), ("a", "y", 0.9), ("b", "x", 0.8), ("b", "y", 0.7)]) == {"y": "a", "x": "b"}


def test_consensus_needs_two(spark):
    df = spark.createDataFrame([("1", "a", "X"), ("1", "b", "X"), ("2", "a", "X"), ("3", "a", "X"), ("3", "b", "Y")], "segment_id string, annotator string, label string")
    out = {r.segment_id: (r.consensus_label, r.consensus_reason) for r in agreement.consensus(df).collect()}
    assert out == {"1": ("X", "unanimous"), "2": ("UNKNOWN", "insufficient_independent_raters"), "3": ("UNKNOWN", "label_disagreement")}


def test_confidence_on_a_bin_edge(spark):
    df = spark.createDataFrame([("A", 0.6, 0.4), ("A", 1.0, 0.0)], "truth string, prob_A double, prob_B double")
    assert [r.bin for r in calibration.reliability(df, ["A", "B"]).where("n > 0").orderBy("bin").collect()] == [6, 9]


def test_allocation_is_round_robin(spark):
    rows = [(f"{s}{i}", s, dt.datetime(2020, 1, 1)) for s, n in (("P", 2), ("Q", 5), ("R", 30)) for i in range(n)] + [(f"U{i}", "UNKNOWN", dt.datetime(2020, 1, 1)) for i in range(40)]
    df = spark.createDataFrame(rows, "segment_id string, label string, start timestamp_ntz")
    take = {r.sampling_stratum: r["take"] for r in review.allocation(df, 20, unknown_share=0.35).collect()}
    assert take["2020|UNKNOWN"] == 7 and take["2020|P"] == 2 and sum(take.values()) == 20 and abs(take["2020|R"] - take["2020|Q"]) <= 1 or take["2020|Q"] == 5
    out = review.stratified_sample(df, 20).toPandas()
    assert len(out) == 20 and out.predicted_label.iloc[0] == "UNKNOWN"
    assert out.equals(review.stratified_sample(df.repartition(5), 20).toPandas())


def test_config_from_json():
    c = PipelineConfig.from_json('{"segmentation": {"min_bars": 6, "return_penalty": 1}, "backend": "gmm"}')
    assert c.segmentation.min_bars == 6 and c.backend == "gmm"
    with pytest.raises(ValueError):
        SegmentationConfig(min_bars=0)
