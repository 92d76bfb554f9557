"""Tree rules, projections, names, silhouettes, corrections and sinks."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.config import GateConfig
from tidemark.operators import calibration, discovery, review

from .test_operators import groups


def labelled(spark):
    side = F.when(F.col("cumulative_return") < -0.05, "DOWN").when(F.col("cumulative_return") > 0.05, "UP").otherwise("FLAT")
    return groups(spark).withColumn("label", side)


def test_tree_rules_name_features(spark):
    text = discovery.tree_rules(labelled(spark), ["cumulative_return", "duration_bars"])
    assert "If (cumulative_return" in text or "If (duration_bars" in text
    assert "no rules" in discovery.tree_rules(labelled(spark).where("label = 'UP'"), ["duration_bars"])


def test_projection_and_silhouette(spark):
    df = labelled(spark)
    out = discovery.project(df, ["cumulative_return", "duration_bars"]).toPandas()
    assert abs(out.pc_1.mean()) < 1e-9 and out.pc_1.std() >= out.pc_2.std()
    assert discovery.silhouette(df, ["cumulative_return", "duration_bars"], "label") > 0.8


def test_suggested_names(spark):
    df = labelled(spark).withColumns({f"prob_{n}": (F.col("label") == n).cast("double") for n in ("DOWN", "FLAT", "UP")})
    names = {r.label: r.suggested for r in discovery.suggest_names(df, ["DOWN", "FLAT", "UP"]).collect()}
    assert names["UP"] == "UPTREND" and names["DOWN"] == "DOWNTREND" and names["FLAT"] in ("RANGE", "TRANSITION")


def test_fit_sample_follows_years(spark):
    df = groups(spark)
    out = discovery.stratified_fit_sample(df, 30, floor=2)
    assert out.count() == 30
    assert [r["count"] for r in out.groupBy(F.year("start")).count().orderBy("year(start)").collect()] == [10, 10, 10]
    assert discovery.training_digest(out) == discovery.training_digest(out.repartition(4))


def test_corrections(spark):
    bars = spark.createDataFrame([("A", dt.datetime(2020, 1, d), d - 1) for d in (1, 2, 3)] + [("A", dt.datetime(2020, 1, 3, 12), 3)], "symbol string, timestamp timestamp_ntz, idx int")
    events = spark.createDataFrame([("A", "2"), ("A", "2020-01-02"), ("A", "2020-01-03"), ("A", "nonsense"), ("A", None)], "symbol string, boundary_start_correction string")
    out = {r.boundary_start_correction: r.start_resolved_idx for r in review.resolve_correction(events, bars).collect()}
    assert out == {"2": 2, "2020-01-02": 1, "2020-01-03": None, "nonsense": None, None: None}


def test_annotations_only_grow(spark, tmp_path):
    events = spark.createDataFrame([("1", "a", "X")], "segment_id string, annotator string, label string")
    for _ in range(2):
        review.append_annotation(str(tmp_path / "log"), events)
    rows = spark.read.parquet(str(tmp_path / "log")).collect()
    assert len(rows) == 2 and len({r.annotation_id for r in rows}) == 2 and all(r.reviewed_at for r in rows)


def test_reviews_fill_the_queue(spark):
    segments = spark.createDataFrame([("1", "UNKNOWN", None), ("2", "A", 0.9)], "segment_id string, label string, recognizability double")
    reviews = spark.createDataFrame([("2", "no", "2024-01-01", ""), ("2", "yes", "2024-01-02", "B")], "segment_id string, accepted string, reviewed_at string, true_label string")
    out = review.review_queue(segments, reviews).collect()
    assert [r.segment_id for r in out] == ["1", "2"] and out[1].accepted == "yes" and out[1].true_label == "B" and tuple(out[0].asDict()) == review.QUEUE


def test_sets_reach_their_quantile(spark):
    df = spark.createDataFrame([("A", 0.5, 0.3, 0.2)], "truth string, prob_A double, prob_B double, prob_C double")
    got = [r.prediction_set for r in calibration.prediction_sets(df, ["A", "B", "C"], 0.7).collect()]
    assert got == [["A", "B"]]


def test_fits_are_of_all_rows(spark, monkeypatch):
    seen = []

    def fit(x, *rest):
        seen.append(len(x))
        raise InterruptedError

    monkeypatch.setattr(discovery, "fit_ensemble", fit)
    rows = spark.range(50_300).select(F.col("id").cast("string").alias("segment_id"), F.col("id").cast("double").alias("x"), F.make_date(F.lit(2000) + (F.col("id") % 3).cast("int"), F.lit(1), F.lit(1)).alias("start"))
    for most in (None, 30):
        try:
            discovery.discover(rows, ["x"], most=most)
        except InterruptedError:
            pass
    assert seen == [50_300, 30]


def test_walk_forward_counts_support_over_all_rows(spark):
    """The only rows of a second cluster are those of the largest hashes, beyond the first 50,000."""
    n, cfg = 50_300, GateConfig(n_clusters=2, ensemble_size=1, max_iter=20)
    day = lambda k: F.lit(dt.datetime(2020, 1, k)).cast("timestamp_ntz")
    rows = spark.range(n).select(F.col("id").cast("string").alias("segment_id"))
    far = [r[0] for r in rows.orderBy(F.desc(F.xxhash64("segment_id", F.lit(cfg.random_state)))).limit(40).collect()]
    i = F.col("segment_id").cast("long")
    side = F.when(F.col("segment_id").isin(far), 500.0).otherwise(0.0)
    train = rows.select("segment_id", F.concat(F.lit("S"), (i % 7).cast("string")).alias("symbol"), day(1).alias("start"), day(2).alias("end"), day(3).alias("available_at"), (side + F.sin(i)).alias("x"))
    ask = spark.range(2).select(F.concat(F.lit("ask"), F.col("id").cast("string")).alias("segment_id"), F.lit("S0").alias("symbol"), day(4).alias("start"), day(5).alias("end"), day(6).alias("available_at"), (500.0 * F.col("id")).alias("x"))
    out = {r.segment_id: r for r in discovery.walk_forward(train.unionByName(ask), ["x"], cfg).where("segment_id LIKE 'ask%'").collect()}
    assert out["ask0"].candidate_label != out["ask1"].candidate_label and out["ask1"].cluster_supported and out["ask1"].oos_train_rows == n
