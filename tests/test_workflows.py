"""Whole flows, the command line and the demo table."""

import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.operators import audit
from tidemark.plans import workflows
from tidemark.sources.demo import demo_bars


@pytest.fixture(scope="module")
def bars(spark):
    return demo_bars(spark).cache()


def test_demo_is_seeded(spark, bars):
    assert bars.count() == 855 and bars.exceptAll(demo_bars(spark, ("CCC", "BBB", "AAA"))).count() == 0
    assert bars.where("high < greatest(open, close) OR low > least(open, close)").count() == 0


def test_descriptive_flow(bars):
    out = workflows.describe_bars(bars)
    assert out["segments"].count() == out["labels"].count() == out["review_queue"].count() > 0
    merged = out["merged"]
    assert merged.where("n_bars <> end_idx - start_idx + 1 OR n_bars <> duration_bars").count() == 0
    assert 0 < merged.count() <= out["labels"].count()
    assert {r.label for r in merged.select("label").distinct().collect()} <= {"UNKNOWN", *[f"CLUSTER_{c}" for c in "ABCDE"]}


def test_point_in_time_flow(bars):
    out = workflows.causal_states(bars, min_rows=30, every=10)
    assert out["states"].count() > 0
    assert audit.audit_states(out["states"]).agg(F.sum("n")).first()[0] == 0
    assert out["coverage"].agg(F.sum("segments")).first()[0] == out["states"].count()


def test_command_line(spark, bars, tmp_path):
    bars.write.parquet(str(tmp_path / "bars"))
    assert cli.main(["segment", str(tmp_path / "bars"), str(tmp_path / "seg"), "--causal"]) == 0
    assert cli.main(["discover", str(tmp_path / "seg" / "features"), str(tmp_path / "found")]) == 0
    assert cli.main(["review", str(tmp_path / "found" / "labels"), str(tmp_path / "queue"), "--limit", "5"]) == 0
    assert spark.read.csv(str(tmp_path / "queue"), header=True).count() == 5
    assert cli.main(["audit-segments", str(tmp_path / "seg" / "segments"), str(tmp_path / "seg" / "features")]) == 0
    states = spark.read.parquet(str(tmp_path / "found" / "labels")).select("symbol", F.col("available_at").alias("timestamp"), "cumulative_return")
    states.write.parquet(str(tmp_path / "states"))
    assert cli.main(["select", str(tmp_path / "bars"), str(tmp_path / "states"), str(tmp_path / "sel"), "--score", "cumulative_return", "--horizon", "5"]) == 0
    assert spark.read.json(str(tmp_path / "sel" / "summary")).first().status in ("research_candidate", "insufficient_evidence")
