"""Plans that would not hold at scale: pairs of rows, and whole tables in one task."""

import re

import pytest

from tidemark.plans.catalog import QUERIES

NAMES = [
    "discovery_walk_forward", "walk_forward_provenance", "segment_features", "structure_scores", "turnover_costs", "bulk_partition_audit", "daily_build_audit", "artifact_audit", "interval_membership",
    "announcement_alignment", "asof_state_strict", "purged_overlaps", "training_bounds", "review_feedback_repeated", "selection_dataset", "exact_day_metadata",
]


@pytest.mark.parametrize("name", NAMES)
def test_no_pairs_of_rows(name, spark, tiny):
    """No Cartesian product; a nested loop only to spread one aggregated row."""
    plan = QUERIES[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    for inner in re.findall(r"BroadcastNestedLoopJoin[^\n]*\n(.*?)(?=\n\S|\Z)", plan, re.S):
        assert re.search(r"Aggregate\(key(s)?=\[\]|Range|LocalTableScan", inner), name


def test_announcements_read_no_frame_to_the_end(spark, tiny):
    """A frame from a row to the end of its symbol is read again for each row: the square of a symbol's events."""
    plan = QUERIES["announcement_alignment"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "unboundedpreceding$(), currentrow$()" in plan
    assert "unboundedfollowing$()" not in plan
