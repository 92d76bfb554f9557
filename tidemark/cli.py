"""Command line: python -m tidemark.cli COMMAND ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from .config import PipelineConfig, SegmentationConfig
from .operators import audit, discovery, features, labels, review, segments, selection
from .session import session
from .sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *arguments: str, **options) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=options.get("help"))
        for a in arguments:
            c.add_argument(a)
        return c

    c = add("segment", "bars", "out", help="bars to segments with features")
    c.add_argument("--causal", action="store_true")
    c.add_argument("--change-points", action="store_true")
    c.add_argument("--bootstrap", type=int, default=0)
    c.add_argument("--config")
    c = add("discover", "segments", "out", help="label segments, with merged runs, transitions and a review queue")
    c.add_argument("--walk-forward", action="store_true")
    c.add_argument("--features", default=",".join(features.CAUSAL_FEATURES))
    c = add("review", "segments", "out", help="review queue or stratified sample")
    c.add_argument("--sample", type=int)
    c.add_argument("--limit", type=int)
    c = add("select", "bars", "states", "out", help="point-in-time evaluation of a score column of states")
    c.add_argument("--score", required=True)
    c.add_argument("--horizon", type=int, default=20)
    add("audit-segments", "segments", "features", help="exit 1 on a failed check")
    c = add("audit-daily", "daily", "calendar", help="exit 2 on a failed check")
    c.add_argument("--row-limit", type=int, default=6000)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = session()
    read = lambda path: files.read_table(spark, path)
    if a.command == "segment":
        cfg = PipelineConfig.from_json("\n".join(r[0] for r in spark.read.text(a.config).collect())).segmentation if a.config else SegmentationConfig()
        bars = files.read_bars(spark, a.bars)
        out = segments.Segmenter(cfg, causal=a.causal, change_points=a.change_points).fit_predict(bars)
        if a.bootstrap:
            stable = segments.bootstrap_stability(bars, cfg, iterations=a.bootstrap, causal=a.causal, change_points=a.change_points)
            out = segments.fold_in_stability(out, stable, 0.0 if a.causal else 1.0)
        out.write.mode("overwrite").parquet(f"{a.out}/segments")
        out = spark.read.parquet(f"{a.out}/segments")
        out.join(features.segment_features(out, bars), "segment_id").write.mode("overwrite").parquet(f"{a.out}/features")
    elif a.command == "discover":
        rows, names = read(a.segments), a.features.split(",")
        out = discovery.walk_forward(rows, names) if a.walk_forward else discovery.discover(rows, names)
        out.write.mode("overwrite").parquet(f"{a.out}/labels")
        out = spark.read.parquet(f"{a.out}/labels")
        labels.merge_runs(out).write.mode("overwrite").parquet(f"{a.out}/merged")
        labels.transitions(out).write.mode("overwrite").parquet(f"{a.out}/transitions")
        labels.describe_labels(out, names).write.mode("overwrite").parquet(f"{a.out}/descriptions")
        review.review_queue(out).write.mode("overwrite").parquet(f"{a.out}/review_queue")
    elif a.command == "review":
        rows = read(a.segments)
        (review.stratified_sample(rows, a.sample) if a.sample else review.review_queue(rows, limit=a.limit)).write.mode("overwrite").csv(a.out, header=True)
    elif a.command == "select":
        states = read(a.states)
        rows = selection.join_states(files.read_bars(spark, a.bars), states, [c for c in states.columns if c not in ("symbol", "timestamp")])
        report = selection.evaluate(selection.forward_targets(rows, (a.horizon,)), a.score, f"future_excess_{a.horizon}d")
        selection.assess_evidence(report["summary"]).write.mode("overwrite").json(f"{a.out}/summary")
        for name in ("daily_rank_ic", "group_returns", "long_short", "yearly"):
            report[name].write.mode("overwrite").parquet(f"{a.out}/{name}")
    elif a.command == "audit-segments":
        found = audit.audit_segments(read(a.segments), read(a.features)).where("n > 0").collect()
        print(*[f"{r.code}: {r.n}" for r in found] or ["passed"], sep="\n")
        return int(bool(found))
    else:
        found = audit.audit_partitions(read(a.daily), read(a.calendar).select(F.col("trade_date")), row_limit=a.row_limit).groupBy("code").count().collect()
        print(*[f"{r['code']}: {r['count']}" for r in found] or ["passed"], sep="\n")
        return 2 * bool(found)
    return 0


if __name__ == "__main__":
    sys.exit(main())
