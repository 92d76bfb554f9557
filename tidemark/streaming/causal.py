"""Causal segments and the dwell filter over streams, one small state a symbol.

Bars of a micro-batch are taken in order of time. A bar at or before the last one its symbol has seen is late and left
out, as prefix stability only holds for ordered bars; put a watermark and a sort before it where sources disorder them.
Replaying a table as a stream gives the rows of the batch operators.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import DurationConfig, SegmentationConfig
from ..functions import kernels as K
from ..operators.labels import probability_columns
from ..operators.segments import CAUSAL

#: The pivot machine, the last pivot, times of the extreme and of the last bar, and legs so far.
STATE = "i long, atr double, last_close double, leg int, far long, best double, pivot long, p double, conf long, pivot_at timestamp, conf_at timestamp, far_at timestamp, last_at timestamp, legs int"


def stream_causal_segments(bars: DataFrame, cfg: SegmentationConfig | None = None) -> DataFrame:
    """The rows of segment_causal, each when its confirming bar arrives."""
    cfg = cfg or SegmentationConfig()
    names = [x.split()[0] for x in CAUSAL.split(", ")]

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = list(state.get) if state.exists else None
        machine = K.CausalZigzag(cfg.atr_period, cfg.atr_reversal, s[:6] if s else None)
        pivot, p, conf, pivot_at, conf_at, far_at, last_at, legs = s[6:] if s else (0, 1.0, 0, None, None, None, None, 0)
        out = []
        for bar in pd.concat(list(batches)).sort_values("timestamp").itertuples(index=False):
            at = bar.timestamp
            if last_at is not None and at <= last_at:
                continue
            last_at = at
            before_at = far_at
            found = machine.step(float(bar.high), float(bar.low), float(bar.close))
            if machine.i == 0:
                pivot_at = conf_at = far_at = at
            if machine.at == machine.i:
                far_at = at
            if not found:
                continue
            start = (pivot, p, conf, pivot_at, conf_at)
            pivot, p, conf, pivot_at, conf_at = found[0], found[1], machine.i, before_at, at
            if pivot - start[0] >= cfg.min_bars:
                low = min(start[1], p)
                out.append((f"{key[0]}:{legs}", key[0], legs, start[0], pivot, start[3], pivot_at, start[1], p, low, 1 - low, "causal_atr_zigzag" if legs else "edge", "causal_atr_zigzag", pivot - start[0] + 1, conf, at, start[4], "causal_atr_zigzag"))
            legs += 1
        state.update((*machine.state(), int(pivot), float(p), int(conf), pivot_at, conf_at, far_at, last_at, int(legs)))
        yield pd.DataFrame(out, columns=names)

    rows = bars.select("symbol", F.col("timestamp").cast("timestamp").alias("timestamp"), "high", "low", "close")
    schema = CAUSAL.replace("timestamp_ntz", "timestamp")
    out = rows.groupBy("symbol").applyInPandasWithState(step, schema, STATE, "append", GroupStateTimeout.NoTimeout)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end", "available_at", "start_available_at")})


def stream_dwell(segments: DataFrame, least: int = DurationConfig.dwell_bars) -> DataFrame:
    """(segment_id, symbol, causal_duration_label) of a stream of labelled segments."""
    probs = probability_columns(segments)
    best = F.greatest(*[F.col(c) for c in probs])
    top = F.coalesce(*[F.when(F.col(c) == best, c.removeprefix("prob_")) for c in probs])

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["start_idx", "end_idx"], kind="stable")
        before = (state.get[0], int(state.get[1])) if state.exists else (None, 0)
        labels, after = K.dwell(rows["top"].tolist(), (rows["label"] == K.UNKNOWN).tolist(), rows["n_bars"].tolist(), least, before)
        state.update((after[0], int(after[1])))
        yield pd.DataFrame({"segment_id": rows["segment_id"], "symbol": key[0], "causal_duration_label": labels})

    need = segments.select("segment_id", "symbol", "start_idx", "end_idx", "label", "n_bars", top.alias("top"))
    return need.groupBy("symbol").applyInPandasWithState(step, "segment_id string, symbol string, causal_duration_label string", "current string, lasted long", "append", GroupStateTimeout.NoTimeout)
