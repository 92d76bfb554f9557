"""Model parameters as JSON."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession

from ..functions.kernels import Mixture, RobustScaler
from ..operators.discovery import Ensemble
from .files import read_json, write_json


def _mixture(m: Mixture) -> dict:
    return {"weights": m.weights.tolist(), "means": m.means.tolist(), "variances": m.variances.tolist(), "converged": bool(m.converged), "bound": float(m.bound)}


def save_ensemble(spark: SparkSession, path: str, model: Ensemble) -> None:
    s = model.scaler
    write_json(spark, path, {"features": model.features, "names": model.names, "low_density": model.low_density, "fill": s.fill.tolist(), "middle": s.middle.tolist(), "spread": s.spread.tolist(), "members": [_mixture(m) for m in model.members], "process": _mixture(model.process)})


def load_ensemble(spark: SparkSession, path: str) -> Ensemble:
    raw = read_json(spark, path)
    scaler = RobustScaler.__new__(RobustScaler)
    scaler.fill, scaler.middle, scaler.spread = (np.array(raw[k]) for k in ("fill", "middle", "spread"))
    mix = lambda m: Mixture(np.array(m["weights"]), np.array(m["means"]), np.array(m["variances"]), m["converged"], m["bound"])
    return Ensemble(raw["features"], scaler, [mix(m) for m in raw["members"]], mix(raw["process"]), raw["low_density"], raw["names"])
