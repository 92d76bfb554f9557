"""Settings with their defaults (fixed values: names and defaults have to agree with the surveyed behaviour), passed by value
into kernels. Kernel change points and HDBSCAN are optional there and off by default here."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class SegmentationConfig:
    min_bars: int = 4
    atr_period: int = 14
    atr_reversal: float = 2.2
    merge_tolerance: int = 2
    min_boundary_probability: float = 0.34
    min_boundary_votes: int = 2
    single_source_min_probability: float = 0.75
    bootstrap_iterations: int = 0
    bootstrap_tolerance: int = 3
    bootstrap_price_noise: float = 0.002
    bootstrap_volume_noise: float = 0.08
    use_adaptive_structure: bool = True
    use_fractal_pivots: bool = True
    use_bocpd: bool = True
    use_kernel_changes: bool = False
    kernel_change_penalty: float = 5.0
    fractal_window: int = 2
    fractal_min_prominence_atr: float = 0.35
    bocpd_hazard: float = 0.04
    bocpd_min_run_length: int = 5
    bocpd_change_probability: float = 0.52
    bocpd_max_run_length: int = 80

    def __post_init__(self):
        if self.min_bars < 1:
            raise ValueError("min_bars must be at least one")


@dataclass(frozen=True)
class GateConfig:
    """Limits of the abstention gates; those of the discovery ensemble."""

    n_clusters: int = 5
    ensemble_size: int = 5
    random_state: int = 42
    max_iter: int = 100
    min_consensus: float = 0.50
    max_entropy: float = 0.78
    max_disagreement: float = 0.25
    density_quantile: float = 0.04
    min_recognizability: float = 0.48
    max_boundary_uncertainty: float = 0.44
    max_context_conflict: float = 0.75
    include_hdbscan: bool = False
    hdbscan_min_strength: float = 0.30
    min_cluster_samples: int = 5
    min_cluster_symbols: int = 2
    min_cluster_years: int = 1


BASELINE_GATES = GateConfig(min_consensus=0.52, max_disagreement=0.22)
TRUSTED_GATES = GateConfig(
    min_consensus=0.6, max_entropy=0.65, max_disagreement=0.18, density_quantile=0.05, min_recognizability=0.55,
    max_boundary_uncertainty=0.35, max_context_conflict=0.5, min_cluster_samples=20, min_cluster_symbols=4, min_cluster_years=2,
)


@dataclass(frozen=True)
class DurationConfig:
    enabled: bool = True
    min_segments: int = 2
    max_segments: int = 20
    continuation: float = 0.65
    dwell_bars: int = 5


@dataclass(frozen=True)
class PipelineConfig:
    segmentation: SegmentationConfig = field(default_factory=SegmentationConfig)
    model: GateConfig = field(default_factory=GateConfig)
    duration: DurationConfig = field(default_factory=DurationConfig)
    backend: str = "ensemble"

    @classmethod
    def from_json(cls, text: str) -> PipelineConfig:
        raw = json.loads(text)
        kinds = {"segmentation": SegmentationConfig, "model": GateConfig, "duration": DurationConfig}
        made = {}
        for name, kind in kinds.items():
            known = {f.name for f in fields(kind)}
            made[name] = kind(**{k: v for k, v in raw.get(name, {}).items() if k in known})
        return cls(**made, backend=raw.get("backend", "ensemble"))
