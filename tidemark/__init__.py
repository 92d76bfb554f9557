"""Spark-native segmentation of bar series and point-in-time analytics."""

from .config import GateConfig, PipelineConfig, SegmentationConfig
from .operators.discovery import discover, walk_forward
from .operators.features import segment_features
from .operators.segments import Segmenter, segment_bars, segment_causal

__all__ = ["GateConfig", "PipelineConfig", "SegmentationConfig", "Segmenter", "discover", "segment_bars", "segment_causal", "segment_features", "walk_forward"]
