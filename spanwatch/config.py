"""Default settings. Every operator takes them as arguments; per-service values come from a table."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Profile:
    """How traces are read. ``batch`` infers every parent from containment and keeps all edges;
    ``stream`` trusts explicit parents and keeps each cross-service edge once."""

    name: str
    explicit_parents: bool
    cross_service_only: bool
    frames: int


BATCH = Profile("batch", False, False, 5)
STREAM = Profile("stream", True, True, 3)


@dataclass(frozen=True)
class Settings:
    min_spans: int = 2
    learn_min_trace: int = 3
    learn_min_error: int = 2
    dominance: float = 0.6
    spike_times: float = 2.0
    drop_times: float = 0.5
    drop_min: int = 4
    error_spike_times: float = 3.0
    error_spike_min: int = 5
    vanished_share: float = 0.2
    promote_runs: int = 5
    promote_detections: int = 10
    silent_min: int = 4
    latency_window_s: int = 120
    latency_learn: int = 30
    z: float = 3.0
    error_window_s: int = 120
    error_rate: float = 0.05
    error_samples: int = 10
    throughput_window_s: int = 120
    throughput_drop: float = 0.5
    throughput_learn: int = 20
    query_window_s: int = 300
    query_learn: int = 10
    deploy_window_s: int = 3600
    tiers: int = 2


DEFAULTS = Settings()
