"""Parameters of the engine in one immutable object, passed explicitly."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """Defaults of every operator that takes a parameter; operators never read the environment.

    Fixed values: durations, windows, budgets, grids, horizons, ratios and the seed are those that published results use.
    """

    event_seconds: float = 300.0
    merge_gap_seconds: float = 0.0
    max_offset_seconds: float = 86_400.0
    session_seconds: float = 129_600.0
    window_samples: int = 160
    window_stride: int = 160
    least_window_samples: int = 32
    target_rate_hz: float = 32.0
    alarm_budget_per_hour: float = 10.0
    alarm_budgets: tuple[float, ...] = (1.0, 5.0, 10.0, 25.0, 50.0)
    smoothing_windows: tuple[int, ...] = (1, 3, 5, 9, 15, 25)
    refractory_minutes: tuple[float, ...] = (0.0, 1.0, 2.0, 5.0, 10.0, 15.0)
    fusion_weights: tuple[float, ...] = (0.05, 0.10, 0.15, 0.20, 0.25, 0.35, 0.50, 0.75, 1.0)
    negative_ratio: float = 5.0
    max_train_windows: int = 600_000
    session_fraction: float = 0.7
    max_sessions: int = 120
    horizons_seconds: tuple[int, ...] = (300, 900, 1800)
    pre_seconds: float = 1800.0
    post_seconds: float = 1800.0
    recovery_seconds: float = 3600.0
    sequence_length: int = 60
    sequence_window: int = 32
    seed: int = 42
    #: Up to this size, as the optimizer estimates it, a window may put all rows of a key into one task; beyond it they are dealt out.
    one_task_bytes: int = 128 << 20

    def __post_init__(self):
        if not all(0 <= w <= 1 for w in self.fusion_weights):
            object.__setattr__(self, "fusion_weights", tuple(w for w in self.fusion_weights if 0 <= w <= 1) or (1.0,))
        if not 0.1 <= self.session_fraction <= 1:
            object.__setattr__(self, "session_fraction", min(1.0, max(0.1, self.session_fraction)))
        if self.window_samples < self.least_window_samples:
            object.__setattr__(self, "window_samples", self.least_window_samples)


DEFAULT = EngineConfig()
