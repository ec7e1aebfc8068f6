"""All thresholds and horizons in one immutable object."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Params:
    # Defaults of the published contract.
    # energy
    power_normal: float = 110.0
    power_high: float = 135.0
    power_leak: float = 120.0
    load_leak: float = 30.0
    # rule classifier
    temp_critical: float = 90.0
    load_critical: float = 90.0
    temp_warning: float = 75.0
    load_warning: float = 70.0
    # machine selector
    max_failure_probability: float = 0.7
    max_temperature: float = 90.0
    max_load: float = 80.0
    units_per_minute: float = 100.0
    # lifecycle
    pause_seconds: int = 600
    idle_seconds: int = 1800
    min_available: int = 1
    done_ratio: float = 0.80
    default_duration: int = 60
    honour_priority: bool = True
    # features and labels
    window_rows: int = 12
    critical_horizon: int = 6
    warning_horizon: int = 18
    # lookbacks
    status_lookback: str = "15 minutes"
    state_lookback: str = "15 minutes"
    floor_status_lookback: str = "10 minutes"
    floor_metrics_lookback: str = "5 minutes"
    floor_pause_lookback: str = "15 minutes"
    floor_task_lookback: str = "2 hours"
    tasks_lookback: str = "5 minutes"
    stats_lookback: str = "10 minutes"
    # cadence
    trigger: str = "20 seconds"
    epoch: str = "30 seconds"
    queue_epochs: int = 20  # epochs between whole copies of the queue; others write changes
    watermark: str = "10 minutes"
    archive_file_bytes: int = 256 << 20  # input to one file of the compacted archive
    # scale: ordered work on more rows than this is cut into slices
    rows_per_slice: int = 2_000_000
    max_slices: int = 50_000
    max_listed_keys: int = 10_000
    max_top: int = 100_000  # rows of a head that one task may sort

    def but(self, **changes) -> "Params":
        return replace(self, **changes)


DEFAULTS = Params()
