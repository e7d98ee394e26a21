"""All settings of the panel jobs in one place."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Method:
    """How a detector builds its baselines."""

    engine: str = "chronological"
    baseline: str = "rolling"
    policy: str = "confirm"
    lifecycle: bool = True


#: Names and settings of the four methods that are compared.
METHODS = {
    "v1.1-reference": Method("frozen", "fixed", "include_all", False),
    "v2-fixed": Method(baseline="fixed"),
    "v2-rolling": Method(),
    "v2-rolling-naive": Method(policy="include_all", lifecycle=False),
}
#: Planted errors, in order.
ERROR_KINDS = ("spike_x10", "units_x1000", "drop_to_zero", "misstate_25pct", "stale_repeat", "feed_stops")
LABELS = ("investigate", "explained", "noise")
SEVERITY_RANK = {"": 0, "info": 0, "low": 1, "medium": 2, "high": 3}


@dataclass(frozen=True)
class Params:
    """Periods are whole numbers; windows include both ends."""

    baseline: tuple[int, int] = (2010, 2019)
    monitor: tuple[int, int] = (2020, 2026)
    last_complete: int = 2026
    sigmas: float = 3.0
    mad_scale: float = 1.4826
    min_points: int = 8
    run_length: int = 8
    high_z: float = 5.0
    top_n: int = 25
    persistent: int = 3
    c_fraction: float = 0.05
    c_floor: float = 1e5
    window: int = 10
    min_zero: int = 2
    shift_medium_z: float = 1.0
    planted: int = 40
    trials: int = 10
    misstatement: float = 0.25
    tolerance: float = 1.0
    precision_at: int = 10
    seeds: dict[str, int] = field(default_factory=lambda: {"tuning": 7, "holdout": 2026})

    @property
    def span(self) -> str:
        return f"{self.baseline[0]}-{self.baseline[1]}"
