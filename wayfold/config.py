"""Settings with their defaults and limits, from the environment or from keyword arguments."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """What a build and its queries may be told; a value out of its limits is refused."""

    block_metres: float = 50.0
    outside_margin_metres: float = 50.0
    border_tolerance_metres: float = 60.0
    tier_count: int = 5
    tier_metres: int = 1000
    most_points: int = 5000
    most_requests: int = 16
    keep_snapshots: int = 5
    least_source: int = 1
    least_match_rate: float = 0.0
    most_change: float = 1.0

    def __post_init__(self):
        limits = {"block_metres": (0.1, 500), "outside_margin_metres": (0, 5000), "border_tolerance_metres": (0, 1000), "tier_count": (1, 10), "tier_metres": (100, 10_000), "most_points": (1, 100_000), "most_requests": (1, 10_000), "keep_snapshots": (1, 1000), "least_source": (0, 10**9), "least_match_rate": (0, 1), "most_change": (0, 10)}
        for name, (low, high) in limits.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must lie within {low} and {high}")

    @classmethod
    def from_env(cls, prefix: str = "WAYFOLD_", env: dict[str, str] | None = None) -> Settings:
        """Settings from variables such as WAYFOLD_BLOCK_METRES; others keep their defaults."""
        known = os.environ if env is None else env
        kinds = {"int": int, "float": float}
        return cls(**{f.name: kinds[f.type](known[prefix + f.name.upper()]) for f in fields(cls) if prefix + f.name.upper() in known})
