"""Parameters of the analysis, passed to operators instead of read from the environment."""

from __future__ import annotations

from dataclasses import dataclass, field

# Must equal the published analysis.
TARGET_ROUTES = ("14", "38", "49")
BUNCHING_FRACTION = 0.25
MAX_GAP_SECONDS = 7200
MIN_HEADWAY_SECONDS = 30
MAX_FEED_AGE_SECONDS = 300
MAX_ERROR_RATE = 0.05
NAIVE_ALERT_SECONDS = 60


@dataclass(frozen=True)
class BoundingBox:
    """Area in which vehicle positions are expected."""

    min_lat: float = 37.3
    max_lat: float = 38.0
    min_lon: float = -122.6
    max_lon: float = -122.0


@dataclass(frozen=True)
class TemporalSplit:
    """Which route and month train the model, and the days that bound each split."""

    route: str = "14"
    month: int = 2
    train_until: int = 16
    calibrate_until: int = 21


@dataclass(frozen=True)
class AnalysisParams:
    routes: tuple[str, ...] = TARGET_ROUTES
    window: int = 3
    alpha: float = 0.10
    seed: int = 42
    resamples: int = 1000
    split: TemporalSplit = field(default_factory=TemporalSplit)
    bbox: BoundingBox = field(default_factory=BoundingBox)
