"""Job parameters in one place."""

from dataclasses import dataclass

# Feature order of the vector, forecast horizons in hours, thresholds and constants.
FEATURES = (
    "occupancy_ratio", "arrival_rate", "severity_index", "avg_wait_time", "los_deviation",
    "weather_score", "flu_index", "traffic_score", "hour_sin", "hour_cos",
)
FEATURE_MEAN = (0.5, 5.0, 0.15, 30.0, 0.0, 0.3, 3.0, 0.3, 0.0, 0.0)
FEATURE_STD = (0.2, 3.0, 0.10, 20.0, 0.5, 0.2, 2.0, 0.2, 0.7, 0.7)
HORIZONS = (1, 2, 4, 8)
HORIZON_LABELS = ("1h", "2h", "4h", "8h")
AMBER_FROM = 0.6
RED_FROM = 0.8
DEFAULT_CAPACITY = 10
DEFAULT_CONFIDENCE = 0.85
DEFAULT_VERSION = "1.0.0"
TOPICS = {
    "patient": "ed.patient.events",
    "context": "ed.context.events",
    "features": "ed.feature.windows",
    "context_windows": "ed.context.events.enriched",
    "alerts": "ed.alerts",
    "dead": "ed.dead.letter",
}


@dataclass(frozen=True)
class FlowConfig:
    window: str = "10 minutes"
    slide: str = "10 minutes"
    watermark: str = "10 minutes"
    context_window: str = "30 minutes"
    context_watermark: str = "30 minutes"
    trigger: str = "60 seconds"
    max_offsets: int | None = None  # intake per micro-batch; no bound unless the caller sets one


@dataclass(frozen=True)
class DriftConfig:
    bins: int = 10
    epsilon: float = 1e-8
    keep_records: int = 288
    min_records: int = 50
    psi_limit: float = 0.2
    mae_factor: float = 2.0
    baseline_mae: float = 0.045


@dataclass(frozen=True)
class LossConfig:
    threshold: float = 0.8
    under_penalty: float = 3.0
    margin: float = 0.05
    hinge: float = 0.5
    false_alarm: float = 0.2


@dataclass(frozen=True)
class Retention:
    features_days: int = 7
    predictions_days: int = 30
    alerts_days: int = 90
