"""Declarations: what an observation table looks like and what a policy allows."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ObsSpec:
    """Names the roles of the columns of an observation table.

    One table holds the baseline and every later batch; ``scenario`` tells
    them apart and ``baseline`` is the value that marks the reference sample.
    ``features`` is the declared list: shares are taken over it even when a
    batch lacks some of the columns.
    """

    features: tuple[str, ...]
    label: str = "Class"
    scenario: str = "scenario"
    score: str = "Probability"
    prediction: str = "Prediction"
    baseline: str = "Baseline"
    keys: tuple[str, ...] = ()
    event_time: str | None = None

    def scenario_column(self) -> Column:
        """The scenario under its short name. It is not aliased onto itself:
        such an alias is removed in some places of a plan only, and equal
        subplans are then no longer recognised as equal."""
        c = F.col(self.scenario)
        return c if self.scenario == "scenario" else c.alias("scenario")

    def with_features(self, *features: str) -> "ObsSpec":
        return replace(self, features=tuple(features))


# The feature list of the card-transaction schema.
CARD_FEATURES: tuple[str, ...] = (
    "Time",
    *(f"V{i}" for i in range(1, 29)),
    "Amount",
)

# Default limits of the checks.
KS_ALPHA = 0.05
PSI_MODERATE = 0.10
PSI_HIGH = 0.20
PSI_FULL_RETRAIN = 0.40
DRIFT_SHARE_LIMIT = 0.30
F1_DROP_LIMIT = 0.05
AUC_DROP_LIMIT = 0.03
DEGRADED_MARGIN = 0.001
PROMOTION_F1_GAIN = 0.01
DEFAULT_THRESHOLD = 0.50
ORIGINAL_SAMPLE_SHARE = 0.30


@dataclass(frozen=True)
class LevelLimits:
    """Limits of one severity level of a count policy; None switches a rule off."""

    count: int | None
    f1_drop: float | None
    auc_drop: float | None


@dataclass(frozen=True)
class CountPolicy:
    """Two-level policy on the *number* of drifted features and metric drops."""

    retrain: LevelLimits
    warn: LevelLimits
    labels: tuple[str, str, str]
    count_note: tuple[str, str]
    quiet: str


@dataclass(frozen=True)
class RatioPolicy:
    """One-level policy on the *share* of drifted features and metric drops.

    ``psi`` adds an average-PSI trigger; it is off unless a limit is given.
    """

    share: float = DRIFT_SHARE_LIMIT
    f1_drop: float = F1_DROP_LIMIT
    auc_drop: float = AUC_DROP_LIMIT
    alpha: float = KS_ALPHA
    psi_moderate: float = PSI_MODERATE
    psi_high: float = PSI_HIGH
    psi: float | None = None


# The limits and wording of the two count presets.
COUNT_POLICY = CountPolicy(
    retrain=LevelLimits(count=8, f1_drop=0.10, auc_drop=0.05),
    warn=LevelLimits(count=4, f1_drop=0.05, auc_drop=0.02),
    labels=("RETRAIN", "WARNING", "OK"),
    count_note=("", ""),
    quiet="No retraining trigger exceeded",
)
INLINE_POLICY = CountPolicy(
    retrain=LevelLimits(count=8, f1_drop=0.10, auc_drop=0.05),
    warn=LevelLimits(count=4, f1_drop=0.05, auc_drop=None),
    labels=("RETRAIN", "WARNING", "STABLE"),
    count_note=(" (>= 8 threshold)", " (>= 4 warning threshold)"),
    quiet="No triggers activated.",
)
RATIO_POLICY = RatioPolicy()
