"""Watching data and classifiers in production with Spark."""

from shiftspark.spec import COUNT_POLICY, INLINE_POLICY, RATIO_POLICY, ObsSpec

__all__ = ["COUNT_POLICY", "INLINE_POLICY", "RATIO_POLICY", "ObsSpec"]
