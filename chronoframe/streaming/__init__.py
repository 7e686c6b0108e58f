"""Scheduled forward tracking."""

from chronoframe.streaming.tracking import Tracker, apply_batch, track

__all__ = ["Tracker", "apply_batch", "track"]
