"""Recommendation analytics on PySpark: behaviour logs to ranked products, and product similarity."""

from shelfwise.config import RunConfig, Thresholds

__all__ = ["RunConfig", "Thresholds"]
