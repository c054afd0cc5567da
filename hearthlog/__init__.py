"""Unusual behaviour in sensor and event logs, found with Spark DataFrames."""

from hearthlog.settings import Settings

__all__ = ["Settings"]
