"""Physiological time-series and training-data jobs on Spark."""
