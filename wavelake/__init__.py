"""Wavelake: time-series event analytics on Spark."""
