"""Structured Streaming forms of the walk-forward forecasts."""
