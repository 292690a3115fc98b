"""Where panels come from: ticks, CSV files of bars, and the given tables."""
