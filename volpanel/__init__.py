"""volpanel: Spark jobs for volatility forecasting on large panels of price series."""
