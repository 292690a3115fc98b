"""DataFrame to DataFrame operators on panels keyed by (asset, date)."""
