"""Leakage-safe time-series analytics and forecast-to-decision evaluation on Spark."""
