"""Seasonal time series and before/after-event window models on Spark DataFrames."""
