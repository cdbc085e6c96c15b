"""Trend analytics on Spark: velocities, narratives, trades, back-tests."""
