"""Time-series segment analytics on Spark."""
