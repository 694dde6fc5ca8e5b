"""Usage analytics on Spark."""
