"""Statement-context analytics on Spark."""
