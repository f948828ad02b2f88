"""Point-in-time, partially observed event data on Spark."""
