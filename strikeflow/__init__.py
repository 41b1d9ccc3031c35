"""Option market data jobs on Spark."""
