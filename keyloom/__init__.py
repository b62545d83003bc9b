"""Pivot analytics over delimiter-structured key-value data, on Spark."""
