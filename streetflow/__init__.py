"""Continuous traffic analytics over moving-object streams, on Spark."""
