"""Tidemark: temporal event analytics and corpus preparation on Spark."""
