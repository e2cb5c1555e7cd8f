"""Explainable transaction-risk analytics as Spark jobs."""
