"""Hybrid document retrieval as Spark jobs."""
