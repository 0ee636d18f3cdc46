"""Spark-first engine that builds, samples and scores code-infilling datasets."""
