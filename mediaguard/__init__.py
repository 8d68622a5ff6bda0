"""Governance, scoring and robustness evaluation of media corpora as Spark jobs."""
