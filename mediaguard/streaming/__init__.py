"""Continuous ingest and event-time video verdicts on Structured Streaming."""
