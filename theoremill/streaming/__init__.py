"""Incremental forms: idle-session sweep, idempotent ingestion, change classification."""
