"""Readers and writers. All parsing is declarative (Spark readers and column expressions) but for HTML."""
