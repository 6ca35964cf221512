"""Spark-native analytics for libraries of formal declarations, proof traces and textbook material."""

from theoremill.runtime import build_session

__all__ = ["build_session"]
