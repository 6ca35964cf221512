"""Distributed operators; each module takes and returns DataFrames."""
