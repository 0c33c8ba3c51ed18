"""Batch operators over shop tables (each takes and returns DataFrames)."""
