"""Relational operators: DataFrames in, DataFrames out; no sessions, paths or caches inside."""
