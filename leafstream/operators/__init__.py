"""Operators on tables of segments, chunks, providers and attempts."""
