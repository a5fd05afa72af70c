"""Operators of a training-data pipeline (``llm.queries`` registers one query for each)."""
