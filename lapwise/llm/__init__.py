"""Operators of a training-data pipeline; their driver queries are in ``lapwise.llm.queries``."""
