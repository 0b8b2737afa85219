"""Spark jobs over commit-history tables, with training-data operators in ``llm``."""
