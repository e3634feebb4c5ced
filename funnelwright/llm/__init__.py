"""Operators of a training-data pipeline: ten numbered operators, one module each, and their queries."""
