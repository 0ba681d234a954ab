"""Operators for training-data pipelines: one module each, and queries in ``queries``."""
