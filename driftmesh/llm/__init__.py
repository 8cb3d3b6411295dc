"""Operators for training-data pipelines: dedup, decontamination, scans, search, tokens."""
