"""Operators for training-data pipelines: scoring, deduplication, tokenizing, mixing."""
