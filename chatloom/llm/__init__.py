"""Operators for training-data pipelines (deduplication, language, tokens, packing)."""
