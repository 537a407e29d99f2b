"""Operators of a training-data pipeline: extraction, deduplication, filters, language models, mixing, tokens, search."""
