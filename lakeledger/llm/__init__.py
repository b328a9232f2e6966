"""Operators of a training-data pipeline: tokenizing, filtering, scoring and deduplicating documents."""
