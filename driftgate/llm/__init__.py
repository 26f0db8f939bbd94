"""Operators for building training data: formatting, counting, filtering, deduplicating, mixing and scoring."""
