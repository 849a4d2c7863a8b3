"""Operators for preparing training data. Nothing outside this package and ``corpus_pipeline`` imports it."""
