"""Operators of a training-data pipeline: cleaning, deduplication, scoring, tokenisation."""
