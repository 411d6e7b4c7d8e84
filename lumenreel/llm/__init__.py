"""Operators of a training-data pipeline: formats, deduplication, scans, scores, tokens, mixing, fingerprints."""
