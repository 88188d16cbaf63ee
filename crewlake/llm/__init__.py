"""Operators for building training corpora: language, quality, duplicates, contamination, mixing, language models."""
