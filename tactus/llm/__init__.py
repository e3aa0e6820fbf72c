"""Operators for preparing text corpora for language models, and their queries."""
