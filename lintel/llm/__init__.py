"""Operators for building training data: tokenising, deduplication, filtering, rewriting.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
