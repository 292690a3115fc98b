"""Operators for large-scale text corpora: scans, joins, mixing, tokenising, archives.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
