"""Spark-first engine for indexing, searching and checking document and code corpora."""
