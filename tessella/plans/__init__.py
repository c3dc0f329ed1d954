"""Whole runs: building an index, checking it, answering from it."""
