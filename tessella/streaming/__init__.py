"""Streams: keeping an index up to date, and windows over events."""
