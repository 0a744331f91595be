"""Structured Streaming over a folder of files."""
