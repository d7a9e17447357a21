"""Streams of evidence: searches and timelines over files that still grow."""
