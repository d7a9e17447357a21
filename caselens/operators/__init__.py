"""Operators over evidence frames."""
