"""Streaming plans (an extension: the reference has none)."""
