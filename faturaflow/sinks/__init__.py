"""Sinks and payload projections."""
