"""Metric plans, marts and the registered query catalogue."""
