"""Layers, marts and the query catalogue."""
