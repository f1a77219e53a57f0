"""Incremental forms of the graph operators."""
